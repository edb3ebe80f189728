"""Operator 4: main text of HTML pages, with a suffix array over each host's text.

A tolerant pass over the tags keeps a stack of open elements, drops scripts, styles and comments, and cuts the rest
into blocks. Elements that by name, role or class are menus, headers, footers, sidebars, notices, adverts, forms or
reader comments are furniture. Each page is parsed once; all its blocks, those of marked articles (``article``,
``main``) and furniture too, become a token stream.

The streams of a host are laid one after another; their suffix array, with the longest common prefixes of neighbours,
shows the substrings of ``depth`` tokens or more that stand in at least ``pages_needed`` distinct pages. Tokens that
they cover are boilerplate: every page says how many it has (``repeated``). Unique runs, what is left, show where the
main text is. Where a page marks articles, those with unique runs are its text, and marked articles without any, such
as teasers of other stories, go; the tags then check the bounds: an article that is found is complete without its
furniture, since it may rightly share sentences with other pages, and stands alone. Only where no marked article has
a unique run (a story that several pages tell in the same words) the marks decide alone. Where a page marks none, a
covered block goes, of other blocks covered runs of ``depth`` tokens go (shorter ones only touch boilerplate next to
them), unique runs are kept.

A host may hold any share of all pages, so it falls by hash into shards of about ``shard_tokens`` tokens, each with its
own suffix array. Each page is in one shard, so the pages that hold a substring are counted by shard and summed over
the host before ``pages_needed`` is applied: results do not depend on shards. Most substrings stand once, so shards
first send short codes of all of theirs, sorted, ``SPARSE`` times as many codes as the host has tokens; substrings whose
code comes often enough are then summed by 128 bits of hash. Rows of equal tokens are one page: copies do not make each
other boilerplate, and of copies in one task only the first sends its text. Texts are shuffled once, compressed; the
table of hosts with several shards is broadcast up to ``broadcast_rows`` rows, beyond that it is joined.

Defined results: null and empty html give an empty text; character references are decoded once; white space is
space, tab, line feed, form feed, vertical tab and carriage return; ``br`` ends a block; repeated rows each give a
row; null urls share one host; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm.common import WORD_POWERS, WORD_POWERS2, mix, portions, slice_hashes, table, word_hashes, words
from tidewave.llm.tables import Work

# Elements and names by what they hold.
RAW = frozenset("script style noscript template iframe svg math object canvas audio video".split())
FURNITURE = frozenset("nav footer aside form button select textarea dialog menu head title option fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img input".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|nav\w*|menu\w*|sidebar\w*|foot(?:er)?|header|banner\w*|cookie\w*|consent|notice\w*|popup|modal|newsletter|subscribe|share|social|breadcrumbs?|related|comments?|comment-?list|disqus\w*|widget\w*|login|signup|search)(?:$|[\s_-])", re.I)
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WHITE = re.compile(r"[ \t\n\r\f\v]+")

#: Codes of substrings for each token of a host, shards that meet in one task, bytes of html for a token, copies in a row.
SPARSE, MEET, TOKEN_BYTES, COPIES = 16, 8, 7, 256


def _is_furniture(name: str, attributes: str, inside: bool) -> bool:
    if name in FURNITURE or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "role" and value.lower() in ROLES or key in ("class", "id") and NAMES.search(value):
            return True
    return False


def parse(page: str) -> tuple[list[tuple[str, int]], list[int]]:
    """Blocks in page order, each with the marked article it stands in (-1: furniture, 0: outside), and for 0 and each
    marked article, numbered from 1, the one around it."""
    blocks: list[tuple[str, int]] = []
    around, within = [0], [0]
    stack: list[tuple[str, bool, bool]] = []  # name, begins furniture, begins an article
    open_names: Counter[str] = Counter()
    last = page.rfind(">")
    furniture = 0
    parts: list[str] = []

    def end_block() -> None:
        if parts:
            text = WHITE.sub(" ", html.unescape("".join(parts))).strip(" ")
            parts.clear()
            if text:
                blocks.append((text, -1 if furniture else within[-1]))

    at = 0
    while True:
        m = TAG.search(page, at) if at <= last else None
        if m is None:
            parts.append(page[at:] if (cut := page.find("<!--", at)) < 0 else page[at:cut])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if not closing and name in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
                at = len(page) if close is None else close.start()
            continue
        if name in RAW:
            continue
        if name not in INLINE or name == "br":
            end_block()
        if name in VOID:
            continue
        if closing:
            if open_names[name]:
                while True:
                    top, f, a = stack.pop()
                    open_names[top] -= 1
                    if f or a:
                        end_block()
                    furniture -= f
                    if a:
                        within.pop()
                    if top == name:
                        break
            continue
        if attributes.endswith("/") and name in INLINE:
            continue
        if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name and not stack[-1][1]:
            stack.pop()
            open_names[name] -= 1
        f = _is_furniture(name, attributes, len(within) > 1)
        a = not f and not furniture and (name in ("article", "main") or 'role="main"' in attributes)
        if f or a:
            end_block()
        furniture += f
        if a:
            around.append(within[-1])
            within.append(len(around) - 1)
        stack.append((name, f, a))
        open_names[name] += 1
    end_block()
    return blocks, around


def suffix_array(streams: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of all suffixes of the joined streams, the longest common prefix of each with the one before it in that
    order, and the tokens left to the end of the stream at each place.

    Prefix doubling: the rank of a suffix by its first ``length`` tokens is the number of smaller ones, and only suffixes
    that still share their rank are sorted again. The ranks of all rounds then give common prefixes by halving steps.
    """
    sizes = np.array([len(s) for s in streams], np.int64)
    total = int(sizes.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 3
    _, code, count = np.unique(np.concatenate([np.array(s, np.int64) for s in streams]), return_inverse=True, return_counts=True)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(total)
    rank = (np.cumsum(count) - count)[code] + 1  # 0 is the end of a stream
    levels, length = [rank], 1
    tied = np.flatnonzero(count[code] > 1)
    while len(tied):
        second = np.where(left[tied] > length, rank[np.minimum(tied + length, total - 1)], 0)
        order = np.argsort(rank[tied] * (total + 1) + second)
        place, first, second = tied[order], rank[tied[order]], second[order]
        at = np.arange(len(place))
        group = np.append(True, first[1:] != first[:-1])
        part = group | np.append(True, second[1:] != second[:-1])
        begin = np.maximum.accumulate(np.where(part, at, 0))
        rank = rank.copy()
        rank[place] = first + begin - np.maximum.accumulate(np.where(group, at, 0))
        alone = part & np.append(part[1:], True)
        tied = place[~alone & (second > 0)]
        levels.append(rank)
        length *= 2
    order = np.argsort(rank)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(max(0, total - 1), np.int64)
    ends_a, ends_b = a + left[a], b + left[b]
    for level in range(len(levels) - 1, -1, -1):
        step, known = 1 << level, levels[level]
        same = (a + step <= ends_a) & (b + step <= ends_b)
        same[same] = known[a[same]] == known[b[same]]
        common[same] += step
        a[same] += step
        b[same] += step
    return order, np.append(0, common), left


def substrings(streams: list[list[int]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Where substrings of ``depth`` tokens start in the joined streams, in sorted order, and the number of each one."""
    order, common, left = suffix_array(streams)
    long = left[order] >= depth
    return order[long], np.cumsum((common < depth)[long]) - 1


def pages_with(sizes: np.ndarray, starts: np.ndarray, run: np.ndarray, numbers: np.ndarray | None = None) -> np.ndarray:
    """In how many distinct pages of these sizes each substring stands; ``numbers``: the same for streams of one page."""
    page = np.repeat(np.arange(len(sizes)) if numbers is None else numbers, sizes)
    if not len(run):
        return np.zeros(0, np.int64)
    n = np.bincount(run)
    several = n[run] > 1
    pairs = np.unique(run[several] * len(sizes) + page[starts[several]]) // len(sizes)
    return np.where(n > 1, np.bincount(pairs, minlength=len(n)), n)


def cover(sizes: np.ndarray, depth: int, starts: np.ndarray) -> list[np.ndarray]:
    """For the tokens of pages of these sizes, which are covered by substrings of ``depth`` tokens from ``starts``."""
    total = int(sizes.sum())
    marks = np.bincount(starts, minlength=total + 1) - np.bincount(starts + depth, minlength=total + 1)
    return np.split(np.cumsum(marks[:total]) > 0, np.cumsum(sizes)[:-1])


def covered(streams: list[list[int]], depth: int, pages_needed: int) -> list[np.ndarray]:
    """For each page's tokens, which are covered by substrings of ``depth`` tokens found in enough distinct pages."""
    starts, run = substrings(streams, depth)
    sizes = np.array([len(s) for s in streams], np.int64)
    return cover(sizes, depth, starts[(pages_with(sizes, starts, run) >= pages_needed)[run]])


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def names(hashes: tuple[np.ndarray, np.ndarray], depth: int, starts: np.ndarray) -> np.ndarray:
    """Two hashes of the words of each substring at ``starts``, from two of each word: the same in every shard."""
    return np.stack([mix(slice_hashes(h, starts, starts + depth, powers)) for h, powers in zip(hashes, (WORD_POWERS, WORD_POWERS2), strict=True)], axis=1)


def every_start(sizes: np.ndarray, depth: int) -> np.ndarray:
    """Where substrings of ``depth`` tokens start in streams of these sizes, in page order."""
    return np.flatnonzero(np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum()) >= depth)


def short_codes(hashes: np.ndarray, shards: int, shard_tokens: int) -> tuple[np.ndarray, int]:
    """Leading bits of hashes, and how many: ``SPARSE`` codes or more for each token of the host."""
    bits = min(63, (SPARSE * shards * shard_tokens).bit_length())
    return hashes >> np.uint64(64 - bits), bits


def squeezed(codes: np.ndarray) -> bytes:
    """Sorted codes as their differences, bytes of equal weight side by side, compressed."""
    steps = np.diff(codes, prepend=np.uint64(0))
    return pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unsqueezed(data: bytes, n: int) -> np.ndarray:
    rows = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(rows.T).view(np.uint64).ravel(), dtype=np.uint64)


def among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values stand in ``some``, which is sorted."""
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _runs(marks: np.ndarray, least: int) -> np.ndarray:
    """Marks that stand in runs of ``least`` or more."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    out = np.zeros(len(marks), bool)
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        out[a:b] = b - a >= least
    return out


def unique_runs(pages: list[tuple[list[tuple[str, int]], list[int]]], covers: list[np.ndarray], depth: int) -> list[str]:
    """Text of each page: its marked articles that hold tokens that do not repeat across pages, complete; where none is
    marked, its blocks outside furniture without tokens that repeat."""
    out = []
    for (blocks, around), marks in zip(pages, covers, strict=True):
        sizes = np.array([text.count(" ") + 1 for text, _ in blocks], np.int64)
        ends = np.cumsum(sizes)
        repeats = np.add.reduceat(marks, ends - sizes, dtype=np.int64) == sizes if blocks else sizes
        unique = [(k, at) for k, ((_, at), r) in enumerate(zip(blocks, repeats.tolist(), strict=True)) if at >= 0 and not r]
        if len(around) > 1:
            found = set()
            for _, at in unique:
                while at and at not in found:  # and the articles around it
                    found.add(at)
                    at = around[at]
            out.append("\n".join(text for text, at in blocks if at > 0 and (at in found or not found)))
        else:
            kept = ((blocks[k][0].split(" "), marks[ends[k] - sizes[k] : ends[k]]) for k, _ in unique)
            out.append("\n".join(" ".join(w for w, c in zip(tokens, _runs(m, depth).tolist(), strict=True) if not c) for tokens, m in kept))
    return out


class Shard:
    """The distinct pages of one shard, with two hashes of each of their words."""

    def __init__(self, data: pa.Table):
        first: dict[bytes, int] = {}
        for i, (copy, n) in enumerate(zip(data["copy"].to_pylist(), data["size"].to_pylist(), strict=True)):
            if n is not None:
                first.setdefault(copy, i)
        self.copies = list(first)
        self.data = data.take(pa.array(list(first.values()), pa.int64()))
        self.raw = [pa.decompress(x, n, codec="zstd", asbytes=True) for x, n in zip(self.data["packed"].to_pylist(), self.data["size"].to_pylist(), strict=True)]
        self.numbers = np.unique(self.data["same"].to_pylist(), return_inverse=True)[1]
        text = np.frombuffer(b"".join(self.raw) or b" ", np.uint8)
        starts, ends, at = words(text, np.cumsum([0, *map(len, self.raw)]))
        self.sizes = np.diff(at)
        self.hashes = word_hashes(text, starts, ends), word_hashes(text, starts, ends, second=True)

    def streams(self) -> list[np.ndarray]:
        """Each page as numbers of words."""
        _, first, number = np.unique(self.hashes[0], return_index=True, return_inverse=True)
        if (self.hashes[1] != self.hashes[1][first][number]).any():  # words that share one hash
            number = np.unique(np.stack(self.hashes, axis=1), axis=0, return_inverse=True)[1].ravel()
        return np.split(number, np.cumsum(self.sizes)[:-1])

    def pages(self) -> list[tuple[list[tuple[str, int]], list[int]]]:
        rows = zip(self.raw, self.data["at"].to_pylist(), self.data["around"].to_pylist(), strict=True)
        return [(list(zip(x.decode().split("\n") if x else (), at, strict=True)), around) for x, at, around in rows]


DEALT = "url string, host string, packed binary, size int, at array<int>, around array<int>, same binary, copy binary"
SENT = "host string, part long, shard long, n int, codes binary"


def extract(pages: DataFrame, depth: int = 6, pages_needed: int = 3, shard_tokens: int = 262_144, broadcast_rows: int = 100_000) -> DataFrame:
    """(page_id, url, text, repeated) of every page; repeated: its tokens that the host's array covers."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("text"), host.alias("host"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, bytes]] = set()
        for part in portions(batches, "text"):
            got = [parse(x or "") for x in part.column(2).to_pylist()]
            raw = ["\n".join(t for t, _ in blocks).encode() for blocks, _ in got]
            same = [digest(x.replace(b"\n", b" ")) for x in raw]
            copy = [digest(x + f"\0{[at for _, at in blocks]}{around}".encode()) for x, (blocks, around) in zip(raw, got, strict=True)]
            keys = list(zip(part.column(3).to_pylist(), copy, strict=True))
            new = [not (k in seen or seen.add(k)) for k in keys]
            raw = [x if n else None for x, n in zip(raw, new, strict=True)]
            columns = {
                "packed": pa.array([x if x is None else pa.compress(x, codec="zstd", asbytes=True) for x in raw], pa.binary()),
                "size": pa.array([x if x is None else len(x) for x in raw], pa.int32()),
                "at": pa.array([[at for _, at in blocks] if n else None for (blocks, _), n in zip(got, new, strict=True)], pa.list_(pa.int32())),
                "around": pa.array([around if n else None for (_, around), n in zip(got, new, strict=True)], pa.list_(pa.int32())),
                "same": pa.array(same, pa.binary()),
                "copy": pa.array(copy, pa.binary()),
            }
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), *columns.values()], names=["page_id", "url", "host", *columns])

    def send(data: pa.Table) -> pa.Table:
        """Short codes of all substrings of a shard, each as often as it has distinct pages, up to ``pages_needed``."""
        shards, rows = data["shards"][0].as_py(), []
        if shards > 1:
            shard = Shard(data)
            starts, run = substrings(shard.streams(), depth)
            n = np.minimum(pages_with(shard.sizes, starts, run, shard.numbers), pages_needed)
            first = starts[np.append(True, run[1:] != run[:-1])[: len(run)]]
            codes, bits = short_codes(names(shard.hashes, depth, first)[:, 0], shards, shard_tokens)
            parts = max(1, shards // MEET)
            codes = np.sort(np.repeat(codes, n))
            pieces = np.split(codes, np.searchsorted(codes, np.array([(p << bits) // parts for p in range(1, parts)], np.uint64)))
            rows = [{"host": data["host"][0].as_py(), "part": p, "shard": data["shard"][0].as_py(), "n": len(x), "codes": squeezed(x)} for p, x in enumerate(pieces) if len(x)]
        return pa.Table.from_pylist(rows, pa.schema([("host", pa.string()), ("part", pa.int64()), ("shard", pa.int64()), ("n", pa.int32()), ("codes", pa.binary())]))

    def meet(data: pa.Table) -> pa.Table:
        """For each shard its codes that come ``pages_needed`` times or more from all shards of the host."""
        codes = [unsqueezed(x, n) for x, n in zip(data["codes"].to_pylist(), data["n"].to_pylist(), strict=True)]
        known, times = np.unique(np.concatenate(codes), return_counts=True)
        often = known[times >= pages_needed]
        mine = [np.unique(x[among(x, often)]) for x in codes]
        return pa.table({"host": data["host"], "part": data["part"], "shard": data["shard"], "n": pa.array(list(map(len, mine)), pa.int32()), "codes": pa.array(list(map(squeezed, mine)), pa.binary())})

    def count(data: pa.Table, often: pa.Table) -> pa.Table:
        """The pages of the shard that hold each substring whose code came often."""
        hashes, n = np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)
        if often.num_rows and data.num_rows:
            shard = Shard(data)
            some = np.sort(np.concatenate([unsqueezed(x, k) for x, k in zip(often["codes"].to_pylist(), often["n"].to_pylist(), strict=True)]))
            starts = every_start(shard.sizes, depth)
            hashes = names(shard.hashes, depth, starts)
            chosen = among(short_codes(hashes[:, 0], data["shards"][0].as_py(), shard_tokens)[0], some)
            hashes, run = np.unique(hashes[chosen], axis=0, return_inverse=True)
            order = np.argsort(run.ravel(), kind="stable")
            n = pages_with(shard.sizes, starts[chosen][order], run.ravel()[order], shard.numbers)
        hashes = hashes.view(np.int64)
        one = lambda c, kind: pa.repeat(pa.scalar(data[c][0].as_py() if len(hashes) else None, kind), len(hashes))
        return pa.table({"host": one("host", pa.string()), "shard": one("shard", pa.int64()), "h1": hashes[:, 0].copy(), "h2": hashes[:, 1].copy(), "n": n})

    def judge(data: pa.Table, often: pa.Table) -> pa.Table:
        shard = Shard(data)
        if data["shards"][0].as_py() == 1:
            starts, run = substrings(shard.streams(), depth)
            starts = starts[(pages_with(shard.sizes, starts, run, shard.numbers) >= pages_needed)[run]]
        else:
            starts = every_start(shard.sizes, depth)
            hashes = names(shard.hashes, depth, starts).view(np.int64)
            maybe = np.flatnonzero(among(hashes[:, 0], np.sort(often["h1"].to_numpy())))
            known = set(zip(often["h1"].to_pylist(), often["h2"].to_pylist(), strict=True))
            starts = starts[[i for i, x in zip(maybe.tolist(), map(tuple, hashes[maybe].tolist()), strict=True) if x in known]]
        covers = cover(shard.sizes, depth, starts)
        texts = unique_runs(shard.pages(), covers, depth)
        rows: dict[bytes, list] = {c: [] for c in shard.copies}
        for copy, page_id, url in zip(*(data[c].to_pylist() for c in ("copy", "page_id", "url")), strict=True):
            rows[copy].append({"page_id": page_id, "url": url})
        out = [(k, rows[c][i : i + COPIES]) for k, c in enumerate(shard.copies) for i in range(0, len(rows[c]), COPIES)]
        pairs = pa.list_(pa.struct([data.schema.field("page_id"), data.schema.field("url")]))
        return pa.table({"rows": pa.array([r for _, r in out], pairs), "text": pa.array([texts[k] for k, _ in out], pa.string()), "repeated": pa.array([int(covers[k].sum()) for k, _ in out], pa.int64())})

    work = Work(pages.sparkSession, "zstd")
    large = work.saved(rows.groupBy("host").agg(F.ceil(F.sum(F.octet_length("text")) / (TOKEN_BYTES * shard_tokens)).alias("shards")).where("shards > 1"))
    shards = F.broadcast(large) if large.count() <= broadcast_rows else large
    parsed = rows.mapInArrow(read, f"page_id {kind}, {DEALT}")
    # every step below reads this one shuffle of texts
    dealt = parsed.join(shards, "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1))).withColumn("shard", F.pmod(F.xxhash64("same"), "shards")).repartition("host", "shard")
    at = dealt.groupBy("host", "shard")
    met = at.applyInArrow(send, SENT).groupBy("host", "part").applyInArrow(meet, SENT)
    counted = at.cogroup(met.where("n > 0").groupBy("host", "shard")).applyInArrow(count, "host string, shard long, h1 long, h2 long, n long")
    often = counted.groupBy("host", "h1", "h2").agg(F.sum("n").alias("n"), F.collect_list("shard").alias("in")).where(F.col("n") >= pages_needed).select("host", F.explode("in").alias("shard"), "h1", "h2")
    judged = at.cogroup(often.groupBy("host", "shard")).applyInArrow(judge, f"rows array<struct<page_id: {kind}, url: string>>, text string, repeated long")
    return judged.select(F.explode("rows").alias("row"), "text", "repeated").select("row.*", "text", "repeated")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "repeated")

"""The training-data operators: against SQL, brute force, round trips and held-out labels, and on odd tables."""

import hashlib
import itertools
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewave.llm import jaccard, language, media, mixing, neighbours, pages, pieces, pii, quality, queries, substrings, tables
from tidewave.llm.common import sampled, utf8

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, size int, k1 string, score double, shard int"
LONG = " ".join(f"w{i}" for i in range(30000))
WORDS = re.compile("[^\x20\x09-\x0d]+")


def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    near = " ".join(f"n{i}" for i in range(100))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (None, "some words here to read", None, "a"), (4, LONG, "en", "b"), (5, near, "de", None), (6, near + " tail", "de", None), (6, near + " tail", "de", None), (7, "one two", "fr", "a"), (8, "one two", "fr", "c"), (9, "a" * 5000, "en", "c"), (10, "über 😀 ①   x@y.de +49 (30) 1234-5678 4111 1111 1111 1111 10.0.0.1", "de", "c"), (None, None, None, None)]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "n", 1, "k", 0.5, 3) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return odd_docs(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1


def literal_base(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    draw = random.Random(0)
    parts = ["a", "x.y", "@", "b-c.de", ".", "1", "25", "255", "256", "4111 1111 1111 1111", "+49", "(", ")", " ", "-", "٣", "é", "4111-1111", "00", "+"]
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 25)))
        assert pii.base_spans(text) == literal_base(text), text
    pii.base_spans("1" * 100_000 + "a" * 100_000 + "@" * 100)  # linear time


def test_network_gradient_and_variants(spark):
    texts = [f"Write to {n}.{i}@mail.example.com or call +1 ({200 + i}) 555-{1000 + i} from 10.2.{i}.{i} now" for i, n in enumerate(["ann", "bob", "carl", "dora"] * 30)]
    codes, tags = pii.examples(texts)
    start = pii.fit(codes[:64], tags[:64], epochs=1)
    _, g = start.gradient(codes[:8], tags[:8])
    for name, x in g.items():
        at = np.unravel_index(np.abs(x).argmax(), x.shape)
        sides = []
        for step in (0.01, -0.01):
            p = {**start.p, name: start.p[name].copy()}
            p[name][at] += step
            sides.append(pii.Tagger(p).gradient(codes[:8], tags[:8])[0])
        assert abs((sides[0] - sides[1]) / 0.02 - x[at]) < 0.02 * abs(x[at]) + 1e-3
    tagger = pii.fit(codes, tags, epochs=8)
    found = pii.find_all(tagger, ["Please reach eve.7 at mail.example.com today", "Version 2.0 of 1999 has no such thing", ""])
    assert found[1] == found[2] == []
    docs = spark.createDataFrame([(1, texts[0]), (2, None)], "doc_id long, text string")
    out = {r["doc_id"]: r["t"] for r in docs.select("doc_id", pii.redact_column(tagger).alias("t")).collect()}
    assert out[2] is None and "[EMAIL]" in out[1] and "@" not in out[1] and "[PHONE]" in out[1] and "[IP]" in out[1]



def test_spelled_addresses_without_digits_are_found(spark):
    for name, sign, host in itertools.product(("anna.berg", "a-very-long-name.with.parts.of.more.than.forty.characters"), (" at ", " (at) ", "[at]", " AT "), ("example dot org", "mail[dot]example.com")):
        text = f"{'some words ' * 20}{name}{sign}{host}{' other words' * 20}"
        assert any(a <= text.index(name) and text.index(host) + len(host) <= b for a, b in pii.regions_of(text))
    assert pii.regions_of("") == pii.regions_of("no such sign here, that data") == []
    draw = random.Random(0)
    words = "we looked at the river and some of them came home late while others read at night or went out again".split()
    some = lambda n: " ".join(draw.choice(words) for _ in range(n))
    texts = [f"{some(40)} {draw.choice(words)}.{i}@mail.example.com {some(40)} 10.2.{i}.{i} {some(40)}" for i in range(300)]
    tagger = pii.fit(*pii.examples(texts))
    address = "anna.berg at example dot org"
    many = [f"{some(6)} {address} {some(6)}" for _ in range(10)]
    found = pii.find_all(tagger, many)
    assert sum(any(k == "email_like" and t[a:b] == address for k, a, b in f) for t, f in zip(many, found, strict=True)) >= 7
    assert sum(map(len, pii.find_all(tagger, [some(60) for _ in range(20)]))) == 0
    rows = spark.createDataFrame([(t,) for t in many], "text string").select(pii.redact_column(tagger).alias("t")).collect()
    assert sum("[EMAIL]" in r["t"] for r in rows) >= 7


def test_personal_data_of_odd_rows(spark, docs, empty, tmp_path):
    """The query's own columns, against the patterns, on rows of every odd kind and on an empty table."""
    for name, d in (("odd", docs), ("empty", empty)):
        d.write.parquet(str(tmp_path / name / "documents.parquet"))
    rows = queries.QUERIES["op1_pii"](spark, str(tmp_path / "odd")).collect()
    assert len(rows) == 13 and queries.QUERIES["op1_pii"](spark, str(tmp_path / "empty")).count() == 0
    want = Counter()
    for r in docs.collect():
        base = literal_base(r["text"] or "")
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        n = Counter(k for k, _, _ in base)
        want[r["doc_id"], *(n[k] for k in pii.KINDS), hashlib.sha256(said.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows) == want
    for r in rows:
        own = [x for x in r["spans"].split(",") if x and not x.partition(":")[0].endswith("_like")]
        assert hashlib.sha256(",".join(own).encode()).hexdigest() == r["base_sha256"] and r["spans"].startswith(",".join(own))


def test_samples_are_bounded_and_not_filled_by_copies(spark):
    """One doc_id, or one text, that stands in most rows takes one place of the sample."""
    some = [("und", "und dann gingen wir nach Hause und schliefen gut"), ("the", "and then we went to our home and slept very well")]
    rows = [(1, some[1][1], "en")] * 5000 + [(i, f"{some[i % 2][1]} {i}", ("de", "en")[i % 2]) for i in range(2, 300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(40)
    model = language.train(d, per_lang=20)
    assert sorted(k for _, members in model.families for k in members) == ["de", "en"]
    for by in (None, "lang"):
        got = sampled(d.select("doc_id", "lang"), F.col("doc_id"), 50, by=by).collect()
        assert len({r["doc_id"] for r in got}) == len(got) <= 50 * (2 if by else 1) and len(got) >= 45
    assert sampled(d.limit(0), F.col("doc_id"), 5).count() == 0


# 2


def test_cosine_hash_by_its_definition():
    r = np.random.default_rng(0)
    for shape in ((32, 32), (64, 96), (7, 64)):
        image = r.integers(0, 256, shape, np.uint8)
        cells = np.empty((32, 32))
        rows, cols = ([range(i * n // 32, max(i * n // 32 + 1, (i + 1) * n // 32)) for i in range(32)] for n in shape)
        for i, j in itertools.product(range(32), range(32)):
            cells[i, j] = np.mean([int(image[a, b]) for a in rows[i] for b in cols[j]])
        low = [sum(cells[x, y] * math.cos(math.pi * u * (2 * x + 1) / 64) * math.cos(math.pi * v * (2 * y + 1) / 64) for x in range(32) for y in range(32)) for u in range(8) for v in range(8)]
        middle = float(np.median(low[1:]))
        bits = "".join("1" if x > middle + 1e-6 else "0" for x in low)
        got = bin(int(media.dct_hash(image), 16))[2:].zfill(64)
        assert sum(a != b for a, b in zip(bits, got, strict=True)) <= 1


def test_png_round_trip_filters_and_damage():
    r = np.random.default_rng(0)
    for n in (64, 640, 64 * 100):
        payload = r.integers(0, 256, n, np.uint8).tobytes()
        for kind in (None, 0, 1, 2):
            blob = media.encode_png(payload, filter_type=kind)
            assert media.decode_png(blob).tobytes() == payload
        for at in range(0, len(blob), 17):
            bad = blob[:at] + bytes([blob[at] ^ 1]) + blob[at + 1 :]
            with pytest.raises(media.MediaError):
                media.decode_png(bad)
    # filters 3 and 4, forward by definition
    image = r.integers(0, 256, (9, 64)).astype(int)
    raw = np.empty((9, 65), np.uint8)
    for i in range(9):
        kind = raw[i, 0] = i % 5
        for j in range(64):
            left, up, corner = image[i, j - 1] if j else 0, image[i - 1, j] if i else 0, image[i - 1, j - 1] if i and j else 0
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            raw[i, j + 1] = (image[i, j] - [0, left, up, (left + up) // 2, paeth][kind]) & 255
    assert (media.unfilter(raw) == image).all()


def test_media_of_odd_rows(docs, empty):
    rows = media.features(media.store(docs)).collect()
    assert len(rows) == 13
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add(tuple(r)[1:])
    assert len(by[6]) == 1 and next(iter(by[2]))[:2] == (0, 64) and next(iter(by[1])) == next(iter(by[2]))
    (n, padded, sha, tail, *_), = by[7]
    payload = b"one two" + bytes(57)
    assert (n, padded, sha, tail) == (7, 64, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload))
    assert media.features(media.store(empty)).count() == 0


# 3


def test_neighbours_recall_ties_and_odd_rows(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((1500, 16)) * r.uniform(0.2, 3, (1500, 1))
    x[100:300] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(40, x[40].tolist(), 1), (None, x[1].tolist(), 1), (2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] + [1.0] * 15, 1), (2060, [None] + [1.0] * 15, 1), (2080, [1.0, 2.0], 1), (2100, [2.0, 1.0], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for q in sorted(neighbours.nearest(v, v.where("vec_id % 20 = 0"), shard_rows=400).collect(), key=lambda q: (q["query_id"], q["rank"])):
        got[q["query_id"]].append((q["vec_id"], q["score"]))
    ids = np.array([*range(1500), 40])
    every = np.concatenate([x, x[40:41]])
    hit = total = 0
    for q in range(0, 1500, 20):
        s = every @ x[q]
        keep = np.ones(len(ids), bool)
        keep[q] = False
        order = np.lexsort((ids[keep], -np.round(s[keep], 9)))[:20]
        want = ids[keep][order].tolist()
        hit += len(set(want) & {i for i, _ in got[q]})
        total += 20
        assert len(got[q]) == 20 and all(abs(sc - every[np.flatnonzero(ids == i)[0]] @ x[q]) < 1e-9 for i, sc in got[q])
    assert hit / total >= 0.9
    assert [i for i, _ in got[120]][:5] == sorted(i for i, _ in got[120])[:5]
    assert got[2080] == [(2100, 4.0)] and not {2000, 2020, 2040, 2060} & set(got)
    assert 40 in [i for i, _ in got[40]]
    assert neighbours.nearest(v.limit(0), v.limit(0)).count() == 0


# 4


def test_pages(spark):
    boiler = "Subscribe to our weekly letter and never miss a story again"
    rows = [(i, "http://a.example/x", f"<html><body><div>{boiler}</div><div>Own text number {i} of this page only k{i} m{i}<p>More of {i}</div><script>var a='</p>';</script></body></html>") for i in range(6)]
    rows += [(10, "http://b.example/", "<html><nav><li>Menu</nav><article><header><h1>T &amp; U</h1></header><p>First\n  line<p>Second &#233; &lt;b&gt;<div class='user-comments'>bad</div><aside>bad</aside></article><footer>bad</footer>"), (11, None, None), (11, None, ""), (12, "x", "plain text only"), (13, "x", "<p>a<br>b</p><p hidden>no</p><form>no</form><b>c"), (14, "y", "<article>" + "<p>long words here</p>" * 3000)]
    d = spark.createDataFrame([(*r, "t", 0) for r in rows], "page_id long, url string, html string, text string, blocks int")
    got = defaultdict(list)
    for r in pages.extract(d).collect():
        got[r["page_id"]].append(r["text"])
    assert got[0] == ["Own text number 0 of this page only k0 m0\nMore of 0"]
    assert got[10] == ["T & U\nFirst line\nSecond é <b>"] and got[11] == ["", ""] and got[12] == ["plain text only"] and got[13] == ["a\nb\nc"]
    assert got[14][0].count("\n") == 2999 and sum(map(len, got.values())) == len(rows)
    assert pages.extract(d.limit(0)).count() == 0


def test_pages_of_a_large_host_equal_one_shard(spark):
    notice = "This section moves to another address at the end of the year"
    html = lambda i: f"<div>Page {i} alone says a{i} b{i} c{i}</div>" + (f"<div>{notice}</div>" if i % 60 == 0 else "")
    d = spark.createDataFrame([(i, f"http://a.example/{i}", html(i)) for i in range(1200)], "page_id long, url string, html string")
    one, many = ({r["page_id"]: r["text"] for r in pages.extract(d, shard_tokens=n).collect()} for n in (10**6, 300))
    assert one == many and many == {i: f"Page {i} alone says a{i} b{i} c{i}" for i in range(1200)}


def test_copies_of_a_page_are_one_page(spark):
    text = "These words stand in copies of one page and nowhere else at all"
    notice = "All rights to the pages of this address are reserved"
    rows = [(1, "http://a.example/1", f"<div>{text}</div>")] * 3 + [(i, f"http://a.example/{i}", f"<p>{text}</p>") for i in (2, 3, 4)]
    rows += [(i, f"http://b.example/{i}", f"<article>Article {i}</article><footer>{notice}</footer>") for i in (5, 6)] + [(7, "http://b.example/7", f"<p>Seventh</p><p>{notice}</p>")]
    for n in (10**6, 20):
        got = sorted((r["page_id"], r["text"]) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), shard_tokens=n, broadcast_rows=n).collect())
        assert got == [(1, text)] * 3 + [(i, text) for i in (2, 3, 4)] + [(5, "Article 5"), (6, "Article 6"), (7, "Seventh")]


def test_unique_runs_decide_on_marked_pages(spark):
    """Marked articles whose text repeats on the host go where another has unique runs; an article found is complete."""
    story = "The mayor opened the new bridge over the river on Sunday morning"
    quote = "We shall never close a bridge again said the mayor of the town"
    page = lambda i, inner: (i, f"http://a.example/{i}", f"<nav>Home News</nav>{inner}<footer>All rights to the pages of this address are reserved</footer>")
    own = lambda i: f"<h1>Title {i}</h1><p>Own words {i} a{i} b{i}</p><p>{quote}</p>"
    teaser = f"<article><h2>{story}</h2></article>"
    rows = [page(i, f"<main><article>{own(i)}</article>{teaser}</main>") for i in range(4)]
    rows += [page(i, f"<article>{own(i)}{teaser}</article>") for i in range(4, 8)]  # within another
    rows += [page(i, f"<div><article><p>{quote}</p></article></div><p>Footnote {i}</p>") for i in range(8, 12)]  # none is unique
    rows += [page(i, f"<main><p>{quote}</p><article><p>Own words {i} c{i}</p></article></main>") for i in range(12, 14)]  # around one that is
    mine = lambda i: f"Title {i}\nOwn words {i} a{i} b{i}\n{quote}"
    want = {i: mine(i) for i in range(8)} | {i: quote for i in range(8, 12)} | {i: f"{quote}\nOwn words {i} c{i}" for i in range(12, 14)}
    for n in (10**6, 20):
        got = pages.extract(spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string"), shard_tokens=n).collect()
        assert len(got) == 15 and all(r["text"] == want[r["page_id"]] and r["repeated"] >= 13 for r in got)


def test_repeated_tokens_do_not_depend_on_shards(spark):
    """All words of a page count, those of its article too: against a plain count of substrings on three pages."""
    draw = random.Random(2)
    texts = [" ".join(str(draw.randint(0, 2)) for _ in range(draw.randint(0, 60))) for _ in range(60)]
    found = defaultdict(set)
    for t in texts:
        for k in range(len(w := t.split()) - 5):
            found[tuple(w[k : k + 6])].add(t)
    rows = [(i, "http://a.example/", f"<article>{t}</article>") for i, t in enumerate(texts)]
    for n in (10**6, 100, 10):
        for r in pages.extract(spark.createDataFrame(rows + rows[:9], "page_id long, url string, html string"), shard_tokens=n, broadcast_rows=n - 100).collect():
            w = texts[r["page_id"]].split()
            hot = {k + j for k in range(len(w) - 5) if len(found[tuple(w[k : k + 6])]) >= 3 for j in range(6)}
            assert r["repeated"] == len(hot) and r["text"] == texts[r["page_id"]]


def test_squeezed_codes_come_back():
    for codes in ([], [0], [5, 5, 5], [0, 1, 2**62, 2**62, 2**63 - 1], sorted(random.Random(0).randrange(2**40) for _ in range(1000))):
        codes = np.array(codes, np.uint64)
        assert (pages.unsqueezed(pages.squeezed(codes), len(codes)) == codes).all()


def test_suffix_array_is_sorted_with_longest_common_prefixes():
    draw = random.Random(1)
    for _ in range(200):
        streams = [[draw.randint(0, 2) for _ in range(draw.randint(0, 30))] for _ in range(4)] + [[7, 8] * 9] * 2
        suffixes = [s[k:] for s in streams for k in range(len(s))]
        order, common, left = pages.suffix_array(streams)
        ordered = [suffixes[i] for i in order]
        assert ordered == sorted(suffixes) and [len(x) for x in suffixes] == left.tolist()
        for k in range(1, len(ordered)):
            a, b = ordered[k - 1], ordered[k]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_parser_is_linear_in_odd_pages():
    for part in ("</b>", "<b>", "<!", "<!--", "<a '", '<a ">', "<a '\">", "<p", "<div></p>", "<script>", "&amp"):
        took = []
        for n in (20_000, 80_000):
            began = time.process_time()
            pages.parse("<div>" + part * n)
            took.append(time.process_time() - began)
        assert took[1] < 12 * took[0] + 0.1, part


def test_suffix_array_finds_the_article_without_marks(spark, sf):
    """On the given pages with all marks of articles and furniture taken away, host by host."""
    given = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet").collect()]
    furniture = "<div>Read the terms of use of this site before you write to us</div>"
    bare = [(i, "http://one.example/", furniture + re.sub(r"</?(article|nav|footer|header)[^>]*>", " ", h.partition("<article>")[2].partition("</article>")[0]) + furniture) for i, _, h in given]
    d = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {r["page_id"]: r["text"] for r in pages.extract(d(given)).collect()}
    kept = total = 0
    for r in pages.extract(d(bare), pages_needed=20).collect():
        assert "terms of use" not in r["text"]
        a, b = Counter(WORDS.findall(want[r["page_id"]])), Counter(WORDS.findall(r["text"]))
        kept += (a & b).total()
        total += max(a.total(), b.total())
    assert kept / total > 0.95


def test_suffix_array_equals_brute_force():
    draw = random.Random(0)
    for _ in range(200):
        streams = [[draw.randint(0, 2) for _ in range(draw.randint(0, 25))] for _ in range(4)]
        found = defaultdict(set)
        for i, s in enumerate(streams):
            for k in range(len(s) - 4):
                found[tuple(s[k : k + 5])].add(i)
        for i, (s, mine) in enumerate(zip(streams, pages.covered(streams, 5, 3), strict=True)):
            want = np.zeros(len(s), bool)
            for k in range(len(s) - 4):
                if len(found[tuple(s[k : k + 5])]) >= 3:
                    want[k : k + 5] = True
            assert (mine == want).all()


# 5


def test_language(spark, sf, docs, empty):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    out = queries.QUERIES["op5_language_id"](spark, sf).join(d.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) >= 0.95 and all(0 <= r["score"] <= 1 for r in out)
    model = language.train(d)
    odd = {r["doc_id"]: r["p"] for r in docs.select("doc_id", language.language_columns(model).alias("p")).collect()}
    assert odd[4]["lang"] in ("en", "de", "fr", "es")
    assert docs.select(language.language_columns(language.train(empty)).alias("p")).where("p.lang <> 'und'").count() == 0
    data, offsets = utf8(__import__("pyarrow").array(["abc", "", "xyz"]))
    whole, at = language.grams(data, offsets)
    alone, _ = language.grams(*utf8(__import__("pyarrow").array(["xyz"])))
    assert (whole[at[2] : at[3]] == alone).all()


def test_language_margins_equal_plain_sums():
    """Votes of weights summed n-gram by n-gram over plain strings, on texts of one and two bytes a letter."""
    r = np.random.default_rng(0)
    texts = ["Hello, World 12 times", "Über die Brücke", "a", "  x  ", "ça et là, é"]
    every, begin = language.grams(*utf8(__import__("pyarrow").array(texts)))
    for i, text in enumerate(texts):
        raw = " " + "".join(c if c.isalpha() else " " * len(c.encode()) for c in text.lower())
        code = [b for b in raw.encode()]
        want = []
        for k in range(len(code)):
            for n, blank in ((1, b" "), (2, b"  "), (3, b"   ")):
                gram = bytes(code[max(0, k - n + 1) : k + 1])
                value = int.from_bytes(gram, "big") if len(gram) == n else int.from_bytes(b" " * (n - len(gram)) + gram, "big")
                if len(gram) < n:
                    value = int.from_bytes(gram, "big")
                number = ((value * 2654435761 + (n - 1) * 0x9E3779B1) & 0xFFFFFFFF) >> 20
                want.append(0 if set(gram) == {32} else number)
        assert every[begin[i] : begin[i + 1]].ravel().tolist() == want, text
    weights = r.normal(0, 1, (language.DIM + 1, 4))
    m = language.Hierarchy((("germanic", ("de", "en")), ("romance", ("es", "fr"))), weights)
    langs, scores = m.predict(*utf8(__import__("pyarrow").array(texts)))
    for i in range(len(texts)):
        x = [int(v) for v in every[begin[i] : begin[i + 1]].ravel() if v]
        margin = [sum(weights[v, j] for v in x) / max(1, len(x)) + weights[-1, j] for j in range(4)]
        top = 0 if margin[0] >= margin[1] else 1
        pair = margin[2 + top]
        assert langs[i] == m.families[top][1][0 if pair >= 0 else 1]
        chance = lambda d: 1 / (1 + math.exp(-3 * d))
        assert abs(scores[i] - chance(margin[top]) * (chance(pair) if pair >= 0 else 1 - chance(pair))) < 1e-5


# 6


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library(model):
    import sentencepiece

    sp, own = sentencepiece.SentencePieceProcessor(model_file=model), pieces.load(pieces.model_bytes(model))
    draw = random.Random(0)
    texts = ["", " ", "▁", "▁ ▁a", "a" * 3000, "the " * 50, "\n\n", LONG[:5000]] + ["".join(draw.choice("ab the  \n\t▁ée中文ﬁ①🎉​\x00 .,xyz<0x0A></s>1234  ") for _ in range(draw.randint(1, 100))) for _ in range(1500)]
    for text, (ids, offsets) in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == [*sp.encode(text), 2] and own.decode(ids.tolist()) == sp.decode(ids.tolist())
        raw = text.encode()
        assert offsets[0] == 0 and offsets[-1] == len(raw) and (np.diff(offsets) >= 0).all()
        for i, a, b in zip(ids.tolist(), offsets, offsets[1:], strict=False):
            piece = own.surface[i] if own.kinds[i] != pieces.CONTROL else b""
            assert raw[a:b] == piece or raw[a:b].replace("▁".encode(), b" ") in (piece, piece[1:])
    for _ in range(1000):
        ids = [draw.choice([0, 1, 2, 3 + draw.randrange(256), 259, draw.randrange(32000)]) for _ in range(draw.randint(0, 8))]
        assert own.decode(ids) == sp.decode(ids)


def test_character_map_takes_the_longest_key():
    """A double array built by hand for keys a -> x, ab -> yz, with replacements behind it."""
    units = [0] * 1024
    step = lambda base: base << 10
    units[0] = step(256)
    a = 256 ^ ord("a")
    units[a] = step(a ^ 512) | ord("a") | 256  # has a value at 512
    units[512] = 0x80000000 | 0
    b = 512 ^ ord("b")
    units[b] = step(b ^ 768) | ord("b") | 256
    units[768] = 0x80000000 | 2
    blob = struct.pack("<I", 4096) + struct.pack("<1024I", *units) + b"x\0yz\0"
    found = pieces.CharacterMap(blob)
    assert found.longest(b"abc", 0) == (2, b"yz") and found.longest(b"aab", 0) == (1, b"x") and found.longest(b"c", 0) is None
    m = object.__new__(pieces.PieceModel)
    m.charmap, m.dummy, m.squeeze, m.escape = found, True, True, True
    text, align = m.normalise("  ab  ca ")
    assert text == "▁yz▁cx" and align.tolist() == [2, 2, 2, 2, 2, 4, 4, 4, 6, 7, 8]


def test_pieces_of_odd_rows(docs, empty, model):
    blob = pieces.model_bytes(model)
    rows = {(r["doc_id"], r["decoded"]) for r in pieces.encode(docs, blob).collect()}
    assert {(r["doc_id"], r["text"] or "") for r in docs.collect()} == rows
    assert pieces.digests(empty, blob).count() == 0


# 7


def test_chain_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    x, first = r.standard_normal((9, 3)), np.array([0, 4, 5])
    m = quality.ChainModel(r.standard_normal(3), r.standard_normal((2, 2)))
    good, _ = m.marginals(x, first)
    for a, b in zip(first, [4, 5, 9], strict=True):
        z, p = 0.0, np.zeros(b - a)
        for states in itertools.product((0, 1), repeat=b - a):
            w = math.exp(sum((x[a + i] @ m.weights) * (s - 0.5) for i, s in enumerate(states)) + sum(m.links[s, t] for s, t in itertools.pairwise(states)))
            z += w
            p += w * np.array(states)
        assert np.allclose(good[a:b], p / z)


def test_quality_scores_equal_enumeration():
    """A document's score from all state sequences of its lines, weighted by line lengths."""
    r = np.random.default_rng(1)
    m = quality.ChainModel(r.standard_normal(3 * quality.N_OWN + 1), r.standard_normal((2, 2)), (0.3, 1.7))
    texts = ["One line of words.", "FIRST $$$ line\nsecond, longer line of text\n\n12 34", "", "a\n"]
    got = m.scores(*utf8(__import__("pyarrow").array(texts)))
    for text, score in zip(texts, got, strict=True):
        lines = text.split("\n")
        x, n, _ = quality.line_features(*utf8(__import__("pyarrow").array([text])))
        assert len(x) == len(lines) and n.tolist() == [max(1, len(t)) for t in lines]
        z, good = 0.0, np.zeros(len(lines))
        for states in itertools.product((0, 1), repeat=len(lines)):
            w = math.exp(sum(float(x[i] @ m.weights) * (s - 0.5) for i, s in enumerate(states)) + sum(m.links[a, b] for a, b in itertools.pairwise(states)))
            z += w
            good += w * np.array(states)
        share = min(0.999, max(0.001, float((good / z * n).sum() / n.sum())))
        assert abs(score - 1 / (1 + math.exp(-(0.3 + 1.7 * math.log(share / (1 - share)))))) < 1e-9


def test_quality(spark, sf, docs, empty):
    big = sf.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    out = queries.QUERIES["op7_quality"](spark, big).join(labels, "doc_id").where("held_out AND quality IS NOT NULL").collect()
    assert out and sum(r["predicted"] == r["quality"] for r in out) / len(out) >= 0.95
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = [(r["doc_id"], r["s"]) for r in docs.select("doc_id", quality.score_column(model).alias("s")).collect()]
    assert len(rows) == 13 and all(0 <= s <= 1 for _, s in rows) and dict(rows)[1] == dict(rows)[2]
    flat = quality.train(empty, labels)
    assert {r["s"] for r in docs.select(quality.score_column(flat).alias("s")).collect()} == {0.5}


# 8


def brute_links(rows):
    sets = []
    for _, t in rows:
        w = WORDS.findall(t or "")
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    n, root = Counter(), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and both * 5 >= 4 * (len(sets[i]) + len(sets[j]) - both):
            n[i] += 1
            n[j] += 1
            root[find(j)] = find(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted((str(d), str(low.get(find(i), d)) if sets[i] else str(d), n[i]) for i, (d, _) in enumerate(rows))


def test_jaccard_equals_brute_force(spark, docs, empty):
    draw = random.Random(0)
    base = [f"v{draw.randrange(500)}" for _ in range(120)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(None, f"{' '.join(base)} null{i}") for i in range(3)] + [(77, f"{' '.join(base)} id{i}") for i in range(3)] + [(None, " ".join(f"z{k}" for k in range(40)))] * 2
    for i in range(150):
        w = list(base) if i < 90 else [f"u{i % 9}_{k}" for k in range(30)]
        for _ in range(draw.randint(0, 4)):
            w[draw.randrange(len(w))] = f"x{draw.randrange(10**6)}"
        rows.append((100 + i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["links"]) for r in jaccard.join(d, small=8, block_rows=16, block_weight=2000).collect())
    assert got == brute_links(rows)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, None, None, 4, 5, 7, 9, 10]))
    assert jaccard.join(empty).count() == 0


def test_one_of_each_where_doc_ids_repeat(spark):
    some = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(1, some("a")), (1, some("b")), (1, some("b")), (2, some("b") + " tail"), (2, some("c")), (3, ""), (3, some("d")), (4, some("d"))]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted([(1, some("a")), (1, some("b")), (2, some("c")), (3, ""), (3, some("d"))])


def test_one_of_each_shuffles_no_text(spark):
    """Ids that go are broadcast to the texts; where they are too many, the rows are the same."""
    words = lambda c, n: " ".join(f"c{c}_{k}" for k in range(n))
    rows = [(i, words(i % 40, 60) + (" more" if i >= 80 else ""), "s") for i in range(120)] + [(None, words(0, 60), "s"), (200, None, "t"), (201, "", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        few, many = jaccard.one_of_each(docs), jaccard.one_of_each(docs, broadcast_rows=0)
        plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan(few) and "Exchange hashpartitioning" in plan(many)
        for kept in (few, many):
            assert kept.columns == docs.columns
            assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in rows if r[0] is None or r[0] < 40 or r[0] >= 200), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_small_tables_of_near_duplicates_take_few_files(spark, monkeypatch):
    """However many partitions a session has: each local file that an executor writes costs it processes of its own."""
    words = lambda c, n: " ".join(f"c{c}_{k}" for k in range(n))
    docs = spark.createDataFrame([(i, words(i % 100, 60) + " more" * (i // 100)) for i in range(300)], "doc_id long, text string")
    saved, files = tables.Work.saved, []

    def counted(self, *args):
        out = saved(self, *args)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(tables.Work, "saved", counted)
    given = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in given}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        assert sorted(r["doc_id"] for r in jaccard.one_of_each(docs).collect()) == list(range(100))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 10 and sum(files) < 5 * len(files), files


def test_workers_give_memory_back():
    """Freed memory goes back to the system also where something above it is still held."""
    from tidewave.llm.common import portions

    held = lambda: int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) // 1024
    many = [bytes(50_000) + bytes([i % 256]) for i in range(4000)]
    kept = many[1::2][-1:]
    before = held()
    del many
    assert len(list(portions(iter([pa.record_batch([pa.array(["some text"])], names=["text"])]), "text"))) == 1
    assert before - held() > 150 and len(kept) == 1


def test_encoding_without_decoding_gives_the_same_ids(spark, docs):
    import public_tokenizers

    blob = pieces.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    rows = docs.select("doc_id", "text")
    whole, ids = pieces.encode(rows, blob), pieces.encode(rows, blob, decode=False)
    assert ids.columns == ["doc_id", "ids", "offsets"]
    assert sorted(ids.collect(), key=str) == sorted(whole.drop("decoded").collect(), key=str)


def test_least_matches_bounds_the_posterior():
    t, tolerance = 0.8, 1e-6
    for k, least in enumerate(jaccard.least_matches(tolerance)):
        n = 16 * (k + 1)
        grid = np.linspace(0, 1, 200_001)
        for m, above in ((least, True), (least - 1, False)):
            if m < 0:
                continue
            density = grid**m * (1 - grid) ** (n - m)
            assert (density[grid >= t].sum() / density.sum() >= tolerance) == above


# 9


def test_mixing_equals_sql_and_keeps_its_word(spark, duck, sf, docs, empty):
    got = queries.QUERIES["op9_mixing"](spark, sf)
    rows = sorted(map(tuple, got.select("doc_id", "size", "source_size", "target", "taken", "draws").collect()))
    assert rows == sorted(duck.execute(f"SELECT doc_id, size, source_size, target, taken, draws FROM ({mixing.OP9_SQL})").fetchall())
    odd = mixing.assign(docs, ["source"])
    out = odd.groupBy("_source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 1 and r["target"] <= 2 * r["size"] for r in out) and odd.count() == 13
    assert odd.where("taken > 2 * size").count() == 0
    mixed = mixing.mix(docs, whole=False)
    assert set(docs.columns) < set(mixed.columns)
    words = mixed.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert words == odd.agg(F.sum("taken")).first()[0]
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs, whole=False).collect()))
    assert mixing.mix(empty).count() == 0


def test_mixing_of_whole_documents(spark, sf, docs):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    plan = mixing.assign(d, ["source"], whole=True).groupBy("_source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("longest"), F.max(F.col("taken") % F.greatest(F.col("size"), F.lit(1))).alias("parts")).collect()
    assert all(abs(r["taken"] - r["target"]) <= r["longest"] / 2 + 1 and r["parts"] == 0 for r in plan)
    texts = {r["text"] for r in docs.collect()}
    assert all(r["text"] in texts for r in mixing.mix(docs).collect())


def test_splitting_tree_is_hypergeometric(spark):
    """Counts add up at every node, and their mean and spread over seeds are those of drawing without replacement."""
    quotas = {"a": 70, "b": 25, "c": 4, "d": 0, "e": 101}
    d = spark.createDataFrame(list(quotas.items()), "skey string, quota long")
    got = defaultdict(list)
    for seed in range(12):
        rows = {r["skey"]: r["counts"] for r in mixing.leaves(d, 4, seed, groups=1 + seed % 3).collect()}
        assert {k: sum(v) for k, v in rows.items()} == {k: q for k, q in quotas.items() if q}
        assert [sum(v[i] for v in rows.values()) for i in range(4)] == [50] * 4
        for k, v in rows.items():
            got[k] += v
    for k, v in got.items():
        p = quotas[k] / 200
        sd = math.sqrt(50 * p * (1 - p) * 150 / 199)
        assert abs(np.mean(v) - 50 * p) < 1e-9 and 0.6 < np.std(v) / sd < 1.4
    u = spark.range(20_000).select(mixing._draw(F.lit(20), F.lit(8), F.lit(7), (F.col("id") + 0.5) / 20_000).alias("k")).groupBy("k").count().collect()
    for r in u:
        assert abs(r["count"] / 20_000 - math.comb(8, r["k"]) * math.comb(12, 7 - r["k"]) / math.comb(20, 7)) < 1e-3
    assert sum(r["count"] for r in u) == 20_000 and mixing.leaves(d.where("quota < 0"), 4).count() == 0


def test_targets_by_rounds(spark):
    """The closed form against capping and sharing anew until nothing is above."""
    draw = random.Random(0)
    for _ in range(3):
        sizes = [draw.choice([1, 10, 1000, 50000]) * draw.randint(1, 9) for _ in range(9)]
        weights = [(5, 2, 1)[i % 3] for i in range(9)]
        target, left, open_ = [0.0] * 9, 1.5 * sum(sizes), set(range(9))
        while True:
            level = left / sum(weights[i] for i in open_)
            over = {i for i in open_ if level * weights[i] > 2 * sizes[i]}
            for i in over or open_:
                target[i] = 2.0 * sizes[i] if over else level * weights[i]
            if not over:
                break
            open_ -= over
            left -= sum(2 * sizes[i] for i in over)
        d = spark.createDataFrame([(str(i), str(i), s) for i, s in enumerate(sizes)], "skey string, source string, source_size long")
        got = {int(r["skey"]): r["target"] for r in mixing.source_targets(d).collect()}
        assert all(abs(got[i] - target[i]) < 1e-6 * max(1, target[i]) for i in range(9))


# 10


def brute_removed(rows, span):
    each = [WORDS.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[k : k + span]) for w in each for k in range(len(w) - span + 1))
    out = []
    for (d, _), w in zip(rows, each, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - span + 1):
            if seen[tuple(w[k : k + span])] > 1:
                gone[k : k + span] = [True] * span
        out.append((str(d), len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def test_substrings_equal_brute_force(spark, docs, empty):
    draw = random.Random(0)
    passages = [[f"p{k}_{i}" for i in range(60)] for k in range(3)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for i in range(120):
        w = [draw.choice(["the", "a", f"q{draw.randrange(40)}"]) for _ in range(draw.randint(0, 90))]
        if i % 3 == 0:
            p = draw.choice(passages)
            a = draw.randint(0, 30)
            at = draw.randint(0, len(w))
            w[at:at] = p[a : a + draw.randint(20, 60)]
        if i % 10 == 0:
            w += ["same"] * draw.randint(30, 80)
        rows.append((100 + i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove(d).collect()) == brute_removed(rows, 35)
    assert substrings.remove(empty).count() == 0


# The pipeline


def test_pipeline_equals_brute_force(spark, sf, model):
    """Each stage over all that the one before kept, against a plain version of it."""
    import corpus_pipeline as p
    import sentencepiece

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, kept = docs, []
    for name, stage in p.STAGES[:-1]:
        before = stage(spark, before, sf).cache()
        assert before.columns == docs.columns, name
        kept.append(before.collect())
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet")).scores(*utf8(__import__("pyarrow").array(list(rows.values()))))
    assert {r["doc_id"] for r in kept[0]} == {i for i, x in zip(rows, scores, strict=True) if x >= quality.THRESHOLD}
    linked = brute_links([(r["doc_id"], r["text"]) for r in kept[0]])
    assert {str(r["doc_id"]) for r in kept[1]} == {c for _, c, _ in linked}
    redacted = {r["doc_id"]: r["text"] for r in kept[2]}
    for r in kept[1]:
        assert set(WORDS.findall(redacted[r["doc_id"]])) <= {*WORDS.findall(r["text"])} or literal_base(r["text"]) or "[" in redacted[r["doc_id"]]
        assert not literal_base(redacted[r["doc_id"]]) and r["n_chars"] == len(r["text"])
        assert len(redacted[r["doc_id"]]) == len(r["text"]) or "[" in redacted[r["doc_id"]]
    taken = Counter()
    for r in kept[3]:
        assert redacted[r["doc_id"]] == r["text"] and r["n_chars"] == len(r["text"])
        taken[r["source"]] += len(WORDS.findall(r["text"]))
    targets = mixing.assign(spark.createDataFrame(kept[2]), ["source"]).groupBy("_source").agg(F.first("target").alias("t")).collect()
    longest = max(len(WORDS.findall(t)) for t in redacted.values())
    assert all(abs(taken[r["_source"]] - r["t"]) <= longest / 2 + 1 for r in targets)
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    want = Counter((r["doc_id"], tuple([*sp.encode(r["text"]), 2])) for r in kept[3])
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in p.STAGES[-1][1](spark, before, sf).collect()) == want
    assert p.run(spark, sf).count() == len(kept[3])


def test_pipeline_on_odd_and_empty_tables(spark, sf, docs, empty):
    """Stage by stage: rows stay or go as the pipeline's docstring says, extra columns stay."""
    import corpus_pipeline as p

    start = docs.drop("node")
    before = start
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == start.columns, name
        if name == "near_duplicates":
            a, b = Counter(r["doc_id"] for r in before.collect()), Counter(r["doc_id"] for r in after.collect())
            copies = {x for x, mate in ((6, 5), (8, 7)) if mate in a}
            assert set(b) == set(a) - copies and b[None] == a[None] and max(b[i] for i in b if i) == 1
        if name == "personal_data":
            assert before.count() == after.count() and not [r for r in after.collect() if literal_base(r["text"] or "")]
        if name == "source_mix":
            assert not [r for r in after.collect() if not WORDS.findall(r["text"] or "")]
        before = after
    assert p.STAGES[-1][1](spark, before, sf).count() == before.count()
    nothing = empty
    for _, stage in p.STAGES[:-1]:
        nothing = stage(spark, nothing, sf)
        assert nothing.columns == empty.columns and nothing.count() == 0
    assert p.STAGES[-1][1](spark, nothing, sf).count() == 0

"""Operator 6: SentencePiece (BPE with byte fallback) encoding and decoding that keep byte offsets.

A model file is read directly (protocol buffer wire format). Normalisation walks the compiled character map, a
double-array trie, taking the longest matching prefix at each place, and records for every normalised byte the source
byte that it comes from; so each piece projects to a span of original bytes. Text then falls into units, runs of the
space sign with what follows, over which no piece of the vocabulary reaches. The distinct units of a portion of text
are merged together in numpy: in each round every unit joins its best pair (highest score, then leftmost).

Decoding joins pieces, turns runs of byte pieces into text (a byte that fits nowhere becomes U+FFFD), gives the
unknown id its surface and drops control ids and the one space that encoding put in front.

Defined results: null counts as empty; an empty text has the end id alone and decodes to the empty text; a model of
another kind, with user-defined or unused pieces, or with pieces across units raises ValueError.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewave.llm.common import portions, table, texts

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CODE_POINTS = 0x110000
NONE = np.int32(2**31 - 1)
LONG = 48


def _fields(data: bytes):
    """(number, value) of each field: ints, 4- or 8-byte strings, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class CharacterMap:
    """Longest-prefix replacement through a compiled map: trie size, double-array trie, zero-ended replacements."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.strings = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.strings = blob[4 + size :]

    @staticmethod
    def _step(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at ``at`` and its replacement."""
        if not self.units:
            return None
        node, found = self._step(self.units[0]), None
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._step(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[start : self.strings.index(b"\0", start)]
        return found


class PieceModel:
    def __init__(self, blob: bytes):
        pieces, spec, self.byte_fallback, kind = [], {}, False, 1
        for number, value in _fields(blob):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
                kind, self.byte_fallback = trainer.get(3, 1), bool(trainer.get(35, 0))
                self.unk_surface = trainer.get(44, " ⁇ ".encode()).decode()
                self.suffix = bool(trainer.get(24, 0))
            elif number == 3:
                spec = dict(_fields(value))
        self.charmap = CharacterMap(spec.get(2, b""))
        self.dummy, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.pieces = [p for p, _, _ in pieces]
        self.kinds = [k for _, _, k in pieces]
        if kind != 2 or self.suffix or {USER, UNUSED} & set(self.kinds) or any(SPACE in p.lstrip(SPACE) for p, _, k in pieces if k == NORMAL):
            raise ValueError("only BPE models whose pieces hold the space sign in front alone are handled")
        self.unk = self.kinds.index(UNKNOWN)
        self.controls = [i for i, k in enumerate(self.kinds) if k == CONTROL]
        self.eos = self.pieces.index("</s>")
        self.bytes = np.full(256, self.unk, np.int32)
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if k == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        normal = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        _, ranks = np.unique([-s for _, s, _ in pieces], return_inverse=True)
        # a symbol is a piece, or a character that is no piece, numbered after the pieces
        self.base = len(pieces)
        self.wide = self.base + CODE_POINTS
        self.symbols = np.arange(self.base, self.wide, dtype=np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.symbols[ord(p)] = i
        pairs = []
        for p, i in normal.items():
            for cut in range(1, len(p)):
                left, right = (int(self.symbols[ord(x)]) if len(x) == 1 else normal.get(x, -1) for x in (p[:cut], p[cut:]))
                if left >= 0 and right >= 0:
                    pairs.append((left * self.wide + right, ranks[i], i))
        table_ = np.array(sorted(pairs) or [(-1, 0, 0)], np.int64)
        self.codes, self.ranks, self.made = table_[:, 0].copy(), table_[:, 1].astype(np.int32), table_[:, 2].astype(np.int32)
        source = [b"" if k in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.surface = source
        self.surface[self.unk] = self.unk_surface.encode()
        self.normal_bytes = np.array([1 if k == BYTE else len(p.encode()) if k == NORMAL else 0 for p, k in zip(self.pieces, self.kinds, strict=True)], np.int64)

    # normalisation

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """Normalised text, and the source byte of each of its bytes and of its end (None: simple identity)."""
        if not text:
            return "", np.zeros(1, np.int64)
        if not self.charmap.units and not self.squeeze and self.escape:
            return (SPACE if self.dummy else "") + text.replace(" ", SPACE), None
        data, at, out, align = text.encode(), 0, bytearray(), []
        sign = SPACE.encode() if self.escape else b" "

        def prefix(at: int) -> tuple[int, bytes]:
            hit = self.charmap.longest(data, at)
            if hit:
                return hit
            n = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
            return n, data[at : at + n]

        def put(piece: bytes, source: int) -> None:
            out.extend(piece)
            align.extend([source] * len(piece))

        if self.squeeze:
            while at < len(data) and (hit := prefix(at))[1] in (b" ", b""):
                at += hit[0]
            if at == len(data):
                return "", np.array([at])
        if self.dummy:
            put(sign, at)
        spaced = self.squeeze
        while at < len(data):
            n, piece = prefix(at)
            if spaced:
                piece = piece.lstrip(b" ")
            if piece:
                for byte in piece:
                    put(sign if byte == 32 else bytes([byte]), at)
                spaced = self.squeeze and piece.endswith(b" ")
            at += n
        if self.squeeze:
            while out.endswith(sign) and out:
                end = align[-len(sign)]
                del out[-len(sign) :], align[-len(sign) :]
                at = end
        return out.decode(), np.array([*align, at], np.int64)

    def offsets(self, ids: np.ndarray, text: str, align: np.ndarray | None) -> np.ndarray:
        """Piece i covers original bytes offsets[i] to offsets[i + 1]."""
        ends = np.concatenate([[0], np.cumsum(self.normal_bytes[ids])])
        if align is None:
            # identity: every space sign stands for one byte, the first for none
            data = np.frombuffer(((SPACE if self.dummy else "") + text.replace(" ", SPACE)).encode(), np.uint8)
            sign = np.zeros(len(data), np.int64)
            real = np.frombuffer(text.encode(), np.uint8)
            kept = np.ones(len(data), np.int64)
            first = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else sign[:0]
            from_space = first if SPACE not in text else self._space_places(text)
            kept[from_space + 1] = kept[from_space + 2] = 0
            if self.dummy and len(data):
                kept[0] = 0
            align = np.concatenate([[0], np.cumsum(kept)])
            assert align[-1] == len(real)
        return align[np.minimum(ends, len(align) - 1)].astype(np.int32)

    def _space_places(self, text: str) -> np.ndarray:
        lengths = [3 if c == " " else len(c.encode()) for c in text]
        starts = np.cumsum([3 if self.dummy else 0, *lengths])[:-1]
        places = starts[[c == " " for c in text]]
        return np.concatenate([[0] if self.dummy else [], places]).astype(np.int64)

    # merging

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = left.astype(np.int64) * self.wide + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[at] == code
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def merge(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all units one after another, and where each unit's begin."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        codes = self.symbols[np.frombuffer("".join(units).encode("utf-32-le"), "<u4")]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        alive = np.ones(len(codes), bool)
        symbols = codes.copy()
        for low, high in ((1, 8), (8, 16), (16, LONG)):
            for rows in np.array_split(chosen := np.flatnonzero((lengths > low) & (lengths <= high)), max(1, len(chosen) // 20_000)):
                if len(rows):
                    self._merge_rows(symbols, alive, starts[rows], lengths[rows], high)
        for row in np.flatnonzero(lengths > LONG):
            self._merge_long(symbols, alive, int(starts[row]), int(starts[row + 1]))
        counts = np.concatenate([[0], np.cumsum(alive)])
        return symbols[alive], counts[starts]

    def _merge_rows(self, symbols: np.ndarray, alive: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> None:
        n = len(starts)
        column = np.arange(width)
        at = np.minimum(starts[:, None] + column, len(symbols) - 1)
        inside = column < lengths[:, None]
        sym = np.where(inside, symbols[at], -1)
        after = np.where(column + 1 < lengths[:, None], column + 1, width).astype(np.int16)
        before = np.broadcast_to(column - 1, (n, width)).astype(np.int16)
        rank, made = np.full((n, width), NONE), np.zeros((n, width), np.int32)
        pair = column[:-1] + 1 < lengths[:, None]
        rank[:, :-1][pair], made[:, :-1][pair] = self._look(sym[:, :-1][pair], sym[:, 1:][pair])
        live = inside.copy()
        rows = np.arange(n)
        while len(rows):
            j = rank[rows].argmin(axis=1)
            on = rank[rows, j] < NONE
            rows, j = rows[on], j[on]
            if not len(rows):
                break
            k = after[rows, j].astype(np.int64)
            m = made[rows, j]
            sym[rows, j] = m
            rank[rows, k] = NONE
            live[rows, k] = False
            nxt = after[rows, k].astype(np.int64)
            after[rows, j] = nxt
            rank[rows, j] = NONE
            more = nxt < width
            r, a, b = rows[more], j[more], nxt[more]
            before[r, b] = a
            rank[r, a], made[r, a] = self._look(m[more], sym[r, b])
            prv = before[rows, j].astype(np.int64)
            more = prv >= 0
            r, a = rows[more], prv[more]
            rank[r, a], made[r, a] = self._look(sym[r, a], m[more])
        flat = at[inside]
        symbols[flat], alive[flat] = sym[inside], live[inside]

    def _merge_long(self, symbols: np.ndarray, alive: np.ndarray, start: int, end: int) -> None:
        """One long unit, by a heap of pairs."""
        import heapq

        sym = symbols[start:end].tolist()
        n = len(sym)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank, made = self._look(symbols[start : end - 1], symbols[start + 1 : end])
        heap = [(int(r), i, sym[i], sym[i + 1], int(m)) for i, (r, m) in enumerate(zip(rank, made, strict=True)) if r != NONE]
        heapq.heapify(heap)
        codes, ranks, results = self.codes, self.ranks, self.made

        def offer(i: int, j: int) -> None:
            code = sym[i] * self.wide + sym[j]
            at = int(np.searchsorted(codes, code))
            if at < len(codes) and codes[at] == code:
                heapq.heappush(heap, (int(ranks[at]), i, sym[i], sym[j], int(results[at])))

        dead = [False] * n
        while heap:
            _, i, left, right, m = heapq.heappop(heap)
            j = after[i]
            if dead[i] or sym[i] != left or j < 0 or sym[j] != right:
                continue
            sym[i], dead[j], after[i] = m, True, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        symbols[start:end], alive[start:end] = sym, ~np.array(dead)

    def encode(self, many: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids with the end id, byte offsets) of each text."""
        normal = [self.normalise(t) for t in many]
        each = [UNITS.findall(t) for t, _ in normal]
        distinct = dict.fromkeys(itertools.chain.from_iterable(each))
        for i, unit in enumerate(distinct):
            distinct[unit] = i
        index = np.fromiter(map(distinct.__getitem__, itertools.chain.from_iterable(each)), np.int64, sum(map(len, each)))
        ids, bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)
        if len(distinct):
            ids, bounds = self.merge(list(distinct))
            ids, bounds = self._with_bytes(ids, bounds)
        out, at = [], 0
        for text, (_, align), units in zip(many, normal, each, strict=True):
            mine = index[at : at + len(units)]
            at += len(units)
            n = bounds[mine + 1] - bounds[mine]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            place = np.arange(total) + np.repeat(bounds[mine] - (ends - n), n)
            got = np.append(ids[place], np.int32(self.eos)).astype(np.int32)
            out.append((got, self.offsets(got, text, align)))
        return out

    def _with_bytes(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd = np.flatnonzero(symbols >= self.base)
        if not len(odd):
            return symbols, bounds
        if not self.byte_fallback:
            symbols = symbols.copy()
            symbols[odd] = self.unk
            return symbols, bounds
        raw = [chr(c).encode() for c in (symbols[odd] - self.base).tolist()]
        sizes = np.ones(len(symbols), np.int64)
        sizes[odd] = [len(r) for r in raw]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.repeat(symbols, sizes)
        for o, r in zip(odd.tolist(), raw, strict=True):
            ids[ends[o] : ends[o + 1]] = self.bytes[list(r)]
        return ids, ends[bounds]

    # decoding

    def decode(self, ids: list[int]) -> str:
        try:
            if any(c in ids[:-1] for c in self.controls):  # these end runs of byte pieces
                raise ValueError
            text = b"".join(map(self.surface.__getitem__, ids)).decode()
        except ValueError:
            text = self._decode_damaged(ids)
        if not (self.dummy or self.squeeze):
            return text
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        return text[1:] if first is not None and self.kinds[first] == NORMAL and text.startswith(" ") else text

    def _decode_damaged(self, ids: list[int]) -> str:
        out = []
        for is_byte, run in itertools.groupby(ids, lambda i: self.kinds[i] == BYTE):
            data = b"".join(self.surface[i] for i in run)
            while is_byte and data:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(data[:n].decode())
                        data = data[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    data = data[1:]
            if not is_byte:
                out.append(data.decode())
        return "".join(out)


UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@lru_cache(4)
def load(blob: bytes) -> PieceModel:
    return PieceModel(blob)


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, blob: bytes, key: str = "doc_id", text: str = "text", decode: bool = True) -> DataFrame:
    """(key, ids, offsets, decoded) of every row; portions of about 1 MB of text bound a worker's memory.

    Without ``decode`` the last column, and the work for it, are left out.
    """

    def run(batches):
        model = load(blob)
        for part in portions(batches, "text"):
            rows = model.encode(texts(part.column(1)))
            ends = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([i for i, _ in rows])))
            marks = np.concatenate([[0], np.cumsum([len(o) for _, o in rows])]).astype(np.int32)
            offsets = pa.ListArray.from_arrays(pa.array(marks), pa.array(np.concatenate([o for _, o in rows])))
            out = {"key": part.column(0), "ids": ids, "offsets": offsets}
            if decode:
                out["decoded"] = pa.array([model.decode(i.tolist()) for i, _ in rows], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return _over(docs, key, text, run, "ids array<int>, offsets array<int>" + ", decoded string" * decode)


def digests(docs: DataFrame, blob: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, source_bytes): ``encode`` with its lists turned to digests where they are made."""

    def run(batches):
        model = load(blob)
        names = [str(i).encode() for i in range(model.base)]
        for part in portions(batches, "text"):
            rows = []
            for ids, offsets in model.encode(texts(part.column(1))):
                some = ids.tolist()
                rows.append((len(some), hashlib.sha256(b" ".join(map(names.__getitem__, some))).hexdigest(), hashlib.sha256(model.decode(some).encode()).hexdigest(), int(offsets[-1])))
            n, a, b, c = zip(*rows, strict=True)
            yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(c, pa.int64())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256", "source_bytes"])

    return _over(docs, key, text, run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, source_bytes bigint")


def _over(docs: DataFrame, key: str, text: str, run, columns: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    return docs.selectExpr(f"`{key}` AS key", f"cast(`{text}` AS string) AS text").mapInArrow(run, f"key {kind}, {columns}").withColumnRenamed("key", key)


def op6(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), model_bytes(path or public_tokenizers.path("piece_bpe_32k.model")))

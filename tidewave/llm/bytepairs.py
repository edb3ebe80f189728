"""Operator 12: byte-level BPE through a SentencePiece model that is written from the vocabulary itself.

``serialise`` writes a model file field by field: every entry of a rank file becomes a normal piece whose bytes are
mapped to letters, one letter a byte, and whose score is its rank with a minus sign; the normaliser is the identity,
without a prefix, without squeezing and without escaping of blanks. Merging the pair with the highest score, the left
one of equals, is then what a byte-pair encoder does by ranks. Text is cut by the vocabulary's pattern and every match
encoded for itself; a match that is an entry as a whole is that entry, as in a rank encoder, which asks for it first.
Ids are ranks. Decoding maps the letters of pieces back to bytes.

Each portion of about 1 MB of text encodes its distinct matches once, so a worker's memory is bounded by a portion or
by one longer text; rows never leave their task and nothing is shuffled.

Defined results: a null or empty text has no ids; a text is encoded whole, however long; equal texts give equal ids in
every row; extra columns are ignored; an empty table gives no rows. Text that looks like a special token is plain text.
A vocabulary without all 256 single bytes, or with an entry twice, is refused.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewave.llm.common import portions, table, texts

# Bytes that stand for themselves as letters (the others follow from 256 on), in the usual byte alphabet.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
# Numbers of fields and kinds in SentencePiece's model format.
PIECES, TRAINER, NORMALISER = 1, 2, 3
PIECE, SCORE, KIND = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, VOCABULARY_SIZE, UNKNOWN_ID, BEGIN_ID, END_ID, PAD_ID, BPE = 3, 4, 40, 41, 42, 43, 2
NAME, DUMMY_PREFIX, SQUEEZE, ESCAPE = 1, 3, 4, 5
UNKNOWN_PIECE = "<unk>"


class VocabularyError(ValueError):
    """A rank file cannot be made a model."""


def alphabet() -> str:
    """The letter of each byte."""
    rest = iter(range(256, 512))
    own = set(PRINTABLE)
    return "".join(chr(b if b in own else next(rest)) for b in range(256))


LETTERS = alphabet()
BYTES = {ord(c): b for b, c in enumerate(LETTERS)}
TO_LETTERS = dict(enumerate(LETTERS))


def letters(data: bytes) -> str:
    return data.decode("latin-1").translate(TO_LETTERS)


def bytes_of(piece: str) -> bytes:
    return bytes(map(BYTES.__getitem__, map(ord, piece)))


def read_ranks(blob: bytes) -> dict[bytes, int]:
    """Entries of a rank file: base64 and rank on each line."""
    out = {}
    for line in blob.splitlines():
        if line.strip():
            entry, rank = line.split()
            out[base64.b64decode(entry)] = int(rank)
    return out


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes | str) -> bytes:
    """One field: numbers as varint, floats as four bytes, all else with its length in front."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The model whose ids are the ranks 0 ... n - 1, and n for the unknown piece, which no text meets."""
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[entry] for entry in order] != list(range(len(order))):
        raise VocabularyError("ranks are not 0 ... n - 1, once each")
    if any(bytes([b]) not in ranks for b in range(256)) or b"" in ranks:
        raise VocabularyError("an entry is empty, or a single byte is none")
    if len(order) >= 1 << 24:
        raise VocabularyError("ranks beyond 24 bits are not exact as scores")
    pieces = [_field(PIECE, letters(entry)) + _field(SCORE, float(-rank)) + _field(KIND, NORMAL) for rank, entry in enumerate(order)]
    pieces.append(_field(PIECE, UNKNOWN_PIECE) + _field(SCORE, 0.0) + _field(KIND, UNKNOWN))
    trainer = _field(MODEL_TYPE, BPE) + _field(VOCABULARY_SIZE, len(pieces)) + _field(UNKNOWN_ID, len(order)) + b"".join(_field(i, -1) for i in (BEGIN_ID, END_ID, PAD_ID))
    normaliser = _field(NAME, "identity") + b"".join(_field(i, 0) for i in (DUMMY_PREFIX, SQUEEZE, ESCAPE))
    return b"".join(_field(PIECES, p) for p in pieces) + _field(TRAINER, trainer) + _field(NORMALISER, normaliser)


class BytePairs:
    """Encoder and decoder over a serialised model."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.model.get_piece_size() - 1
        self.pattern = regex.compile(pattern)
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        self.whole = {p: i for i, p in enumerate(pieces)}
        self.surface = [bytes_of(p) for p in pieces]

    def encode(self, many: list[str]) -> list[np.ndarray]:
        """Ids of each text; distinct matches of the pattern are encoded once."""
        each = [self.pattern.findall(t) for t in many]
        distinct = list(dict.fromkeys(itertools.chain.from_iterable(each)))
        mapped = [letters(m.encode()) for m in distinct]
        odd = [p for p in mapped if p not in self.whole]
        split = dict(zip(odd, self.model.encode(odd, num_threads=1) if odd else [], strict=True))
        ids = {m: split[p] if p in split else (self.whole[p],) for m, p in zip(distinct, mapped, strict=True)}
        return [np.fromiter(itertools.chain.from_iterable(map(ids.__getitem__, matches)), np.int32) for matches in each]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.surface.__getitem__, ids))


@lru_cache(4)
def load(model: bytes, pattern: str) -> BytePairs:
    return BytePairs(model, pattern)


def model_of(path: str) -> bytes:
    """The model of the rank file at ``path``."""
    with open(path, "rb") as f:
        return serialise(read_ranks(f.read()))


def _over(docs: DataFrame, key: str, text: str, run, columns: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    return docs.selectExpr(f"`{key}` AS key", f"cast(`{text}` AS string) AS text").mapInArrow(run, f"key {kind}, {columns}").withColumnRenamed("key", key)


def encode(docs: DataFrame, model: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row."""

    def run(batches):
        pairs = load(model, pattern)
        for part in portions(batches, "text"):
            rows = pairs.encode(texts(part.column(1)))
            ends = np.concatenate([[0], np.cumsum([len(i) for i in rows])]).astype(np.int32)
            yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))], names=["key", "ids"])

    return _over(docs, key, text, run, "ids array<int>")


def decode(rows: DataFrame, model: bytes, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, data) from (key, ids): the bytes that the ids stand for; null ids give null."""

    def run(batches):
        pairs = load(model, pattern)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([None if i is None else pairs.decode(i) for i in batch.column(1).to_pylist()], pa.binary())], names=["key", "data"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.selectExpr(f"`{key}` AS key", "ids").mapInArrow(run, f"key {kind}, data binary").withColumnRenamed("key", key)


def digests(docs: DataFrame, model: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): ``encode`` and ``decode`` with lists turned to digests where they are made."""

    def run(batches):
        pairs = load(model, pattern)
        for part in portions(batches, "text"):
            rows = []
            for ids in pairs.encode(texts(part.column(1))):
                rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(pairs.decode(ids.tolist())).hexdigest()))
            n, a, b = zip(*rows, strict=True)
            yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _over(docs, key, text, run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op12(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), model_of(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)

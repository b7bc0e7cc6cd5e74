"""Byte-level BPE by a sentencepiece model made from the vocabulary (operator 10).

The rank file's byte strings become the pieces of a BPE model: each byte is mapped to a visible
character, the score of a piece is its negative rank, and the normaliser changes nothing.
sentencepiece then merges the best-scored neighbours first, which is the merge order of the ranks.  Texts
are cut by the pre-token pattern and each match is encoded alone.  Decoding maps ids to pieces and their characters
back to bytes.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.llm.common import ChunkEncoder, BYTE_LEVEL


@functools.lru_cache(maxsize=2)
def ranks_of(path: str) -> dict[bytes, int]:
    """Byte string -> rank, from a file of base64 strings and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_characters() -> list[str]:
    """A visible character for each byte: itself where it is one, else one from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in set(own) else chr(next(other)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol-buffer field: a message or string, a number, or a 32-bit float."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (1 << 64) - 1)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece i is the byte string of rank i; the unknown piece follows them."""
    chars = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, "".join([chars[b] for b in x]).encode()) + _field(2, -float(r)) + _field(3, normal)) for x, r in sorted(ranks.items(), key=lambda p: p[1])]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(pieces) - 1) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no dummy prefix, no white space removed or escaped
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """encode: str -> ids as little-endian unsigned 32-bit bytes; decode: the inverse, to bytes."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = ranks_of(path)
        if sorted(self.ranks.values()) != list(range(len(self.ranks))):
            raise ValueError("ranks must be 0 to n - 1")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.cut = regex.compile(pattern).findall
        self.map = {b: c for b, c in enumerate(byte_characters())}
        back = {c: b for b, c in self.map.items()}
        self.bytes_of = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(self.ranks))]
        self.encode = ChunkEncoder(BYTE_LEVEL, self._new, "<u4")

    def _new(self, chunks: list[str]) -> list[bytes]:
        cut = [[m.encode("utf-8", "replace") for m in self.cut(c)] for c in chunks]
        # a match that is in the vocabulary is one id, whether or not merges lead to it
        rest = list({m for x in cut for m in x if m not in self.ranks})
        ids = dict(zip(rest, self.model.encode([m.decode("latin-1").translate(self.map) for m in rest], num_threads=1)))
        return [np.array([i for m in x for i in ([self.ranks[m]] if m in self.ranks else ids[m])], "<u4").tobytes() for x in cut]

    def decode(self, ids: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """Once for each Python worker."""
    return ByteBpe(path, pattern)


#: Documents of an Arrow batch that are in work at a time.
ROWS = 500


def encode_documents(docs: DataFrame, path: str, pattern: str, decode: bool = False) -> DataFrame:
    """(doc_id, ids binary) of every row; ids as little-endian unsigned 32-bit integers.  ``decode``: also decoded (binary), the ids' bytes.

    A null or empty text has no ids.  Rows are independent: ties and repeated rows each give theirs, an
    empty table none; a doc_id may be null; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                ids = own.encode(b.column(1))
                more = {"decoded": pa.array([own.decode(x) for x in ids], pa.binary())} if decode else {}
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "ids": pa.array(ids, pa.binary()), **more})

    schema = "doc_id long, ids binary" + ", decoded binary" * decode
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded binary) of encoded documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "ids": b.column(1), "decoded": pa.array([own.decode(x) for x in b.column(1).to_pylist()], pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode the ids: doc_id, n_tokens, ids_sha256, decoded_sha256.  One Python worker does both, with one model and memory of chunks."""
    both = encode_documents(docs, path, pattern, decode=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

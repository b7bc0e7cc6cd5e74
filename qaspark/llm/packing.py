"""Packing along a space-filling curve (operator 1).

Every document becomes a hashed bag of token ids (signed feature hashing), is projected to a few
dimensions, and gets the Hilbert key of its cell.  Documents are range-sorted by that
key, so that neighbours on the curve are alike, and laid end to end; the line is cut at
every ``seq_len``-th id.  So each sequence but the very last is full: no padding.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qaspark.llm.common import WORDS, broadcast_if_small, id_type, library_encoder, tokenizer
from qaspark.session import Scratch, written

#: Buckets of the hashed vectors, dimensions and bits a dimension of the curve (their product under 63), seed of the projection.
BUCKETS, DIMS, BITS, SEED = 256, 4, 8, 7

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (rows x dimensions, 0 <= cell < 2**bits).

    Works from the highest bit down: at each level a cell's bits, as a Gray code, say
    which part of the cube it is in, and the lower bits are mirrored or swapped so
    that the parts' curves join.
    """
    x = cells.astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = key << 1 | (row >> b & 1)
    return key


@functools.lru_cache(maxsize=2)
def _hashed(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sign of each id, and the projection."""
    mixed = (np.arange(size, dtype=np.uint64) + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS, 1.0 - 2.0 * (mixed >> np.uint64(63)).astype(float), np.random.default_rng(SEED).normal(size=(BUCKETS, DIMS))


def document_key(ids: list[np.ndarray], size: int) -> np.ndarray:
    """Hilbert key of each document's hashed, normalised and projected vector; no ids: the middle cell's."""
    bucket, sign, projection = _hashed(size)
    v = np.stack([np.bincount(bucket[x], sign[x], BUCKETS) for x in ids]).astype(float)  # of no ids numpy counts in integers
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    p = v @ projection  # about normal: a logistic curve spreads it evenly over the cells
    return hilbert_key(np.minimum((1 << BITS) - 1, (1 << BITS) / (1 + np.exp(-1.702 * p))).astype(np.int64), BITS)


def pack(docs: DataFrame, path: str, seq_len: int = 2048, end_id: int = 1) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most ``seq_len`` ids; one row for each piece.

    doc_id; start: the document's ids before the piece; length; doc_tokens: the document's ids
    with ``end_id``; sequence_id; offset: the piece's place in its sequence (gapless from 0);
    ids: little-endian unsigned 32-bit integers.  ``sequences`` puts them together.

    A null or empty text is ``end_id`` alone.  Null doc_ids and rows that repeat are packed like any other, ordered by
    curve, doc_id and ids.  An empty table gives no piece.  Other columns are not read.
    A document of any length is cut; only sequence 0 .. n-2 are full, the last holds the rest.

    Two tables are written to the shared folder: the encoded documents, and the same
    in curve order with each one's place in its partition.  Only the partitions' totals meet in one task.
    """
    spark = docs.sparkSession
    dtype, size = id_type(path), max(tokenizer(path).get_vocab_size(), end_id + 1)
    width = np.dtype(dtype).itemsize

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, end = library_encoder(path, WORDS, " \x01 "), np.array([end_id], dtype).tobytes()
        for b in batches:
            ids = to_ids(b.column(1))
            if ids:
                keys = np.concatenate([document_key([np.frombuffer(x, dtype) for x in ids[i : i + 500]], size) for i in range(0, len(ids), 500)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys), pa.array([x + end for x in ids], pa.binary())], ["doc_id", "curve", "ids"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = np.array([len(x) // width for x in b.column(1).to_pylist()], np.int64)
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), b.column(0), pa.array(ends - n), pa.array(n), b.column(1)], ["part", "doc_id", "place", "n", "ids"])
            at = int(ends[-1]) if len(n) else at

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for d, at, x in zip(*(b.column(i).to_pylist() for i in range(3))):
                ids, start = np.frombuffer(x, dtype).astype("<u4"), 0
                while start < len(ids):
                    n = min(len(ids) - start, seq_len - (at + start) % seq_len)
                    rows.append((d, start, n, len(ids), (at + start) // seq_len, (at + start) % seq_len, ids[start : start + n].tobytes()))
                    start += n
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], [c.split()[0] for c in PIECES.split(", ")])

    with Scratch(spark) as tables:
        encoded = tables.path("pack-encoded")
        (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
         .mapInArrow(encode, "doc_id long, curve long, ids binary").write.option("compression", "zstd").parquet(encoded))
        # the range partitions' bounds come from a sample: from the written table, not from encoding again
        by_curve = (spark.read.schema("doc_id long, curve long, ids binary").parquet(encoded)
                    .repartitionByRange("curve", "doc_id", F.xxhash64("ids")).sortWithinPartitions("curve", "doc_id", "ids").select("doc_id", "ids"))
        placed = written(by_curve.mapInArrow(place, "part int, doc_id long, place long, n long, ids binary"), "pack-placed")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = written(placed.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before")), "pack-parts")
    return placed.join(broadcast_if_small(parts), "part").select("doc_id", (F.col("place") + F.col("before")).alias("at"), "ids").mapInArrow(cut, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids binary, length, pieces array<struct<offset, doc_id, start, length>>): each sequence whole; at most seq_len ids meet."""
    return (pieces.groupBy("sequence_id")
            .agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("p"))
            .select("sequence_id",
                    F.aggregate(F.transform("p", lambda x: x["ids"]), F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"),
                    F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"),
                    F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"))).alias("pieces")))


def piece_digests(docs: DataFrame, path: str, seq_len: int = 2048, end_id: int = 1) -> DataFrame:
    """The pieces with ids_crc32 in place of their ids."""
    return pack(docs, path, seq_len, end_id).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

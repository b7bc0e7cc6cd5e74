"""Token files: frequency-ranked ids in a byte-aligned variable-length code (operator 9).

Format of a folder of token files
---------------------------------
``vocab/``     (rank long, id long): ids by falling frequency in this corpus, ties by id.
``segments/``  one row for each run of documents: part int, seg int, start long
               (ids before it within the part), doc_ids array<long>, lengths
               array<long>, n_ids long, control binary, data binary.
               Parts follow doc_id order, and so do the segments of a part.
``parts/``     (part int, n_ids long).

Each id is written as its rank in 1 to 4 little-endian bytes in ``data``; two
bits of ``control`` hold the number of bytes less one, four ids to a control
byte, the first in the lowest bits.  Data and control are apart, so that a reader
looks up the four lengths of a control byte in a table and decodes with numpy gathers.
The rows lie in Parquet files that Spark writes and commits, so that the folder
may be in any store, and a lost executor's tasks are simply run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qaspark.llm.common import BYTE_LEVEL, id_type, library_encoder, tokenizer
from qaspark.session import Scratch, checkpoint_path

#: Ids after which a segment is closed; a document is never divided.
SEGMENT_IDS = 1 << 20
#: Lengths of the four codes of each control byte.
_LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3) + 1
#: What to keep of four bytes for each length.
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)

SEGMENT_SCHEMA = "part int, seg int, start long, doc_ids array<long>, lengths array<long>, n_ids long, control binary, data binary"


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of ranks (unsigned 32-bit)."""
    ranks = ranks.astype("<u4")
    n = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = n - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < n[:, None]]
    return control.tobytes(), data.tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The inverse of ``pack_ranks``: lengths by table lookup, then one gather a byte."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(lengths)
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    at = ends - lengths
    out = raw[at] if n else np.zeros(0, np.uint32)
    for k in (1, 2, 3):
        if not (longer := lengths > k).any():
            break
        out = np.where(longer, out | raw[at + k] << np.uint32(8 * k), out)
    return out & _MASKS[lengths]


def encode(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids binary) of every row of documents, ``end_id`` last; a null text is empty."""
    dtype = id_type(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, end = library_encoder(path, BYTE_LEVEL, "\n"), np.array([end_id], dtype).tobytes()
        for b in batches:
            ids = to_ids(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x + end for x in ids], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 2) -> None:
    """Encode documents (doc_id, text) and write them to ``folder`` in ascending doc_id order.

    Texts are encoded once, into a table that goes at the end; counts of all ids rank the vocabulary (a table of
    as many rows as the tokenizer has ids, the only thing that goes through the driver).
    A null doc_id comes first, equal doc_ids follow each other ordered by their ids; an empty table gives empty files;
    other columns are not read.
    """
    spark = docs.sparkSession
    dtype, size = id_type(path), max(tokenizer(path).get_vocab_size(), end_id + 1)
    with Scratch(spark) as tables:
        encoded = tables.path("token-ids")
        encode(docs, path, end_id).write.option("compression", "zstd").parquet(encoded)
        enc = spark.read.schema("doc_id long, ids binary").parquet(encoded)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size, np.int64)
            for b in batches:
                total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype), minlength=size)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

        counted = enc.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
        ids = np.array([r.id for r in sorted(counted.collect(), key=lambda r: (-r.n, r.id))], np.int64)
        spark.createDataFrame(pa.table({"rank": np.arange(len(ids)), "id": ids}) if len(ids) else [], "rank long, id long").coalesce(1).write.parquet(f"{folder}/vocab")
        ranks = np.zeros(size, np.uint32)
        ranks[ids] = np.arange(len(ids))

        def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, seg, start, doc_ids, parts, waiting = TaskContext.get().partitionId(), 0, 0, [], [], 0

            def close() -> pa.RecordBatch:
                all_ids = np.frombuffer(b"".join(parts), dtype)
                control, data = pack_ranks(ranks[all_ids])
                lengths = [len(x) // np.dtype(dtype).itemsize for x in parts]
                row = [part, seg, start, doc_ids, lengths, len(all_ids), control, data]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")])

            for b in batches:
                for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    doc_ids.append(d)
                    parts.append(x)
                    waiting += len(x) // np.dtype(dtype).itemsize
                    if waiting >= SEGMENT_IDS:
                        yield close()
                        seg, start, doc_ids, parts, waiting = seg + 1, start + waiting, [], [], 0
            if parts:
                yield close()

        (enc.repartitionByRange("doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", "ids").mapInArrow(segments, SEGMENT_SCHEMA)
         .write.option("compression", "none").parquet(f"{folder}/segments"))
    (spark.read.schema(SEGMENT_SCHEMA).parquet(f"{folder}/segments").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
     .write.parquet(f"{folder}/parts"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document of the files, ids as little-endian unsigned 32-bit integers.

    ``start``: ids of all documents before it.  The parts are as many as the write's
    shuffle partitions; only their totals are summed in one task.
    """
    vocab = spark.read.schema("rank long, id long").parquet(f"{folder}/vocab").orderBy("rank").collect()
    ids = np.array([r.id for r in vocab], "<u4")
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = spark.read.schema("part int, n_ids long").parquet(f"{folder}/parts").select("part", F.coalesce(before, F.lit(0)).alias("before"))
    segs = (spark.read.schema(SEGMENT_SCHEMA).parquet(f"{folder}/segments").join(parts, "part")
            .select((F.col("start") + F.col("before")).alias("start"), "doc_ids", "lengths", "n_ids", "control", "data"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, doc_ids, lengths, n, control, data in zip(*(b.column(i).to_pylist() for i in range(6))):
                own, ends = ids[unpack_ranks(control, data, n)], np.cumsum(lengths)
                begins = ends - lengths
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids, pa.int64()), pa.array(begins + s, pa.int64()), pa.array(lengths, pa.int64()),
                    pa.array([own[x:y].tobytes() for x, y in zip(begins, ends)], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return segs.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def token_file_digests(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the files to the shared folder, read them back: doc_id, start, n_tokens, ids_crc32."""
    folder = checkpoint_path(spark, "token-files")
    write_token_files(docs, folder, path, end_id)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

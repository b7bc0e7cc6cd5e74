"""Exact dedup against a persistent digest index (operator 3).

The index is a table (digest, keep_id) bucketed and sorted by digest.  A batch is reduced to its distinct digests, those that the index lacks
are found by a sort-merge anti-join (the index side is read by bucket, without a shuffle) and appended.
DataFrame operations only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaspark.session import checkpoint_path, written


def text_digest(text: Column) -> Column:
    """SHA-256 (binary) of a text whose runs of ASCII white space are one space each; a null text is empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))


class DigestIndex:
    """The index in ``path`` (any folder Spark writes to); opening it again finds what earlier batches appended.

    ``buckets`` must be the same each time: about a bucket for each 100 MB of index.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.table = spark, path, f"digest_index_{uuid.uuid4().hex}"
        # the catalog entry lasts for this session, the files stay
        spark.sql(f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, docs: DataFrame) -> DataFrame:
        """Deduplicate documents (doc_id, text) against the index and append the new digests.

        Returns one row per document: doc_id, keep_id (the row that stays: the smallest doc_id of the batch that
        brought the text first), group_size (rows of this batch with the text), kept, text_sha256.
        Equal texts include null and empty ones.  A null doc_id comes after all others: such a row stays only where its
        text has no other row.  Rows equal in doc_id and text are one document, counted in group_size.
        An empty batch changes nothing; other columns are not read.

        A hot text is one row in the groups, aggregated before the shuffle; the join back to its documents is a plain
        equi-join of two shuffled sides, which AQE splits.
        """
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text").cast("string")).alias("digest"))
        rows = written(rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n")), "digest-rows")
        groups = written(rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "digest-groups")
        new = groups.join(self.read().hint("merge"), "digest", "left_anti")
        new.select("digest", "keep_id").write.insertInto(self.table)
        # all digests of the batch are in the index now; an older keep_id is not one of this batch's rows
        stay = groups.select("digest", "group_size", F.col("keep_id").alias("own")).join(self.read(), "digest")
        return rows.join(stay, "digest").select(
            "doc_id", "keep_id", "group_size",
            (F.col("keep_id").eqNullSafe(F.col("own")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, buckets: int = 64) -> DataFrame:
    """Documents as the first batch of a new index in the shared folder."""
    spark = docs.sparkSession
    return DigestIndex(spark, checkpoint_path(spark, "digest-index"), buckets).add(docs)


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
     g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g USING (h)
"""

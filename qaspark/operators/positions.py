"""Row positions without funnelling rows through one task.

A global ``row_number()`` (or one per hot group) moves every row of the
window partition into a single task.  ``with_row_position`` numbers rows
the way a sorted scan would see them, but distributed:

1. range-partition and sort by the order keys (checkpointed so a retried
   task sees identical partitions);
2. count rows per (partition, group) - one row per partition and group;
3. prefix-sum those counts per group in partition order (a window over the
   small count table);
4. join the offsets back: position = offset + index within the partition.

The order keys must be unique within a group for the result to be
deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .partitioning import materialize


def with_row_position(df: DataFrame, order_by: list[str], name: str = "row_pos",
                      partition_by: list[str] | None = None, num_partitions: int | None = None) -> DataFrame:
    """1-based position of each row in ``order_by`` order (within ``partition_by`` groups)."""
    spark = df.sparkSession
    groups = list(partition_by or [])
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *groups, *order_by).sortWithinPartitions(*groups, *order_by))
    tagged = ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    counts = tagged.groupBy("_pid", *groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    j = tagged.join(offsets.select(*[F.col(k).alias(f"_o_{k}") for k in ["_pid"] + groups], "_off", "_first"),
                    [tagged[k].eqNullSafe(F.col(f"_o_{k}")) for k in ["_pid"] + groups])
    return (j.withColumn(name, F.col("_off") + (F.col("_mid") - F.col("_first")) + 1)
             .drop("_pid", "_mid", "_off", "_first", *[f"_o_{k}" for k in ["_pid"] + groups]))


def question_index_block(pos, n_questions: int = 10, block: int = 3):
    """P10: (i // 3) % 10 + 1 for 0-based position i (rows come in blocks of 3)."""
    return (F.pmod(F.floor((F.col(pos) - 1) / block), F.lit(n_questions)) + 1).cast("int")


def question_index_cyclic(pos, n_questions: int = 10):
    """(i + 1) % 10 with 0 -> 10 for 0-based position i."""
    r = F.pmod(F.col(pos), F.lit(n_questions))
    return F.when(r == 0, F.lit(n_questions)).otherwise(r).cast("int")

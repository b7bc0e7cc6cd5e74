"""Distributed row positions equal a global row_number."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from qaspark.operators.positions import question_index_block, question_index_cyclic, with_row_position


def test_positions_match_row_number(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    got = with_row_position(df, ["k"], num_partitions=7).collect()
    assert sorted(r["row_pos"] for r in got) == list(range(1, 1001))
    assert all(r["row_pos"] == r["k"] + 1 for r in got)
    per = with_row_position(df, ["k"], partition_by=["g"], num_partitions=5)
    exp = df.withColumn("e", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    assert per.join(exp, ["k", "g"]).where(F.col("row_pos") != F.col("e")).count() == 0


def test_question_indexes(spark):
    df = spark.range(1, 31).select(F.col("id").alias("pos"))
    got = [(r[0], r[1]) for r in df.select(question_index_block("pos"), question_index_cyclic("pos")).collect()]
    assert [g[0] for g in got[:7]] == [1, 1, 1, 2, 2, 2, 3]
    assert [g[1] for g in got[8:11]] == [9, 10, 1]

"""Latencies as end minus start, by an as-of pairing of log events.

A log has start and end events of many users.  An end belongs to the last start of its user before it, if no other end came between
(a later start takes the place of one that was never ended).  The events are range-partitioned by (user, time, id), so that a user with a third of all events is
spread over many partitions, and each partition pairs its own.  What a partition lacks is the state before it: the last event of
the partition before, if that is of the same user.  These are one row a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .partitioning import materialize


def paired_latencies(events: DataFrame, starts: Column, ends: Column, user: str = "user_id", ts: str = "ts", event_id: str = "event_id",
                     num_partitions: int | None = None) -> DataFrame:
    """(user, start_id, end_id, start_ts, end_ts, latency_ms) of each end event; without an open start the start and the latency are null.

    ``starts``, ``ends``: conditions on an event; other events take no part, nor do those without a user or a time.  Events at the same time follow each other by
    id.  ``latency_ms`` has the precision of the timestamps, microseconds.
    """
    kind = F.when(starts, 0).when(ends, 1)
    d = events.select(F.col(user).alias("_user"), F.col(ts).alias("_ts"), F.col(event_id).alias("_id"), kind.alias("_kind"))
    d = d.where(F.col("_kind").isNotNull() & F.col("_user").isNotNull() & F.col("_ts").isNotNull())
    n = num_partitions or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["_user", "_ts", "_id"]
    # written once: the bounds of a range partitioning come from a sample, and each reader must see the same
    d = materialize(d.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    event = F.struct("_kind", F.col("_id").alias("id"), F.col("_ts").alias("ts"))
    own = Window.partitionBy("_part", "_user").orderBy("_ts", "_id")
    d = d.withColumn("_prev", F.lag(event).over(own))

    # the last event of each partition, for the partition that comes next
    last = d.groupBy("_part").agg(F.max(F.struct(*order, "_kind")).alias("l"))
    carried = last.select(F.lead("_part").over(Window.orderBy("_part")).alias("_part"), F.col("l._user").alias("_carried"),
                          F.struct(F.col("l._kind").alias("_kind"), F.col("l._id").alias("id"), F.col("l._ts").alias("ts")).alias("_before")).where("_part is not null")
    d = d.join(F.broadcast(carried), "_part", "left")  # a row a partition
    prev = F.coalesce("_prev", F.when(F.col("_carried") == F.col("_user"), F.col("_before")))
    d = d.withColumn("_open", F.when(prev["_kind"] == 0, prev)).where("_kind = 1")
    took = F.col("_ts") - F.col("_open.ts")  # an interval, for timestamps with a time zone and without
    whole = (F.extract(F.lit("DAY"), took).cast("long") * 24 + F.extract(F.lit("HOUR"), took)) * 60 + F.extract(F.lit("MINUTE"), took)
    ms = whole * 60_000 + F.extract(F.lit("SECOND"), took) * 1000
    return d.select(F.col("_user").alias(user), F.col("_open.id").alias("start_id"), F.col("_id").alias("end_id"), F.col("_open.ts").alias("start_ts"),
                    F.col("_ts").alias("end_ts"), ms.cast("double").alias("latency_ms"))

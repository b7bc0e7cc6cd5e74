"""Partition helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and cut its lineage.

    Used where several aggregates read the same expensive input (a scored
    table feeds means, group sizes and bootstrap buckets).  Reliable
    checkpoints survive executor loss, unlike local ones.
    """
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

"""A2: percentile bootstrap confidence intervals of group means.

One algorithm for groups of every size, the Poisson bootstrap: in each of
``n_boot`` replicates a row counts w times, w drawn from Poisson(1) by a hash of
the row's ids, the replicate and the seed.  A task draws a row's weights once for
all metrics and keeps sums per (group, replicate); only those are shuffled, so
a group of any size is spread over all tasks.  Sums are integers (values in
units of 1e-9), so results depend neither on partitioning nor on retries.

The hash is integer arithmetic modulo the prime 2^31 - 1, which DuckDB computes as well
(``bootstrap_ci_sql``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

PRIME = (1 << 31) - 1
#: Multipliers of the hash: first id, each further id, replicate; and what is added between the two rounds.
FIRST, NEXT, REPLICATE, BETWEEN = 48_271, 69_621, 40_692, 1_000_003
UNIT = 1_000_000_000
N_BOOT, ALPHA, SEED = 2_000, 0.05, 42
#: Rows whose weights a task holds at a time, and groups whose sums it holds.
_ROWS, _GROUPS = 256, 256


def poisson1_thresholds(kmax: int = 12) -> list[int]:
    """Least hash for a weight of 1, 2, ... kmax + 1: the Poisson(1) distribution function times PRIME.

    A weight over kmax + 1 has a probability under 1e-11, far below one hash value.
    """
    return [math.ceil(PRIME * math.fsum(math.exp(-1.0) / math.factorial(i) for i in range(k + 1))) for k in range(kmax + 1)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """x^5 modulo PRIME: a permutation, since 5 does not divide PRIME - 1."""
    y = x * x % PRIME
    return y * y % PRIME * x % PRIME


def poisson_weights(ids: list[np.ndarray], reps: np.ndarray, seed: int) -> np.ndarray:
    """Weights (rows x replicates) from the ids of the rows."""
    x = np.zeros(len(ids[0]), np.int64) + seed
    for m, i in zip([FIRST] + [NEXT] * (len(ids) - 1), ids):
        x = _mixed((x + i % PRIME * m) % PRIME)
    h = _mixed((_mixed((x[:, None] + reps[None, :] * REPLICATE) % PRIME) + BETWEEN) % PRIME)
    return np.searchsorted(poisson1_thresholds(), h, side="right").astype(np.int64)


def _unit(m: str) -> Column:
    return (F.col(m).try_cast("decimal(28,9)") * UNIT).cast("long")


def bootstrap_ci(df: DataFrame, by: list[str], metrics: list[str], id_cols: list[str] | None = None,
                 n_boot: int = N_BOOT, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """Per group of ``by``: ``<metric>_ci_lo`` / ``<metric>_ci_hi`` of each metric's mean over its non-null rows.

    ``id_cols``: integers that tell rows apart; without them a hash of all columns does.  Null keys are groups; a group without a value has null intervals.
    """
    if not id_cols:
        id_cols, df = ["_row"], df.withColumn("_row", F.xxhash64(*df.columns))
    rows = df.select(*by, *[F.col(i).cast("long").alias(f"_id{k}") for k, i in enumerate(id_cols)], *[_unit(m).alias(m) for m in metrics])
    fields = [T.StructField("_rep", T.IntegerType())] + [T.StructField(f"_{m}_{s}", T.LongType()) for m in metrics for s in ("swx", "sw")]
    schema = T.StructType([df.schema[k] for k in by] + fields)
    kinds = [to_arrow_type(df.schema[k].dataType) for k in by]
    reps = np.arange(1, n_boot + 1, dtype=np.int64)
    n_keys, n_ids = len(by), len(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for key, s in sums.items():
                columns = [pa.array([k] * n_boot, kind) for k, kind in zip(key, kinds)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(reps, pa.int32()), *map(pa.array, s)], schema.names)
            sums.clear()

        for b in batches:
            keys = list(zip(*[b.column(i).to_pylist() for i in range(n_keys)])) if by else [()] * b.num_rows
            ids = [b.column(n_keys + i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(n_ids)]
            values = [b.column(n_keys + n_ids + i) for i in range(len(metrics))]
            there = np.array([v.is_valid().to_numpy(zero_copy_only=False) for v in values], np.int64)
            units = np.array([v.fill_null(0).to_numpy(zero_copy_only=False) for v in values], np.int64)
            place: dict[tuple, list[int]] = {}
            for i, k in enumerate(keys):
                place.setdefault(k, []).append(i)
            for k, at in place.items():
                if k not in sums:
                    if len(sums) >= _GROUPS:
                        yield from out()
                    sums[k] = np.zeros((2 * len(metrics), n_boot), np.int64)
                for x in range(0, len(at), _ROWS):
                    part = np.array(at[x : x + _ROWS])
                    w = poisson_weights([i[part] for i in ids], reps, seed)
                    sums[k][0::2] += units[:, part] @ w
                    sums[k][1::2] += there[:, part] @ w
        yield from out()

    parts = rows.mapInArrow(run, schema)
    # sums of many tasks may pass 64 bits
    total = parts.groupBy(*by, "_rep").agg(*[F.sum(F.col(f.name).cast("decimal(28,0)")).alias(f.name) for f in fields[1:]])
    means = total.select(*by, *[F.try_divide(F.col(f"_{m}_swx").cast("double"), F.col(f"_{m}_sw").cast("double") * UNIT).alias(m) for m in metrics])
    ci = means.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[
        F.percentile(m, p).alias(f"{m}_ci_{end}") for m in metrics for end, p in (("lo", alpha / 2), ("hi", 1 - alpha / 2))])
    return ci.drop("_n")


def bootstrap_ci_sql(source: str, by: list[str], metrics: list[str], id_cols: list[str], n_boot: int = N_BOOT,
                     alpha: float = ALPHA, seed: int = SEED) -> str:
    """DuckDB twin of ``bootstrap_ci`` (a SELECT over ``source``)."""
    p = PRIME

    def fifth(x: str) -> str:
        return f"((({x} * {x}) % {p}) * (({x} * {x}) % {p}) % {p} * {x} % {p})"

    steps, last = [], str(seed)
    for k, i in enumerate(id_cols):
        steps.append((f"_h{k}", f"({last} + ({i} % {p}) * {NEXT if k else FIRST}) % {p}"))
        last = fifth(f"_h{k}")
    chain = f"SELECT * FROM {source}"
    for name, value in steps:
        chain = f"SELECT *, CAST({value} AS BIGINT) AS {name} FROM ({chain})"
    chain = f"SELECT *, CAST({last} AS BIGINT) AS _x FROM ({chain})"
    chain = f"SELECT s.*, r._rep, CAST((_x + r._rep * {REPLICATE}) % {p} AS BIGINT) AS _y FROM ({chain}) s, (SELECT unnest(range(1, {n_boot} + 1)) AS _rep) r"
    chain = f"SELECT *, CAST(({fifth('_y')} + {BETWEEN}) % {p} AS BIGINT) AS _z FROM ({chain})"
    weight = " + ".join(f"CAST(_u >= {t} AS INTEGER)" for t in poisson1_thresholds())
    chain = f"SELECT *, {weight} AS _w FROM (SELECT *, {fifth('_z')} AS _u FROM ({chain}))"
    keys = "".join(k + ", " for k in by)
    sums = ", ".join(f"sum(_w * TRY_CAST({m} AS DECIMAL(28, 9))) AS _{m}_swx, sum(CASE WHEN {m} IS NOT NULL THEN _w END) AS _{m}_sw" for m in metrics)
    means = ", ".join(f"CASE WHEN _{m}_sw = 0 THEN NULL ELSE CAST(_{m}_swx AS DOUBLE) / CAST(_{m}_sw AS DOUBLE) END AS {m}" for m in metrics)
    ends = ", ".join(f"quantile_cont({m}, {alpha / 2}) AS {m}_ci_lo, quantile_cont({m}, {1 - alpha / 2}) AS {m}_ci_hi" for m in metrics)
    group = "GROUP BY " + ", ".join(by) if by else ""
    return f"SELECT {keys}{ends} FROM (SELECT {keys}{means} FROM (SELECT {keys}_rep, {sums} FROM ({chain}) GROUP BY {keys}_rep)) {group}"

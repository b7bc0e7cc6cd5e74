"""The query catalog: Spark plans and their DuckDB twins, by name.

Every query reads the scale-factor tables (or data Spark derives from
them) in full.  Doubles are rounded to 6 decimals on both sides so value
hashes compare at that precision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports as rp
from ..operators.scoring import score_pairs
from .oracle import scored_ctes, with_run_log
from .run_log import run_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the run log always has tokens_per_sec: no test whether the whole column is null
    return score_pairs(run_log(spark, sf_dir), derive_tps=False)


def scored_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 first: only the pairs of the chosen top_k are scored."""
    return score_pairs(rp.topk_filter(run_log(spark, sf_dir)), derive_tps=False)


def _r(x: str, digits: int = 6) -> str:
    """Half-up rounding of the shortest decimal form, as Spark's round does."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


def _avg(x: str) -> str:
    return f"avg(TRY_CAST({x} AS DECIMAL(28, 9)))"


# ---------------------------------------------------------------- run log
register("run_log", with_run_log() + " SELECT * FROM run_log")(
    lambda spark, sf: rp.round_doubles(run_log(spark, sf)))

# ---------------------------------------------------------------- scoring
SCORE_COLS = ["pair_id", "EM", "F1", "ROUGE_L", "LEV_SIM", "ACC_rouge70", "ACC_lev80",
              "q_len", "gold_len", "pred_len", "latency_total_s", "latency_retrieval_s",
              "latency_generation_s", "tokens_per_sec"]
_SCORE_DOUBLES = {"F1", "ROUGE_L", "LEV_SIM", "latency_total_s", "latency_retrieval_s",
                  "latency_generation_s", "tokens_per_sec"}
# nullable counts leave both engines as doubles (pandas turns a nullable
# integer into float64 on one side and Int64 on the other)
_NULLABLE_COUNTS = ("q_len", "gold_len", "pred_len")
_SCORE_SQL = with_run_log(scored_ctes()) + " SELECT " + ", ".join(
    f"{_r(c)} AS {c}" if c in _SCORE_DOUBLES else (f"CAST({c} AS DOUBLE) AS {c}" if c in _NULLABLE_COUNTS else c)
    for c in SCORE_COLS) + " FROM scored"


@register("score_pairs", _SCORE_SQL)
def q_score_pairs(spark, sf):
    d = scored(spark, sf).select(*[F.col(c).cast("double").alias(c) if c in _NULLABLE_COUNTS else F.col(c)
                                   for c in SCORE_COLS])
    return rp.round_doubles(d)


# ---------------------------------------------------------------- reports (A1/A3)
def _means_sql(keys: list[str], source: str = "scored", where: str = "", raw: bool = False) -> str:
    aggs = ["count(question) AS n"] + [f"{_avg(src) if raw else _r(_avg(src))} AS {name}" for name, src in rp.MEAN_SPEC]
    k = ", ".join(keys)
    return f"SELECT {k}, {', '.join(aggs)} FROM {source} {where} GROUP BY {k}"


def _report_query(keys):
    def q(spark, sf):
        return rp.round_doubles(rp.agg_means(scored(spark, sf), keys))
    return q


for _name, _keys in rp.REPORT_KEYSETS.items():
    if _name == "by_question":  # same keys as by_qindex10
        continue
    register(f"report_{_name}", with_run_log(scored_ctes()) + " " + _means_sql(_keys))(_report_query(_keys))


def _family_sql() -> str:
    keysets = rp.report_keysets(rp.COMBO_ORDER + ["question"])
    uniq: dict[tuple, list[str]] = {}
    for name, keys in keysets.items():
        uniq.setdefault(tuple(keys), []).append(name)
    all_keys = list(dict.fromkeys(k for ks in uniq for k in ks))
    sets = ", ".join("(" + ", ".join(ks) + ")" for ks in uniq)
    names = []
    for ks, nm in uniq.items():
        g = sum(1 << (len(all_keys) - 1 - i) for i, k in enumerate(all_keys) if k not in ks)
        names += [f"({g}, '{n}')" for n in nm]
    aggs = ["count(question) AS n"] + [f"{_r(_avg(src))} AS {name}" for name, src in rp.MEAN_SPEC]
    return (with_run_log(scored_ctes(), f"names(_gid, report) AS (VALUES {', '.join(names)})",
                         f"fam AS (SELECT {', '.join(all_keys)}, grouping_id({', '.join(all_keys)}) AS _gid, "
                         f"{', '.join(aggs)} FROM scored GROUP BY GROUPING SETS ({sets}))")
            + " SELECT fam.* EXCLUDE (_gid), names.report FROM fam JOIN names USING (_gid)")


@register("report_family", _family_sql())
def q_report_family(spark, sf):
    return rp.round_doubles(rp.report_family_means(scored(spark, sf)))


# ---------------------------------------------------------------- A4 config means
_CFG_KEYS = ["llm", "embedding", "language", "top_k"]


@register("config_means", with_run_log() + " SELECT " + ", ".join(_CFG_KEYS) + ", " + ", ".join(
    f"{_r(_avg(m))} AS {m}" for m in rp.CONFIG_METRICS) + " FROM run_log GROUP BY " + ", ".join(_CFG_KEYS))
def q_config_means(spark, sf):
    return rp.round_doubles(rp.config_means(run_log(spark, sf)))


# ---------------------------------------------------------------- A5 correlations
def _corr_sql() -> str:
    cols = []
    for name, x, y in rp.CORRELATIONS:
        both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
        xv, yv = f"CASE WHEN {both} THEN CAST({x} AS DOUBLE) END", f"CASE WHEN {both} THEN CAST({y} AS DOUBLE) END"
        r = (f"CASE WHEN stddev_pop({xv}) * stddev_pop({yv}) = 0 THEN NULL ELSE "
             f"covar_pop({xv}, {yv}) / (stddev_pop({xv}) * stddev_pop({yv})) END")
        cols.append(f"{_r(r)} AS {name}")
    return with_run_log(scored_ctes()) + " SELECT " + ", ".join(cols) + " FROM scored"


@register("correlations", _corr_sql())
def q_correlations(spark, sf):
    return rp.round_doubles(rp.correlations(scored(spark, sf)))


# ---------------------------------------------------------------- F1 + O1 + W2
_TOPK_WHERE = ("WHERE top_k = 3 OR NOT EXISTS (SELECT 1 FROM scored WHERE top_k = 3)")
_LLE = ["language", "llm", "embedding"]


@register("lang_llm_emb_topk3", with_run_log(scored_ctes()) + " " + _means_sql(_LLE, where=_TOPK_WHERE))
def q_lang_llm_emb(spark, sf):
    return rp.round_doubles(rp.agg_means(scored_top_k(spark, sf), _LLE))


def _ranked_sql(outer: str) -> str:
    """Rank the means as they are, round last."""
    means = ", ".join(f"{_r(name)} AS {name}" for name, _ in rp.MEAN_SPEC)
    return (with_run_log(scored_ctes(), f"t AS ({_means_sql(_LLE, where=_TOPK_WHERE, raw=True)})")
            + f" SELECT {', '.join(_LLE)}, n, {means} FROM ({outer})")


_RANK = ", ".join(f"round({m}, {rp.RANK_DIGITS}) DESC NULLS LAST" for m in ("ROUGE_L_mean", "EM_mean"))


@register("leaderboard_top15", _ranked_sql(
    f"SELECT * FROM t ORDER BY {_RANK}, language ASC NULLS FIRST, llm ASC NULLS FIRST, embedding ASC NULLS FIRST LIMIT 15"))
def q_leaderboard(spark, sf):
    return rp.round_doubles(rp.leaderboard(rp.agg_means(scored_top_k(spark, sf), _LLE)))


@register("best_per_language", _ranked_sql(
    f"SELECT * EXCLUDE (_rn) FROM (SELECT t.*, row_number() OVER (PARTITION BY language ORDER BY {_RANK}, "
    "llm ASC NULLS FIRST, embedding ASC NULLS FIRST) AS _rn FROM t) WHERE _rn = 1"))
def q_best_per_language(spark, sf):
    return rp.round_doubles(rp.best_per_language(rp.agg_means(scored_top_k(spark, sf), _LLE)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)


def _load_all() -> None:
    # importing the plan modules registers their queries
    from . import data_queries, file_queries, more_queries  # noqa: F401

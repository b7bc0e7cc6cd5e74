"""Grouped reports over scored rows: A1, A3, A4, A5, F1, O1, W2.

Means are ordinary partial+final aggregates (map-side combine, shuffle of
one row per group and map task).  Null keys form their own group, as in the
original (``dropna=False``).  Bootstrap intervals come from
``operators.bootstrap`` and are joined on the keys with null-safe equality.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Report columns and the metric each one averages, in order.
MEAN_SPEC = [
    ("EM_mean", "EM"),
    ("F1_mean", "F1"),
    ("ROUGE_L_mean", "ROUGE_L"),
    ("LEV_SIM_mean", "LEV_SIM"),
    ("ACC_rouge70", "ACC_rouge70"),
    ("ACC_lev80", "ACC_lev80"),
    ("gold_score_mean", "gold_score_0_10"),
    ("fact_cons_mean", "factual_consistency_0_10"),
    ("halluc_rate_mean", "hallucination_rate_0_1"),
    ("groundedness_mean", "groundedness_pred_0_1"),
    ("retrieval_support_mean", "retrieval_support_gold_0_1"),
    ("lat_total_s_mean", "latency_total_s"),
    ("lat_gen_s_mean", "latency_generation_s"),
    ("lat_ret_s_mean", "latency_retrieval_s"),
    ("tok_total_mean", "total_tokens"),
    ("tok_prompt_mean", "prompt_tokens"),
    ("tok_comp_mean", "completion_tokens"),
    ("tps_mean", "tokens_per_sec"),
]
CI_METRICS = ["EM", "F1", "ROUGE_L"]

# The report family (name -> key columns) of the analysis.
REPORT_KEYSETS = {
    "by_db_lang": ["db_lang"],
    "by_answer_lang": ["language"],
    "by_qindex10": ["q_index10"],
    "by_db_vs_qindex10": ["db_lang", "q_index10"],
    "by_anslang_vs_qindex10": ["language", "q_index10"],
    "by_db_vs_answer_lang": ["db_lang", "language"],
    "by_llm": ["llm"],
    "by_embedding": ["embedding"],
    "by_topk": ["top_k"],
    "by_db_answer_llm_emb_k_qi": ["db_lang", "language", "llm", "embedding", "top_k", "q_index10"],
    "by_question": ["q_index10"],
    "by_question_lang_embedding": ["q_index10", "language", "embedding"],
}
COMBO_ORDER = ["db_lang", "language", "llm", "embedding", "top_k", "q_index10"]
CORRELATIONS = [
    ("EM_vs_lat_total", "EM", "latency_total_s"),
    ("F1_vs_lat_total", "F1", "latency_total_s"),
    ("ROUGE_vs_lat_total", "ROUGE_L", "latency_total_s"),
    ("EM_vs_tokens", "EM", "total_tokens"),
    ("F1_vs_tokens", "F1", "total_tokens"),
    ("ROUGE_vs_tokens", "ROUGE_L", "total_tokens"),
    ("ROUGE_vs_groundedness", "ROUGE_L", "groundedness_pred_0_1"),
    ("ROUGE_vs_retrievalsup", "ROUGE_L", "retrieval_support_gold_0_1"),
    ("Halluc_vs_fact", "hallucination_rate_0_1", "factual_consistency_0_10"),
]
CONFIG_METRICS = [
    "latency_total_ms", "latency_retrieval_ms", "latency_generation_ms",
    "prompt_tokens", "completion_tokens", "total_tokens", "tokens_per_sec",
    "gold_score_0_10", "factual_consistency_0_10", "hallucination_rate_0_1",
]


MEAN_DECIMAL = "decimal(28,9)"


def exact_mean(c) -> Column:
    """Mean summed in decimal: associative, so the result does not depend on
    partitioning or task order (double sums do, in the last bits)."""
    c = F.col(c) if isinstance(c, str) else c
    v = c.try_cast(MEAN_DECIMAL)
    return decimal_mean(F.sum(v), F.count(v))


def decimal_mean(total: Column, n: Column) -> Column:
    """total / n, divided in decimal at 19 places and only then made a double, so that a tie rounds as it should."""
    return F.try_divide(total.cast(MEAN_DECIMAL), n).cast("double")


def _mean_or_null(df: DataFrame, src: str) -> Column:
    # a metric column that is absent (v1 logs) reports as null, not an error
    return exact_mean(src) if src in df.columns else F.lit(None).cast("double")


def mean_exprs(df: DataFrame, spec=MEAN_SPEC) -> list[Column]:
    return [F.count("question").alias("n")] + [_mean_or_null(df, src).alias(name) for name, src in spec]


def agg_means(scored: DataFrame, by: list[str], spec=MEAN_SPEC) -> DataFrame:
    """A1: n = non-null questions, then the metric means per group."""
    return scored.groupBy(*by).agg(*mean_exprs(scored, spec))


def agg_with_ci(scored: DataFrame, by: list[str], id_cols: list[str] | None = None, **ci_kw) -> DataFrame:
    """A1 + A2: means joined to the bootstrap intervals of EM, F1, ROUGE_L.

    The narrow columns the two aggregates need (keys, metrics, ids - no
    text) are checkpointed once so the scoring stage runs once.
    """
    from .bootstrap import bootstrap_ci
    from .partitioning import materialize
    need = list(dict.fromkeys([*by, "question", *[s for _, s in MEAN_SPEC], *(id_cols or [])]))
    # the question text only feeds count(question): keep a flag instead
    scored = materialize(scored.select(*[F.col(c).isNotNull().alias(c) if c == "question" else F.col(c)
                                         for c in need if c in scored.columns]))
    scored = scored.withColumn("question", F.when(F.col("question"), F.lit("q")))
    return join_on_keys(agg_means(scored, by), bootstrap_ci(scored, by, CI_METRICS, id_cols, **ci_kw), by)


def join_on_keys(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Equi-join on the group keys with null-safe equality (null groups kept)."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in by],
                     *[c for c in right.columns if c not in by])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"_r_{k}"]) for k in by]) if by else F.lit(True)
    return left.join(r, cond, "left").drop(*[f"_r_{k}" for k in by])


def report_keysets(columns: list[str]) -> dict[str, list[str]]:
    """A3: the reports whose keys exist (schema test on the driver, no job)."""
    have = set(columns)
    out = {name: keys for name, keys in REPORT_KEYSETS.items() if set(keys) <= have}
    combo = [c for c in COMBO_ORDER if c in have]
    if combo:
        out["by_db_answer_llm_emb_k_qi"] = combo
    return out


def report_family_means(scored: DataFrame, keysets: dict[str, list[str]] | None = None) -> DataFrame:
    """A3 in one pass over the scored rows: GROUPING SETS over every key set.

    Returns a long table with ``report`` naming the key set; split it with
    ``split_family``.
    """
    keysets = keysets or report_keysets(scored.columns)
    uniq: dict[tuple, list[str]] = {}
    for name, keys in keysets.items():
        uniq.setdefault(tuple(keys), []).append(name)
    # grouping_id takes the keys in their order of first appearance
    all_keys = list(dict.fromkeys(k for ks in uniq for k in ks))
    # sums and counts at the finest key set first: what the key sets multiply is that small table, without any text
    metrics = [(name, src) for name, src in MEAN_SPEC if src in scored.columns]
    value = {name: F.col(src).try_cast(MEAN_DECIMAL) for name, src in metrics}
    fine = scored.groupBy(*all_keys).agg(F.count("question").alias("n"), *[
        c for name, _ in metrics for c in (F.sum(value[name]).alias(f"_s_{name}"), F.count(value[name]).alias(f"_n_{name}"))])
    fam = fine.groupingSets([[F.col(k) for k in ks] for ks in uniq], *[F.col(k) for k in all_keys]).agg(
        F.grouping_id(*all_keys).alias("_gid"), F.sum("n").alias("n"),
        *[decimal_mean(F.sum(f"_s_{name}"), F.sum(f"_n_{name}")).alias(name) for name, _ in metrics])
    fam = fam.select(*all_keys, "_gid", "n", *[F.col(name) if src in scored.columns else F.lit(None).cast("double").alias(name) for name, src in MEAN_SPEC])
    # map grouping ids to report names (bit i set = key i not grouped)
    rows = []
    for ks, names in uniq.items():
        g = sum(1 << (len(all_keys) - 1 - i) for i, k in enumerate(all_keys) if k not in ks)
        for name in names:
            rows.append((g, name))
    names_df = scored.sparkSession.createDataFrame(rows, "_gid long, report string")
    return fam.join(F.broadcast(names_df), "_gid").drop("_gid")


def split_family(family: DataFrame, keysets: dict[str, list[str]]) -> dict[str, DataFrame]:
    cols = [name for name, _ in MEAN_SPEC]
    return {name: family.where(F.col("report") == name).select(*keys, "n", *cols)
            for name, keys in keysets.items()}


def config_means(df: DataFrame, by=("llm", "embedding", "language", "top_k"),
                 metrics=CONFIG_METRICS) -> DataFrame:
    """A4: mean of the run-log metrics per configuration, null keys kept."""
    return df.groupBy(*by).agg(*[exact_mean(m).alias(m) for m in metrics if m in df.columns])


def pearson(x: str, y: str) -> Column:
    """A5: pairwise-complete Pearson r; null for constant or single-row input.

    ``corr`` raises on a constant column under ANSI mode, so it is written
    as covariance over the product of deviations, on jointly non-null rows.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xv = F.when(both, F.col(x).cast("double"))
    yv = F.when(both, F.col(y).cast("double"))
    return F.try_divide(F.covar_pop(xv, yv), F.stddev_pop(xv) * F.stddev_pop(yv))


def correlations(scored: DataFrame) -> DataFrame:
    """A5: the nine correlations as one row (one global aggregate)."""
    cols = []
    for name, x, y in CORRELATIONS:
        if x in scored.columns and y in scored.columns:
            cols.append(pearson(x, y).alias(name))
        else:
            cols.append(F.lit(None).cast("double").alias(name))
    return scored.agg(*cols)


def topk_filter(df: DataFrame, k: int = 3, col: str = "top_k") -> DataFrame:
    """rows with top_k == k, or every row when none has it (one plan).

    The flag is a one-row global aggregate broadcast to the rows.
    """
    if col not in df.columns:
        return df
    kval = col + "_num"
    d = df.withColumn(kval, F.col(col).cast("string").try_cast("double"))
    flag = d.agg(F.max((F.col(kval) == k).cast("int")).alias("_any_k"))
    return (d.crossJoin(F.broadcast(flag))
             .where((F.col(kval) == k) | F.coalesce(F.col("_any_k"), F.lit(0)).__eq__(0))
             .drop(kval, "_any_k"))


def lang_llm_emb_table(scored: DataFrame, with_ci: bool = False, **ci_kw) -> DataFrame:
    """The (language, llm, embedding) table over top_k == 3 rows (F1 + A1)."""
    d = topk_filter(scored)
    by = ["language", "llm", "embedding"]
    return agg_with_ci(d, by, **ci_kw) if with_ci else agg_means(d, by)


#: Means are compared at full precision but for the last digits, in which engines differ by the order of a division.
RANK_DIGITS = 12


def _rank(mean: str) -> Column:
    return F.round(mean, RANK_DIGITS).desc_nulls_last()


def leaderboard(table: DataFrame, n: int = 15) -> DataFrame:
    """O1: ROUGE_L desc, EM desc, explicit key tie-break, first n (TakeOrderedAndProject); see RANK_DIGITS."""
    return table.orderBy(_rank("ROUGE_L_mean"), _rank("EM_mean"),
                         F.col("language").asc_nulls_first(), F.col("llm").asc_nulls_first(),
                         F.col("embedding").asc_nulls_first()).limit(n)


def best_per_language(table: DataFrame) -> DataFrame:
    """Per language, the configuration with the best ROUGE_L then EM."""
    w = Window.partitionBy("language").orderBy(
        _rank("ROUGE_L_mean"), _rank("EM_mean"),
        F.col("llm").asc_nulls_first(), F.col("embedding").asc_nulls_first())
    return table.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (value hashes compare at this precision)."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])

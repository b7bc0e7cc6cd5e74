"""Score every answer pair of a run log in one narrow stage.

Normalised text is computed once as a column and reused by every scorer.
Exact match, lengths and coercions are JVM expressions; token F1, ROUGE-L
and Levenshtein similarity leave the JVM once per Arrow batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.columns import ms_to_s, safe_double

# Columns coerced to numbers before reporting.
NUMERIC_COLUMNS = [
    "top_k", "prompt_tokens", "completion_tokens", "total_tokens", "tokens_per_sec",
    "gold_score_0_10", "factual_consistency_0_10", "hallucination_rate_0_1",
    "groundedness_pred_0_1", "retrieval_support_gold_0_1",
    "latency_total_ms", "latency_retrieval_ms", "latency_generation_ms",
]
LATENCY_COLUMNS = ["latency_total_ms", "latency_retrieval_ms", "latency_generation_ms"]
METRIC_COLUMNS = ["EM", "F1", "ROUGE_L", "LEV_SIM", "ACC_rouge70", "ACC_lev80"]


def add_text_scores(df: DataFrame, pred: str = "predicted_answer", gold: str = "gold_answer") -> DataFrame:
    """EM, F1, ROUGE_L, LEV_SIM (each the best over references) and the soft accuracies."""
    keep = [F.col(c) for c in df.columns]
    d = df.select(*keep, tx.normalize_text(pred).alias("_pred_n"),
                  F.transform(tx.parse_refs(gold), tx.normalize_text).alias("_refs_n"))
    d = d.select(*keep, "_pred_n", "_refs_n",
                 tx.best_of_refs("_pred_n", "_refs_n", tx.exact_match_norm).alias("EM"),
                 tx.pair_scores("_pred_n", "_refs_n").alias("_s"))
    d = d.select(*keep, "EM", F.col("_s.F1").alias("F1"), F.col("_s.ROUGE_L").alias("ROUGE_L"), F.col("_s.LEV_SIM").alias("LEV_SIM"))
    return d.select(*keep, "EM", "F1", "ROUGE_L", "LEV_SIM",
                    (F.col("ROUGE_L") >= tx.ROUGE_ACC_THRESHOLD).cast("int").alias("ACC_rouge70"),
                    (F.col("LEV_SIM") >= tx.LEV_ACC_THRESHOLD).cast("int").alias("ACC_lev80"))


def score_pairs(df: DataFrame, derive_tps: bool = True) -> DataFrame:
    """build_metrics: numeric coercion, seconds, lengths, text scores, tps fallback."""
    types = dict(df.dtypes)
    d = df
    # one projection for the coercions, seconds and lengths; integral columns
    # stay integral (to_numeric keeps them), text and floats become doubles
    integral = {"tinyint", "smallint", "int", "bigint"}
    cols = [safe_double(c, types[c]).alias(c) if c in NUMERIC_COLUMNS and types[c] not in integral else F.col(c)
            for c in df.columns]
    cols += [ms_to_s(safe_double(c, types[c])).alias(c.replace("_ms", "_s")) for c in LATENCY_COLUMNS if c in types]
    cols += [tx.token_len("question").alias("q_len"), tx.token_len("gold_answer").alias("gold_len"),
             tx.token_len("predicted_answer").alias("pred_len")]
    d = d.select(*cols)
    d = add_text_scores(d)
    if derive_tps and "completion_tokens" in types and "latency_generation_ms" in types:
        derived = F.try_divide(F.col("completion_tokens"), F.col("latency_generation_s"))
        if "tokens_per_sec" not in types:
            d = d.withColumn("tokens_per_sec", derived)
        else:
            # P20: derive only when the whole column is null.  The test is a
            # one-row global aggregate over the input column alone (pruned
            # scan, no scoring), broadcast back (size bound: one row).
            flag = df.agg((F.count(safe_double("tokens_per_sec", types["tokens_per_sec"])) == 0)
                          .alias("_tps_all_null"))
            d = (d.crossJoin(F.broadcast(flag))
                  .withColumn("tokens_per_sec",
                              F.when(F.col("_tps_all_null"), derived).otherwise(F.col("tokens_per_sec")))
                  .drop("_tps_all_null"))
    return d

"""3.1 (the flagship): run log -> every report, written once.

The run log is scored once (the only Python stage) and its narrow columns
(keys and metrics, no text) are checkpointed; every report then reads that
small table.  All report means come from one GROUPING SETS pass; bootstrap
intervals are computed per report (each is one shuffle on its keys); the
leaderboard is a top-15 and the correlations one global aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fmt_pct
from ..operators import reports as rp
from ..operators.partitioning import materialize
from ..operators.positions import question_index_cyclic, with_row_position
from ..operators.scoring import score_pairs
from ..sinks.writers import write_reports

_TEXT = {"question", "gold_answer", "predicted_answer", "gold_feedback"}


def question_key(df: DataFrame, order_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """question_id, else q_index10, else a cyclic index over row order."""
    if "question_id" in df.columns:
        return df, "question_id"
    if "q_index10" in df.columns:
        return df, "q_index10"
    if not order_by:
        raise ValueError("no question key column: pass order_by to derive q_index10 from row order")
    d = with_row_position(df, order_by, "_pos")
    return d.withColumn("q_index10", question_index_cyclic("_pos")).drop("_pos"), "q_index10"


def analyse(run_log: DataFrame, out_dir: str | None = None, with_ci: bool = True, n_boot: int = 2000,
            seed: int = 42, id_cols: list[str] | None = None, order_by: list[str] | None = None,
            fmt: str = "parquet") -> dict[str, DataFrame]:
    scored = score_pairs(run_log)
    scored, qkey = question_key(scored, order_by)
    keep = [c for c in scored.columns if c not in _TEXT]
    narrow = materialize(scored.select(*keep, F.col("question").isNotNull().alias("_has_q")))
    narrow = narrow.withColumn("question", F.when(F.col("_has_q"), F.lit("q"))).drop("_has_q")

    keysets = rp.report_keysets(narrow.columns)
    keysets["by_question"] = [qkey]
    if {"language", "embedding"} <= set(narrow.columns):
        keysets["by_question_lang_embedding"] = [qkey, "language", "embedding"]
    family = materialize(rp.report_family_means(narrow, keysets))
    tables = rp.split_family(family, keysets)
    ci_kw = dict(n_boot=n_boot, seed=seed, id_cols=id_cols)
    if with_ci:
        from ..operators.bootstrap import bootstrap_ci
        tables = {name: rp.join_on_keys(t, bootstrap_ci(narrow, keysets[name], rp.CI_METRICS, **ci_kw),
                                        keysets[name]) for name, t in tables.items()}
    if {"language", "llm", "embedding"} <= set(narrow.columns):
        lle = rp.lang_llm_emb_table(narrow, with_ci=with_ci, **(ci_kw if with_ci else {}))
        tables["leaderboard_top15"] = rp.leaderboard(lle)
        tables["by_language_best_llm_embedding_topk3"] = rp.best_per_language(lle)
    tables["correlations"] = rp.correlations(narrow)
    if out_dir:
        write_reports(tables, out_dir, fmt)
    return tables


def summary_lines(tables: dict[str, DataFrame]) -> list[str]:
    """The console summary from the (small) report tables."""
    out = []
    for name, key, label in [("by_db_lang", "db_lang", "corpus language"),
                             ("by_answer_lang", "language", "answer language")]:
        if name in tables:
            out.append(f"ROUGE-L by {label}:")
            for r in tables[name].orderBy(F.col("ROUGE_L_mean").desc()).select(
                    key, "ROUGE_L_mean", fmt_pct("EM_mean").alias("em"), "n").collect():
                out.append(f"  {r[key]}: ROUGE-L={r['ROUGE_L_mean']:.3f}  EM={r['em']}  (n={r['n']})")
    if "leaderboard_top15" in tables:
        best = tables["leaderboard_top15"].first()
        if best is not None:
            out.append(f"Best configuration: language={best['language']}, llm={best['llm']}, "
                       f"embedding={best['embedding']}  ROUGE-L={best['ROUGE_L_mean']:.3f}")
    return out

"""3.1 end to end on the sf0.01 run log, plus the small column helpers."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF_MID
from qaspark.functions import columns as cl
from qaspark.plans.analyse import analyse, summary_lines
from qaspark.plans.run_log import run_log


def test_analyse_writes_every_report(spark):
    out = tempfile.mkdtemp(prefix="qaspark-reports-")
    tables = analyse(run_log(spark, SF_MID), out, n_boot=200, id_cols=["conv_id", "turn"], order_by=["pair_id"])
    for name in ["by_llm", "by_answer_lang", "by_db_answer_llm_emb_k_qi", "leaderboard_top15",
                 "by_language_best_llm_embedding_topk3", "correlations", "by_question"]:
        assert name in tables
    by_llm = spark.read.parquet(f"{out}/by_llm")
    assert by_llm.count() == 3 and "ROUGE_L_ci_hi" in by_llm.columns
    assert spark.read.parquet(f"{out}/leaderboard_top15").count() == 15
    assert any(line.startswith("Best configuration") for line in summary_lines(tables))


def test_question_key_derived(spark):
    d = run_log(spark, SF_MID).drop("q_index10")
    t = analyse(d, None, with_ci=False, order_by=["pair_id"])
    assert t["by_question"].count() == 10


def test_column_helpers(spark):
    df = spark.createDataFrame([("Ada", 3, "Synopsis", "Grace", None, "  text  ")],
                               "t string, e int, s string, p string, f string, x string")
    r = df.select(cl.record_text("t", "e", "s", "p").alias("doc"), cl.episode_file("e").alias("fn"),
                  cl.source_snippet("x", "f").alias("sn"), cl.fmt_pct(F.lit(0.1234)).alias("pct")).first()
    assert r["doc"].startswith("Título: Ada\nTemporada: 1\nEpisodio: 3\n") and r["fn"] == "s01e03.txt"
    assert r["sn"]["file"] == "desconocido" and r["sn"]["text"] == "text" and r["pct"] == "12.3%"
    wide = spark.createDataFrame([(1, 2, 3, 4)], "zeta int, question int, alpha int, run_id int")
    assert cl.preferred_order(wide).columns == ["run_id", "question", "alpha", "zeta"]
    assert cl.norm_col(" Nº  de Pregunta ") == "no_de_pregunta"

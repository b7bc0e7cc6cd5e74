"""S3-S5/A7/A8/U1 on messy files written to a temp folder; streaming ingest; SQL functions."""

import os
import tempfile

import pytest

from qaspark.functions.register import register
from qaspark.plans.ingest import aggregate_with_audit
from qaspark.sources.files import json_records, json_union, scan_lines
from qaspark.streaming.ingest import start_ingest

CSV_A = ('﻿Question,Gold Answer,Predicted Answer,Language\n'
         'q1,"a, with comma","He said ""hi""",es\n'
         'q2,g2,p2,es,EXTRA\n'
         'q3,g3\n'
         '\n'
         'q4,g4,p4,es\n')
TSV_B = 'question\tgold_answer\tscore\nq5\tg5\t7\nq6\tg6\t8\n'
SEMI = 'Question;Gold Answer\nq7;"x;y"\n'
PIPE = 'question|gold_answer\nq8|g8\n'
JSONL = '{"question": "q9", "Gold Answer": "g9"}\n42\n{bad\n\n{"question": "q10"}\n'


def _write(root, rel, text, enc="utf-8"):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding=enc, newline="") as f:
        f.write(text)


@pytest.fixture(scope="module")
def messy():
    root = tempfile.mkdtemp(prefix="qaspark-messy-")
    _write(root, "bench_out_es/results_a.csv", CSV_A)
    _write(root, "bench_out_en/results_b.tsv", TSV_B)
    _write(root, "c.csv", SEMI)
    _write(root, "d.csv", PIPE)
    _write(root, "e.jsonl", JSONL)
    return root


def test_audit(spark, messy):
    table, audit = aggregate_with_audit(spark, messy)
    a = {r["file"]: r for r in audit.collect()}
    ra = a["bench_out_es/results_a.csv"]
    assert ra["delimiter"] == "," and ra["n_rows_data"] == 5 and ra["n_bad_rows_parse"] == 3
    assert ra["bad_examples"].split(" || ")[0].startswith("q2")
    assert a["bench_out_en/results_b.tsv"]["delimiter"] == "\t"
    assert a["c.csv"]["delimiter"] == ";" and a["c.csv"]["n_bad_rows_parse"] == 0
    assert a["d.csv"]["delimiter"] == "|"
    # expected = first file's columns (lowest path: bench_out_en/results_b.tsv)
    assert a["c.csv"]["cols_missing"] == "score"
    assert a["bench_out_es/results_a.csv"]["cols_found_count"] == 4


def test_union(spark, messy):
    table, _ = aggregate_with_audit(spark, messy)
    cols = table.columns
    assert cols[:3] == ["question", "gold_answer", "score"]
    assert cols[3:5] == ["predicted_answer", "language"] and cols[-1] == "source_file"
    rows = {r["question"]: r for r in table.collect()}
    assert "q2" not in rows                                    # long row skipped
    assert rows["q1"]["gold_answer"] == "a, with comma"
    assert rows["q1"]["predicted_answer"] == 'He said "hi"'
    assert rows["q3"]["predicted_answer"] is None              # short row
    assert rows["q7"]["gold_answer"] == "x;y" and rows["q7"]["score"] == ""
    assert rows["q9"]["gold_answer"] == "g9" and rows["q10"]["source_file"] == "e.jsonl"
    assert set(rows) >= {"q1", "q3", "q4", "q5", "q6", "q7", "q8", "q9", "q10"}


def test_output_under_input_is_excluded(spark, messy):
    out = os.path.join(messy, "out_run")
    aggregate_with_audit(spark, messy, out, fmt="csv")
    t2, _ = aggregate_with_audit(spark, messy, out, fmt="csv")
    assert not any(r["source_file"].startswith("out_run") for r in t2.select("source_file").collect())


def test_json_scalars_and_corrupt(spark, messy):
    recs = json_union(json_records(scan_lines(spark, messy, "*.jsonl")))
    vals = [r.asDict() for r in recs.collect()]
    assert len(vals) == 3 and any(v.get("value") == "42" for v in vals)


def test_streaming_ingest(spark, messy):
    out = tempfile.mkdtemp(prefix="qaspark-stream-out-")
    ck = tempfile.mkdtemp(prefix="qaspark-stream-ck-")
    _write(messy, "sub/results_a.csv", "question,gold_answer\nsame name,other folder\n")
    columns = ["question", "gold_answer", "score"]
    with pytest.raises(ValueError):
        start_ingest(spark, messy, out, ck, [])
    q = start_ingest(spark, messy, out, ck, columns)
    q.awaitTermination(120)
    audit = spark.read.parquet(f"{out}/audit")
    files = {r["file"] for r in audit.collect()}
    assert sum(f.split("/")[-1] == "results_a.csv" for f in files) == 2 and any(f.split("/")[-1] == "c.csv" for f in files)
    n, rows = audit.count(), spark.read.parquet(f"{out}/aggregate").count()
    # a second run over the same folder processes nothing new; a replayed batch (a new checkpoint begins at 0) overwrites itself
    for folder in (ck, tempfile.mkdtemp(prefix="qaspark-stream-ck-")):
        start_ingest(spark, messy, out, folder, columns).awaitTermination(120)
        assert spark.read.parquet(f"{out}/audit").count() == n and spark.read.parquet(f"{out}/aggregate").count() == rows


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("select qa_em('Hello, World!', 'hello world') em, qa_lev_sim('saxòfon', 'saxofon') lev, "
                  "qa_oneline(qa_strip_reasoning('<think>x</think> Answer  here')) s").first()
    assert r["em"] == 1 and r["lev"] == pytest.approx(6 / 7) and r["s"] == "Answer here"


def test_encoding_fallback(spark):
    root = tempfile.mkdtemp(prefix="qaspark-enc-")
    _write(root, "latin.csv", "question,gold_answer\nq1,café crème\n", enc="cp1252")
    _write(root, "utf.csv", "question,gold_answer\nq2,niño\n")
    lines = scan_lines(spark, root, fallback_encoding="iso-8859-1")
    got = {r["line"] for r in lines.collect()}
    assert "q1,café crème" in got and "q2,niño" in got


def test_bench_outputs_and_results(spark, tmp_path):
    from qaspark.plans.ingest import aggregate_results, union_bench_outputs
    root = str(tmp_path)
    _write(root, "bench_out_ca/r1.csv", "question,llm,embedding,language,top_k,latency_total_ms\nq1,m,e,ca,3,100\n")
    _write(root, "bench_out_es/r2.csv", "question,llm,embedding,language,top_k,latency_total_ms\nq2,m,e,es,3,300\n")
    _write(root, "flat/results_x_k3.csv", "question,llm,embedding,language,top_k,latency_total_ms\nq3,m,e,es,3,x\n")
    u = union_bench_outputs(spark, [f"{root}/bench_out_es", f"{root}/bench_out_ca", f"{root}/missing"])
    rows = u.collect()
    assert u.columns[0] == "db_lang" and [r["db_lang"] for r in rows] == ["ca", "es"]
    t, means = aggregate_results(spark, f"{root}/bench_out_ca")
    assert t.first()["__file"] == "r1.csv" and means.first()["latency_total_ms"] == 100.0
    u2 = union_bench_outputs(spark, [f"{root}/flat"])
    assert u2.first()["db_lang"] == "k3.csv"


def test_writers(spark, tmp_path):
    from qaspark.sinks.writers import write_new, write_run_log
    df = spark.createDataFrame([("s01e01.txt", "Título: x\n"), ("s01e02.txt", "Título: y\n")], "name string, doc string")
    write_run_log(df, str(tmp_path / "log"))
    with pytest.raises(ValueError):
        write_run_log(df.limit(0), str(tmp_path / "empty"))
    p = write_new(df, str(tmp_path / "log"), run_id="r2")
    assert p.endswith("_r2")


def test_read_gold(spark, tmp_path):
    from qaspark.sources.files import read_gold
    p = tmp_path / "gold.csv"
    p.write_text("﻿q_index10;question;gold_answer;language\n1;¿Quién toca el saxòfon?;“Ada”, la hermana;es\n"
                 "2;Who is it?;Grace’s friend;en\n", encoding="utf-8")
    g = read_gold(spark, str(p))
    assert g.columns == ["q_index10", "question", "gold_answer", "language"]
    rows = g.orderBy("q_index10").collect()
    assert rows[0]["gold_answer"] == "“Ada”, la hermana" and rows[1]["language"] == "en"
    bad = tmp_path / "bad.csv"
    bad.write_text("question,answer\nq,a\n", encoding="utf-8")
    with pytest.raises(ValueError):
        read_gold(spark, str(bad))

"""Records over physical lines against Python's csv reader."""

import csv
import gzip
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from qaspark.operators import audit as au
from qaspark.plans.ingest import aggregate_with_audit
from qaspark.sources.files import decode_lines, list_files, read_gold, read_run_log, scan_lines, typed
from qaspark.operators.records import RUN, numbered, stitch


def line_table(spark, files, split_lines=3):
    """Files as physical lines; every ``split_lines`` lines begin another block, every two blocks another split, every two splits another run."""
    rows = [(name, (i // split_lines // 2) << (RUN - 1), i // split_lines, i, line) for name, text in files.items() for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file string, split long, blk long, ord long, line string").repartition(4)


def python_records(text):
    return list(csv.reader(io.StringIO(text, newline=""), escapechar="\\"))


FILES = {
    "a.csv": 'id,text\n1,"hello\nworld"\n2,"x"',
    "b.csv": 'id,text,n\n1,"say \\"hi\\", ok",9\n2,"two ""words"" here",8\n3,5" pipe,7',
    "c.csv": 'a,A,a_2\n1,2,3',
    "d.csv": 'id;text\n1;"a\n\n\nb;c"\n2;"never closed\n3;x\n4;y',
    "e.csv": 'id,text\n1,plain\n2,"one\\\ntwo"\n',
}


def test_probes(spark):
    lines = line_table(spark, FILES)
    audit = {r.file: r for r in au.file_audit(lines).collect()}
    assert (audit["a.csv"].n_rows_data, audit["a.csv"].n_bad_rows_parse) == (2, 0)
    assert (audit["b.csv"].n_rows_data, audit["b.csv"].n_bad_rows_parse) == (3, 0)
    rows = {(r.source_file, r.id): r for r in au.union_normalised(lines).collect()}
    assert rows["a.csv", "1"].text == "hello\nworld" and rows["a.csv", "2"].text == "x"
    assert rows["b.csv", "1"].text == 'say "hi", ok' and rows["b.csv", "1"].n == "9" and rows["b.csv", "2"].text == 'two "words" here'
    assert rows["b.csv", "3"].text == '5" pipe'
    assert rows["d.csv", "1"].text == "a\n\n\nb;c"
    # a quote that is never closed: its line is a bad row, the lines after it are rows
    assert (audit["d.csv"].n_rows_data, audit["d.csv"].n_bad_rows_parse, audit["d.csv"].bad_examples) == (4, 1, '2,"never closed')
    assert rows["d.csv", "3"].text == "x" and rows["d.csv", "4"].text == "y"
    c = [r for r in au.union_normalised(lines).collect() if r.source_file == "c.csv"][0]
    assert (c.a, c.a_2, c.a_3) == ("1", "3", "2") or sorted(v for v in (c.a, c.a_2, c.a_3)) == ["1", "2", "3"]


@pytest.mark.parametrize("split_lines", [1, 2, 5, 1000])
def test_stitched_records_match_csv_reader(spark, split_lines):
    rng = random.Random(split_lines)
    files = {}
    for k in range(12):
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        w.writerow(["id", "text", "note"])
        for i in range(rng.randrange(1, 12)):
            w.writerow([i, "".join(rng.choices(['a', ' ', ',', '"', '\n', 'b'], k=rng.randrange(0, 14))), rng.choice(["", "x", "y\nz"])])
        files[f"{k}.csv"] = out.getvalue().rstrip("\n")
    lines = line_table(spark, files, split_lines).withColumn("delimiter", F.lit(","))
    got = {}
    for r in stitch(lines).orderBy("file", "split", "blk", "ord").collect():
        got.setdefault(r.file, []).extend(python_records(r.line) or [[]])
    assert got == {name: python_records(text) for name, text in files.items()}


def plain_records(text, most):
    """Records of a file, line by line: (lines, closed)."""
    out, open_ = [], []
    for line in text.split("\n"):
        open_.append(line)
        if _closed("\n".join(open_)):
            out.append(open_)
            open_ = []
    groups = [(g, True) for g in out] + ([(open_, False)] if open_ else [])
    done = []
    for g, closed in groups:
        done += [("\n".join(g), True)] if closed and len(g) <= most else [(line, i > 0) for i, line in enumerate(g)]
    return done


def _closed(text):
    inside, begin, i = False, True, 0
    while i < len(text):
        c = text[i]
        if inside and c == "\\":
            i += 1
        elif inside and c == '"':
            if text[i + 1 : i + 2] == '"':
                i += 1
            else:
                inside = False
        elif not inside and begin and c == '"':
            inside = True
        begin = not inside and c == ","
        i += 1
    return not inside


@pytest.mark.parametrize("split_lines", [1, 3, 1000])
def test_every_line_is_in_one_record_and_none_is_longer_than_the_bound(spark, split_lines):
    rng = random.Random(split_lines)
    fields = ['a', '"x"', '"', '"a""b"', '"c', 'd"', '""', 'e']
    files = {f"{k}.csv": "\n".join(",".join(rng.choices(fields, [9, 6, 1, 3, 1, 1, 1, 6], k=rng.randrange(1, 5))) for _ in range(rng.randrange(1, 40))) for k in range(25)}
    d = stitch(line_table(spark, files, split_lines).withColumn("delimiter", F.lit(",")), max_lines=4)
    got = {}
    for r in d.orderBy("file", "split", "blk", "ord").collect():
        got.setdefault(r.file, []).append((r.line, r.closed))
    assert got == {name: plain_records(text, 4) for name, text in files.items()}


def test_record_numbers_and_plan(spark):
    text = "\n".join(['h,t', '1,"a', 'b"', '2,x', '3,"c""', '', 'd",y', '4,"e"'])
    d = numbered(line_table(spark, {"f": text}, 2).withColumn("delimiter", F.lit(",")))
    assert [r.record_no for r in d.orderBy("split", "blk", "ord").collect()] == [1, 2, 2, 3, 4, 4, 4, 5]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"^.*Window \[.*$", plan, re.M)
    assert windows and not any(re.search(r"\], \[file#\d+L?\], \[", w) for w in windows)


def test_encodings_are_told_by_whole_files(spark, tmp_path):
    """One scan; a file whose bytes are not UTF-8 is windows-1252, also in its lines that could be UTF-8."""
    texts = {"u.csv": "id,text\n1,“quoted” é\n2,Ã©\n", "c.csv": "id,text\n1,“quoted” é €\n2,plain Ã©\n3,\"two\nlines ï\"\n", "a.csv": "id,text\n1,ascii\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode("cp1252" if name == "c.csv" else "utf-8-sig" if name == "u.csv" else "ascii"))
    lines = scan_lines(spark, str(tmp_path))
    d = decode_lines(lines)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("_metadata") <= 6 and d._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    got = {}
    for r in d.orderBy("file", "split", "blk", "ord").collect():
        got.setdefault((r.file, r.utf8), []).append(r.line.lstrip("\ufeff"))
    assert got == {(n, n != "c.csv"): t.rstrip("\n").split("\n") for n, t in texts.items()}
    rows = {(r.source_file, r.id): r.text for r in au.union_normalised(lines, fallback_encoding="cp1252").collect()}
    assert rows == {("u.csv", "1"): "“quoted” é", ("u.csv", "2"): "Ã©", ("c.csv", "1"): "“quoted” é €", ("c.csv", "2"): "plain Ã©", ("c.csv", "3"): "two\nlines ï", ("a.csv", "1"): "ascii"}
    every = bytes(range(0x80, 0x100))
    one = spark.createDataFrame([(bytearray(every),)], "b binary").select(F.col("b").cast("string").alias("s"))
    for encoding in au.ENCODINGS:
        want = "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in every)
        assert one.select(au.decoded("s", F.lit(False), encoding)).first()[0] == want


def test_gold_and_run_log_are_read_without_whole_files(spark, tmp_path):
    (tmp_path / "gold.csv").write_bytes("Q_Index10;Question;Gold_Answer;extra\n1;\"¿Qué\nes?\";“a”;x\nx;b\n\n".encode("cp1252"))
    gold = read_gold(spark, str(tmp_path / "gold.csv"))
    assert {tuple(r) for r in gold.collect()} == {(1, "¿Qué\nes?", "“a”", None), (None, "b", None, None)}
    assert "multiLine" not in gold._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="gold_answer"):
        (tmp_path / "bad.csv").write_text("question,x\n1,2\n")
        read_gold(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "run.csv").write_text("\ufeffquestion,top_k,tokens_per_sec,LLM\n\"a, b\",3,1.5,m\nc,x,,\n", encoding="utf-8")
    run = typed(read_run_log(spark, str(tmp_path / "run.csv")))
    assert run.dtypes == [("question", "string"), ("top_k", "int"), ("tokens_per_sec", "double"), ("LLM", "string")]
    assert {tuple(r) for r in run.collect()} == {("a, b", 3, 1.5, "m"), ("c", None, None, None)}


def test_empty_and_unreadable_files_are_audited(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("a,b\n1,2\n")
    (tmp_path / "none.csv").write_bytes(b"")
    (tmp_path / "head.csv").write_text("a,b\n")
    whole = gzip.compress(b"a,b\n" + b"1,2\n" * 50)
    (tmp_path / "broken.csv.gz").write_bytes(whole[:3] + b"\xff" * 40)
    _, audit = aggregate_with_audit(spark, str(tmp_path))
    assert {r.file: (r.status, r.n_rows_data) for r in audit.collect()} == {"ok.csv": ("ok", 1), "none.csv": ("empty", 0), "head.csv": ("no rows", 0)}
    lines = scan_lines(spark, str(tmp_path), "*")
    audit = au.audit_listing(list_files(spark, str(tmp_path), "*"), au.file_audit(lines))
    assert {r.file: (r.status, r.n_rows_data) for r in audit.collect()}["broken.csv.gz"] == ("unreadable", 0)

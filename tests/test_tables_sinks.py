"""Log pairing, the vector table over a changing corpus, files of records, joint publishing."""

import datetime as dt
import os
import random

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from qaspark.operators import inference
from qaspark.operators.latency import paired_latencies
from qaspark.operators.vector_table import VectorTable
from qaspark.plans.ingest import publish_aggregate
from qaspark.sinks.publish import Published
from qaspark.sinks.record_files import read_record_files, write_record_files

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_ends_are_paired_with_the_last_open_start(spark, partitions):
    rng = random.Random(partitions)
    rows = []
    for i in range(600):
        user = 1 if i % 3 == 0 else rng.choice([2, 3, 4, 5, None])  # a third of all events is one user's
        rows.append((i, T0 + dt.timedelta(microseconds=rng.randrange(400) * 1500) if i % 50 else None, user, rng.choice(["start", "end", "other"])))
    want, open_ = {}, {}
    for i, ts, user, kind in sorted((r for r in rows if r[1] and r[2]), key=lambda r: (r[2], r[1], r[0])):
        if kind == "start":
            open_[user] = (i, ts)
        elif kind == "end":
            start = open_.pop(user, None)
            want[i] = (user, start and start[0], start and (ts - start[1]) / dt.timedelta(milliseconds=1))
    d = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, kind string").repartition(5)
    got = paired_latencies(d, F.col("kind") == "start", F.col("kind") == "end", num_partitions=partitions).collect()
    assert {r.end_id: (r.user_id, r.start_id, r.latency_ms) for r in got} == want and len(got) == len(want)


def test_no_events(spark):
    d = spark.createDataFrame([], "event_id long, ts timestamp, user_id long, kind string")
    assert paired_latencies(d, F.col("kind") == "a", F.col("kind") == "b").count() == 0


def test_vector_table_embeds_what_changed(spark, tmp_path, monkeypatch):
    table = VectorTable(spark, str(tmp_path / "v"), ["e0", "e1"])
    first = [(i, "en", f"text number {i}") for i in range(8)] + [(8, "en", "text number 1"), (9, "en", None)]
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert table.update(docs(first)) == 1
    assert table.read().count() == 20 and table.read().select("digest").distinct().count() == 9
    # one changed, one deleted, one new: two texts are embedded for each model
    second = [(i, lang, "changed" if i == 3 else text) for i, lang, text in first if i != 5] + [(10, "es", "new one")]
    assert VectorTable(spark, str(tmp_path / "v"), ["e0", "e1"]).update(docs(second)) == 2
    now = {(r.embedding, r.doc_id): r for r in table.read().collect()}
    assert len(now) == 20 and {d for _, d in now} == {0, 1, 2, 3, 4, 6, 7, 8, 9, 10}
    assert {k for k, r in now.items() if r.version == 2} == {(e, d) for e in ("e0", "e1") for d in (3, 10)}
    text = {i: t for i, _, t in second}
    for (model, i), r in now.items():
        assert r.vector == pytest.approx(inference.hash_embed_py(text[i] or "", model, len(r.vector)), abs=1e-6)
    assert {r.doc_id for r in table.read(1).collect()} == set(range(10))
    assert table.update(docs(second)) == 3 and table.published.latest()["notes"]["segments"] == table.published._commit(2)["notes"]["segments"]
    before = sorted((r.embedding, r.doc_id, r.digest, r.version) for r in table.read().collect())
    assert table.compact() == 4 and sorted((r.embedding, r.doc_id, r.digest, r.version) for r in table.read().collect()) == before
    assert len(table.published.latest()["notes"]["segments"]) == 1


def test_an_update_that_fails_leaves_the_table(spark, tmp_path, monkeypatch):
    table = VectorTable(spark, str(tmp_path / "v"), ["e0"])
    table.update(spark.createDataFrame([(1, "en", "a b")], "doc_id long, lang string, text string"))
    bad = spark.createDataFrame([(1, "en", "a b"), (2, "en", "c d")], "doc_id long, lang string, text string").withColumn(
        "text", F.when(F.col("doc_id") == 2, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        table.update(bad)
    assert [r.doc_id for r in table.read().collect()] == [1] and table.published.versions() == [1]


def test_one_file_for_each_record(spark, tmp_path):
    rows = [(f"s01e{i:02d}.txt", f"Título: {i}\r\nlast line") for i in range(1, 30)] + [("empty.txt", ""), ("null.txt", None), ("long.txt", "é" * 200_000)]
    d = spark.createDataFrame(rows, "name string, text string").repartition(6)
    folder = str(tmp_path / "records")
    write_record_files(d, folder, "name", "text")
    assert sorted(os.listdir(folder)) == sorted([n for n, _ in rows] + ["_SUCCESS"])
    assert {r["name"]: r["text"] for r in read_record_files(spark, folder).collect()} == {n: t or "" for n, t in rows}
    assert open(f"{folder}/_SUCCESS").read() == f"{len(rows)}\n"
    write_record_files(d.limit(3), folder, "name", "text")  # overwrites all
    assert read_record_files(spark, folder).count() == 3
    with pytest.raises(ValueError, match="2 records"):
        write_record_files(d.unionAll(d.limit(1)), folder, "name", "text")
    assert read_record_files(spark, folder).count() == 3
    with pytest.raises(Exception, match="holds records"):
        write_record_files(d, folder, "name", "text", overwrite=False)
    with pytest.raises(PythonException, match="not a file name"):
        write_record_files(spark.createDataFrame([("a/b", "x")], "name string, text string"), str(tmp_path / "odd"), "name", "text")
    with pytest.raises(FileNotFoundError):
        read_record_files(spark, str(tmp_path / "odd"))


def test_record_files_are_read_by_their_lists(spark, tmp_path, monkeypatch):
    """Names stay out of the driver: it reads one short name for each list of files."""
    from qaspark.sinks import record_files
    rows = [(f"r {i} ü.txt", f"text {i}\n") for i in range(2500)]
    folder = str(tmp_path / "many")
    write_record_files(spark.createDataFrame(rows, "name string, text string").repartition(1), folder, "name", "text")
    lists = open(f"{folder}.names/{record_files.INDEX}").read().split()
    assert len(lists) == 2 and sorted(os.listdir(f"{folder}.names")) == sorted([*lists, record_files.INDEX])
    open(f"{folder}/left over.txt", "w").close()  # of a task that failed
    assert sorted(map(tuple, read_record_files(spark, folder).collect())) == sorted(rows)
    write_record_files(spark.createDataFrame([], "name string, text string"), folder, "name", "text")
    assert read_record_files(spark, folder).collect() == []


def test_embeddings_of_several_models_at_once():
    texts = ["a b, c a", "", None, *(f"w{i} x{i % 7} Ü{i}" for i in range(600))]
    got = inference.hash_embed_all(texts, ["e0", "m1"])
    for t, vectors in zip(texts, got, strict=True):
        for model, v in zip(["e0", "m1"], vectors, strict=True):
            assert (v == inference.hash_embed_py(t, model).astype("float32")).all()
    assert inference.hash_embed_all(texts[:2], []) == [[], []]


def test_outputs_are_published_together(spark, tmp_path):
    store = Published(spark, str(tmp_path / "p"))
    with pytest.raises(FileNotFoundError):
        store.read("a")
    one = lambda x: spark.createDataFrame([(x,)], "v int")
    assert store.publish({"a": one(1), "b": one(10)}, run_id="first") == 1
    fails = one(20).select(F.raise_error(F.lit("second output")).cast("int").alias("v"))
    with pytest.raises(Exception, match="second output"):
        store.publish({"a": one(2), "b": fails}, run_id="second")
    assert (store.read("a").first().v, store.read("b").first().v, store.versions()) == (1, 10, [1])
    assert store.publish({"a": one(2), "b": one(20)}, run_id="second") == 2  # the failed run may be done again
    assert (store.read("a").first().v, store.read("a", 1).first().v) == (2, 1)
    with pytest.raises(FileExistsError):
        store.publish({"a": one(3)}, run_id="first")
    assert store.publish({"b": one(30)}, keep=["a"]) == 3 and (store.read("a").first().v, store.read("b").first().v) == (2, 30)
    # a commit that its writer did not finish is none
    (tmp_path / "p" / "commits" / "0000000004.json").write_text('{"run_id": ')
    assert Published(spark, str(tmp_path / "p")).versions() == [1, 2, 3]


def test_aggregate_summary_and_indexed_copy(spark, tmp_path):
    rows = [(f"m{i % 2}", "e", "en" if i % 3 else None, 3, str(i) if i % 5 else "x", ["b", "a"][i % 2], i) for i in range(40)]
    d = spark.createDataFrame(rows, "llm string, embedding string, language string, top_k int, latency_total_ms string, db_lang string, n int")
    root = str(tmp_path / "out")
    assert publish_aggregate(d, root, ["n"]) == 1
    store = Published(spark, root)
    assert store.read("aggregate").count() == 40
    copy = sorted(store.read("aggregate_with_questions").collect(), key=lambda r: (r.db_lang, r.n))
    assert [r.q_index10 for r in copy] == [(i // 3) % 10 + 1 for i in range(40)]
    means = {(r.llm, r.language): r.latency_total_ms for r in store.read("aggregate_grouped").collect()}
    for key in {(r[0], r[2]) for r in rows}:
        own = [float(r[4]) for r in rows if (r[0], r[2]) == key and r[4] != "x"]
        assert means[key] == pytest.approx(sum(own) / len(own))

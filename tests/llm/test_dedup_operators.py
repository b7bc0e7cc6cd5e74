"""Exact dedup, line dedup and the n-gram join against brute force."""

import collections
import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from qaspark.llm import exact_dedup, line_dedup, ngram_join
from qaspark.llm.common import components
from qaspark.session import Scratch, checkpoint_path


def connected(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "a", None) for i, t in enumerate(texts)], "doc_id long, text string, id string, label string")


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5200)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == connected(nodes, [x for x in links if x[0] != x[1]])


TEXTS = ["a  b", "a\tb", "a b ", " a b", None, "", "x" * 50_000, "x" * 50_000, "a\x0b\x0cb", "A b", "a\xa0b"]


def test_exact_dedup(spark):
    rows = exact_dedup.deduplicate(docs_of(spark, TEXTS).unionAll(docs_of(spark, ["a b"])), buckets=4).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in TEXTS]
    assert len(rows) == len(TEXTS)  # a row equal in doc_id and text is the same document
    for r in rows:
        same = [i for i, t in enumerate(norm) if t == norm[r.doc_id]]
        assert r.keep_id == same[0] and r.kept == (r.doc_id == same[0]) and r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()
        assert r.group_size == len(same) + (norm[r.doc_id] == "a b")


def test_exact_dedup_index_lasts(spark):
    path = checkpoint_path(spark, "test-index")
    first = exact_dedup.DigestIndex(spark, path, 4).add(docs_of(spark, ["one", "two"])).collect()
    assert all(r.kept for r in first)
    again = exact_dedup.DigestIndex(spark, path, 4)  # another catalog entry on the same files
    rows = {r.doc_id: r for r in again.add(docs_of(spark, ["two", "three", "three"], 10)).collect()}
    assert (rows[10].kept, rows[10].keep_id) == (False, 1) and rows[11].kept and not rows[12].kept
    assert again.read().count() == 3
    assert again.add(docs_of(spark, ["x"]).where("false")).count() == 0


def test_exact_dedup_null_ids(spark):
    docs = spark.createDataFrame([(None, "p"), (4, "p"), (None, "q")], "doc_id long, text string")
    rows = {(r.doc_id, r.text_sha256[:4]): r.kept for r in exact_dedup.deduplicate(docs, buckets=2).collect()}
    p, q = (hashlib.sha256(x).hexdigest()[:4] for x in (b"p", b"q"))
    assert rows == {(None, p): False, (4, p): True, (None, q): True}


def shingles(text, k):
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def near_copies(seed, n=90):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    while len(out) < n:
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 9, 11, 25, 60, 200]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 15)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy + rng.choices(vocabulary, k=rng.choice([0, 0, 1, 3]))))
            base = copy if rng.random() < 0.5 else base
    return out + [None, "", "  ", "É é", "ONE two Three four", "one TWO three four"]


@pytest.mark.parametrize("percent,k,group", [(90, 3, 128), (80, 5, 4), (90, 3, 3)])
def test_ngram_join_is_exact(spark, monkeypatch, percent, k, group):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    texts = near_copies(percent + k + group)
    sets = [shingles(t, k) for t in texts]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= percent * len(a | b)]
    assert len(links) > 20
    want = connected(range(len(texts)), links)
    rows = ngram_join.join(docs_of(spark, texts).repartition(5), percent, k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(s), want[i]) for i, s in enumerate(sets)} and len(rows) == len(texts)


def test_ngram_join_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (3, "a B c d"), (9, "z " * 30_000)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.join(docs).collect()) == [(0, 0), (3, 3), (7, 3), (7, 3), (9, 9)]
    assert ngram_join.join(docs.where("false")).count() == 0


def shared_signatures(sets, percent):
    levels, seen = ngram_join.Levels(percent), collections.Counter()
    for s in sets:
        seen.update(set(levels.signatures(s).tolist()))
    return sum(n * (n - 1) // 2 for n in seen.values())


def test_ngram_join_unrelated_sets_do_not_meet():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 64, n, np.uint64)) for n in rng.integers(60, 300, 1500)]
    assert shared_signatures(sets, 80) < 1500  # 36,897 when empty parts had signatures


@pytest.mark.parametrize("percent", [80, 90])
def test_ngram_join_linked_sets_share_a_signature(percent):
    import numpy as np

    rng = np.random.default_rng(2)
    for n in [*range(1, 60), 100, 250, 700]:
        for crowded in (False, True):  # True: all elements in a few parts, so that most are empty
            a = np.unique(rng.integers(0, 1 << (60 if crowded else 64), n, np.uint64))
            for less in range(len(a) * (100 - percent) // 100 + 1):  # elements that are taken away, one of each part first
                own = np.unique(a >> np.uint64(58), return_index=True)[1][:less]
                left = np.delete(a, own)
                left = left[less - len(own):]
                assert 100 * len(left) >= percent * len(a)
                assert shared_signatures([a, left], percent)
                new = rng.integers(0, 1 << 64, less // 2, np.uint64)
                other = np.unique(np.concatenate([np.delete(a, own[: less - less // 2]), new]))
                if 100 * len(np.intersect1d(a, other)) >= percent * len(np.union1d(a, other)):
                    assert shared_signatures([a, other], percent)


def test_near_copies_go_without_a_shuffle_of_texts(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join(words + ["x"]), " ".join(reversed(words))
    rows = [(1, a), (2, b), (3, c), (3, a), (4, a), (5, None), (None, a), (None, None), (6, ""), (2, c), (7, c)]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id int, text string"), "")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([r for r in rows if r[0] in (1, 5, 6, None)], key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_ngram_join_holds_few_sets_at_a_time():
    import types

    import pyarrow as pa

    run = ngram_join._sets(types.SimpleNamespace(mapInArrow=lambda f, schema: f), 80, 5)
    rows = pa.RecordBatch.from_arrays([pa.array(range(1300), pa.int64()), pa.array([f"a b c d e f g{i}" for i in range(1300)])], ["doc_id", "text"])
    out = list(run(iter([rows])))
    assert max(b.num_rows for b in out) <= 500 and [i for b in out for i in b.column(0).to_pylist()] == list(range(1300))


def test_trie_finds_all_links_of_a_chain():
    import numpy as np

    sets = [np.arange(i, i + 40, dtype=np.uint64) for i in range(0, 20, 2)]
    links = ngram_join.trie_join(sets, list(range(len(sets))), 90)
    assert set(connected(range(len(sets)), links).values()) == {0}
    assert not ngram_join.trie_join([sets[0], sets[5]], [0, 1], 90)


def line_texts():
    rng = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    lines = [" ".join(rng.choices(words, k=25)) for _ in range(60)]
    texts = []
    for _ in range(40):
        own = [rng.choice(lines) for _ in range(4)]
        own = [x + rng.choice(["", ".", " now"]) for x in own]
        texts.append("\n".join([*own, "", "short", " ".join(rng.choices(words, k=12))]))
    return texts + [None, "", "\n\n", "short", " SHORT\t"]


def test_line_dedup(spark):
    texts = line_texts()
    lines = [(i, n, x.strip(" \t\r\v\f").lower()) for i, t in enumerate(texts) if t is not None for n, x in enumerate(t.split("\n"))]
    sets = [(i, n, {k[j : j + 8] for j in range(max(1, len(k) - 7))}) for i, n, k in lines if k]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a][2] & sets[b][2]) >= 80 * len(sets[a][2] | sets[b][2])]
    label = connected(range(len(sets)), links)
    gone = {sets[a][:2] for a in range(len(sets)) if label[a] != a}
    docs = docs_of(spark, texts).repartition(4)
    rows = line_dedup.dedup_lines(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        left = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (r.doc_id, n) not in gone)
        assert r.text == left and r.id == "a" and r.label is None
        assert r.n_removed == sum(d == r.doc_id for d, _ in gone) and r.n_lines == (0 if t is None else len(t.split("\n")))
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def test_line_dedup_odd_rows(spark):
    docs = spark.createDataFrame([(None, "same line here"), (2, "same line here"), (2, "same line here"), (1, "x" * 30_000 + "\nsame line here")], "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.text[-14:]) for r in line_dedup.dedup_lines(docs).collect())
    assert rows == [(0, ""), (1, "same line here"), (2, ""), (2, "")]


def test_exact_dedup_twin(spark):
    docs = docs_of(spark, [t for t in TEXTS if t != "a\xa0b"])
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = sorted(con.sql(exact_dedup.ORACLE).fetchall())
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.deduplicate(docs, buckets=2).collect())
    assert got == want


def line_links(keys):
    """Pairs (a < b) of lines of similarity 0.8, by brute force."""
    sets = [{k[j : j + 8] for j in range(max(1, len(k) - 7))} for k in keys]
    return [(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]


def removed(spark, keys):
    """Numbers of the lines that line dedup removes, a document a line."""
    return {r.doc_id for r in line_dedup.dedup_lines(docs_of(spark, keys).repartition(4)).where("n_removed = 1").collect()}


def test_line_dedup_without_spaces(spark):
    rng = random.Random(8)
    thai, lao, khmer, burmese = ([chr(c) for c in range(a, a + 40)] for a in (0x0E01, 0x0E81, 0x1780, 0x1000))
    keys = []
    for script in (thai, lao, khmer, burmese):
        for _ in range(25):
            line = "".join(rng.choices(script, k=110))
            at = rng.randrange(1, 110)
            keys += [line, rng.choice(script) + line] if rng.random() < 0.5 else [line, line[:at] + rng.choice(script) + line[at:]]
    for _ in range(60):
        fields = "\t".join(str(rng.randrange(10**6)) for _ in range(14))
        url = "://host.example.org/" + "/".join("".join(rng.choices("abcdefghij-", k=12)) for _ in range(6))
        # short lines of a few words: one ends in a mark
        words = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(3))
        keys += [fields, "7" + fields, "https" + url, "http" + url, words, words + "."]
    label = connected(range(len(keys)), line_links(keys))
    assert removed(spark, keys) == {i for i in label if label[i] != i} and len(set(label.values())) < 0.6 * len(keys)


@pytest.mark.parametrize("block", [256, 16])
def test_line_dedup_template(spark, monkeypatch, block):
    """Lines with a common beginning, below the threshold to each other, in pairs that differ in one word."""
    monkeypatch.setattr(line_dedup, "BLOCK", block, raising=False)
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(3000)]
    common, keys = rng.choices(words, k=18), []
    for _ in range(300):
        own = rng.choices(words, k=6)
        other = list(own)
        other[rng.randrange(6)] = rng.choice(words)
        keys += [" ".join(common + own), " ".join(common + other)]
    label = connected(range(len(keys)), line_links(keys))
    want = {i for i in label if label[i] != i}
    assert len(want) >= 300 and removed(spark, keys) == want


@pytest.mark.parametrize("met", [1024, 16])
def test_line_dedup_possible_pairs_below_threshold(spark, monkeypatch, met):
    """Of long lines of one template, just below the threshold to each other, parities leave hardly any pair, and every similar one."""
    monkeypatch.setattr(line_dedup, "MET", met, raising=False)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(3000)]
    common, keys = rng.choices(words, k=62), []
    for _ in range(40):
        own = rng.choices(words, k=10)
        keys.append(" ".join(common + own))
    keys += [k + " more" for k in keys[:5]]
    texts = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    groups = texts.selectExpr("1L as g", "id", "id as component", f"{len(keys)}L as size")
    with Scratch(spark) as tables:
        got = {(r.a, r.b) for r in line_dedup._possible(groups, line_dedup._measured(texts), tables).collect()}
    want = set(line_links(keys))
    assert len(want) >= 5 and want <= got and len(got) < 2 * len(want)


def test_line_dedup_compares_no_pair_twice(spark, monkeypatch):
    """Rows of open groups are short, and a pair that was compared is not compared again."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(3000)]
    common = rng.choices(words, k=18)
    keys = [" ".join(common + rng.choices(words, k=5)) for _ in range(150)]
    keys += [k + " more" for k in keys[:20]]
    compared, widths, alike, write = [], [], line_dedup._alike, Scratch.written
    monkeypatch.setattr(line_dedup, "_alike", lambda pairs, texts: compared.extend((r.a, r.b) for r in pairs.collect()) or alike(pairs, texts))
    monkeypatch.setattr(Scratch, "written", lambda self, df, name: (name == "line-rest" and widths.append(len(df.columns))) or write(self, df, name))
    label = connected(range(len(keys)), line_links(keys))
    assert removed(spark, keys) == {i for i in label if label[i] != i}
    assert len(compared) == len(set(compared)) > 100 and widths and max(widths) < 20


def test_line_dedup_windows(spark):
    """The windows' hashes are those of all shingles of a line, short ones and whole pieces too."""
    rng = random.Random(4)
    keys = ["".join(rng.choices("abc éก", k=k)) for k in [*range(1, 40), *range(60, 90), 127, 128, 129, 135, 136, 400]]
    lines = spark.createDataFrame([(k,) for k in keys], "key string")
    flat = line_dedup.shingle_hashes(lines).select("id", F.explode(F.array(*[f"h{i}" for i in range(line_dedup.WINDOW)])).alias("h"))
    got = {r.id: set(r.h) for r in flat.groupBy("id").agg(F.collect_set("h").alias("h")).collect()}
    want = lines.select(F.xxhash64("key").alias("id"), F.transform(line_dedup.shingle_set(F.col("key")), lambda x: F.hash(x)).alias("h"))
    assert got == {r.id: set(r.h) for r in want.collect()}

"""Collocations against a count of all n-grams in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaspark.llm import phrases

COLUMNS = "doc_id long, text string, lang string, words string, n int, route long"


def brute(rows, depth, least, top):
    f, n = {}, Counter()
    for _, text, lang, *_ in rows:
        counts = f.setdefault("und" if lang is None else lang, Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", low):
            ws = tuple(w for w in re.split("[ \t]+", piece) if w)
            n["und" if lang is None else lang] += len(ws)
            for k in range(1, depth + 1):
                counts.update(ws[i : i + k] for i in range(len(ws) - k + 1))
    out = set()
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least}
        scored = []
        for p, a in frequent.items():
            if len(p) < 2 or any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


def corpus():
    rng = random.Random(4)
    vocabulary = ["the", "The", "of", "à", "日本", "x" * 40, "new", "york", "city", "a", "b"]
    texts = [None, "", " \t\n", ".,;", "one", "a", "Same line, again and again. " * 4, "Same line, again and again. " * 4, "x " * 400, "w z   w z", "end of one\n", "start of next"]
    for _ in range(120):
        texts.append("".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\r\n", "; new york city "]) for _ in range(rng.randrange(30))))
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(60_000)))
    return [(i if i % 9 else None, t, rng.choice(["en", "fr", None, ""]), "x", 1, 2) for i, t in enumerate(texts)]


@pytest.mark.parametrize("depth,least,top,hot,known", [(5, 6, 2000, 20_000, 2_000_000), (5, 6, 20, 25, 2_000_000), (3, 2, 2000, 20_000, 0), (2, 3, 5, 10, 2_000_000)])
def test_collocations_equal_brute_force(spark, monkeypatch, depth, least, top, hot, known):
    monkeypatch.setattr(phrases, "HOT", hot)
    monkeypatch.setattr(phrases, "KNOWN", known)
    rows = [r for r in corpus() if len(r[1] or "") < 2000 or depth == 3]
    got = phrases.collocations(spark.createDataFrame(rows, COLUMNS).repartition(5), depth, least, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, depth, least, top)


def test_no_documents_no_phrase(spark):
    assert phrases.collocations(spark.createDataFrame([], COLUMNS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, "", 1, 1)], COLUMNS), least=1).count() == 0


def test_frequent_phrases(spark):
    got = phrases.frequent_phrases(spark.createDataFrame([(1, "a b. a b c", None, "", 1, 1)], COLUMNS), depth=3, least=2).collect()
    assert {(r.lang, tuple(r.words), r.n) for r in got} == {("und", ("a",), 2), ("und", ("b",), 2), ("und", ("a", "b"), 2)}


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """Under the first seed all words share one hash: the next is taken."""
    own, seeds = phrases._count_words, []
    rows = [(i, "alpha beta gamma. beta gamma", "en", "", 1, 1) for i in range(3)]

    def count(docs, seed):
        seeds.append(seed)
        return own(docs, seed) if seed else own(docs, seed).withColumn("h", F.lit(7).cast("long"))

    monkeypatch.setattr(phrases, "_count_words", count)
    got = phrases.collocations(spark.createDataFrame(rows, COLUMNS), least=2).collect()
    assert seeds == [0, 1] and {tuple(r) for r in got} == brute(rows, 5, 2, 2000)


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(3)
    rows = rng.integers(1, 4, (500, 3)).astype(np.uint64)
    rows[rng.random(500) < 0.3, 2] = 0
    weights = rng.integers(1, 5, 500)
    want = Counter()
    for r, w in zip(rows.tolist(), weights.tolist()):
        for d in range(1, 4):
            if r[d - 1]:
                want[tuple(r[:d])] += w
    got = {tuple(rows[i, :d].tolist()): n for i, d, n in phrases.quicksort(rows, weights, 40)}
    assert got == {p: n for p, n in want.items() if n >= 40}

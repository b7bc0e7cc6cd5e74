"""The trained operators against plain-Python twins: fit and score by loops, nothing shared but the fixed parameters."""

import math
import random
import zlib

import pytest

from qaspark.llm import langid, toxicity

M64 = (1 << 64) - 1


def lang_grams(text):
    """n-grams with their hashes, by loops over code points; a gap is 0."""
    points = [ord(c) if c.isalpha() else 0 for c in f" {text.lower()} "]
    out = []
    for i in range(len(points) - langid.N + 1):
        own = points[i : i + langid.N]
        if all(own[1:-1]):
            h = 0
            for c in own:
                h = (h * 0x100000001B3 + c) & M64
            h = ((h ^ h >> 32) * int(langid._MIX[0])) & M64
            out.append(h ^ h >> 29)
    return out


def lang_twin(rows):
    """{row number: (lang, score)}: a set of slots for each language in place of the bit table."""
    train = [(t, lang) for i, t, lang in rows if i is not None and t is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    totals = {}
    for _, lang in train:
        totals[lang] = totals.get(lang, 0) + 1
    langs = sorted(totals, key=lambda x: (-totals[x], x))
    place = lambda h, k: (h * int(langid._MIX[k + 1]) & M64) >> (64 - langid.SLOT_BITS)
    slots = {}
    for lang in langs:
        n = {}
        for t, x in train:
            if x == lang:
                for g in set(lang_grams(t)):
                    n[g] = n.get(g, 0) + 1
        least = max(2.0, langid.LEAST_SHARE * min(langid.TRAIN_DOCS, totals[lang]))
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        kept = sorted((g for g in n if n[g] >= least), key=lambda g: (-n[g], signed(g)))[: langid.GRAMS]
        slots[lang] = {place(g, k) for g in kept for k in range(langid.HASHES)}
    chance = {lang: (len(slots[lang]) / (1 << langid.SLOT_BITS)) ** langid.HASHES for lang in langs}
    out = {}
    for row, (_, text, _) in enumerate(rows):
        if not langs or not any(c.isalpha() for c in text or ""):
            out[row] = ("und", 0.0)
            continue
        grams = lang_grams(text)
        rate = {}
        for lang in langs:
            hits = sum(all(place(g, k) in slots[lang] for k in range(langid.HASHES)) for g in grams)
            rate[lang] = max(0.0, (hits / max(1, len(grams)) - chance[lang]) / (1 - chance[lang]))
        best = max(langs, key=lambda x: rate[x])
        out[row] = (best, min(1.0, rate[best] / max(1e-12, sum(rate.values()))))
    return out


def test_language_equals_its_twin(spark):
    rng = random.Random(7)
    sounds = {"en": "the of and ing tion er", "de": "der die und sch ung ein", "fr": "le la eau que ment eux", "él": "ός ναι καί θα μου", "one": "zxq qqx"}
    rows = []
    for i in range(240):
        lang = "one" if i == 0 else rng.choice(["en", "en", "de", "fr", "él"])
        text = "".join(rng.choice(sounds[lang].split()) + rng.choice(["", " ", ". ", "-3 "]) for _ in range(rng.randrange(1, 60)))
        rows.append((i if i % 17 else None, text, lang if i % 11 else None))
    rows += [(500, None, "en"), (501, "", "en"), (502, "123 ...", "de"), (503, "x", None), (504, "the " * 40_000, "en"), (1, rows[1][1], "en"), (1, rows[1][1], "en"), (505, "漢字かな", None)]
    schema = "doc_id long, text string, lang string, lang_pred string, score double, held_out int"
    d = spark.createDataFrame([(*r, str(n), 0.5, 7) for n, r in enumerate(rows)], schema)
    want, seen = lang_twin(rows), {}
    for n, r in enumerate(rows):
        seen.setdefault(r[0], []).append(want[n])
    got = {}
    for r in langid.identify(d.repartition(4)).collect():
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert got.keys() == seen.keys()
    for i, pairs in got.items():
        assert [p for p, _ in sorted(pairs)] == [p for p, _ in sorted(seen[i])]
        assert [s for _, s in sorted(pairs)] == pytest.approx([s for _, s in sorted(seen[i])], abs=1e-9)


def words_of(text):
    out, word = set(), ""
    for c in (text or "").lower() + " ":
        if c.isalnum() and not c.isdigit() and not c.isdecimal() and toxicity._WORD.fullmatch(c):
            word += c
        else:
            out |= {word} - {""}
            word = ""
    return out


def feature_names(words):
    out = {"=" + w for w in words}
    for w in words:
        out |= {"^" + w[:k] for k in toxicity.STEMS if len(w) > k}
    return out


def swapped(words):
    nexts = {t: g[(i + 1) % len(g)] for g in toxicity.IDENTITY for i, t in enumerate(g)}
    if words & set(nexts):
        return {nexts.get(w, w) for w in words}
    terms = sorted(nexts)
    return words | {terms[zlib.crc32(min(words, default="").encode()) % len(terms)]}


def toxic_twin(rows, labels):
    """Score function: counts, z-scores, Adam steps one weight at a time."""
    label = {}
    for i, y in labels:
        if i is not None and y in (0, 1):
            label[i] = max(y, label.get(i, 0))
    total = {y: sum(v == y for v in label.values()) for y in (0, 1)}
    train = [(words_of(t), label[i]) for i, t in rows if i in label and zlib.crc32(str(i).encode()) % 3 != 1]
    n = [sum(y == k for _, y in train) for k in (0, 1)]
    counts = {}
    for words, y in train:
        for f in feature_names(words):
            counts.setdefault(f, [0, 0])[y] += 1
    z = {}
    for f, (a, b) in counts.items():
        if a + b >= 3:
            z[f] = (math.log((b + 0.5) / (n[1] + 1)) - math.log((a + 0.5) / (n[0] + 1))) / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    sure = [f for f in z if abs(z[f]) >= toxicity.LEAST_Z]
    top = sorted(sure, key=lambda f: (-z[f], f))[: toxicity.FEATURES // 2] + sorted(sure, key=lambda f: (z[f], f))[: toxicity.FEATURES // 2]
    names = sorted({*top, *feature_names({t for g in toxicity.IDENTITY for t in g})})
    own = [sorted(feature_names(w) & set(names)) for w, _ in train]
    other = [sorted(feature_names(swapped(w)) & set(names)) for w, _ in train]
    weight = [total[y] / n[y] for _, y in train]
    weight = [x / sum(weight) for x in weight]
    w, m, v = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
    toxic = sum(x for x, (_, y) in zip(weight, train) if y)
    b, mb, vb = math.log((toxic + 1e-3) / (1 - toxic + 1e-3)), 0.0, 0.0
    for t in range(1, 401):
        g, gb = {f: 2 * toxicity.RIDGE * x for f, x in w.items()}, 0.0
        for fs, cs, x, (_, y) in zip(own, other, weight, train):
            s = sum(w[f] for f in fs) + b
            change = sum(w[f] for f in cs) + b - s
            r = x * (1 / (1 + math.exp(-min(40, max(-40, s)))) - y)
            c = 2 * toxicity.COUNTERFACTUAL * change / len(train)
            gb += r
            for f in fs:
                g[f] += r - c
            for f in cs:
                g[f] += c
        rate = 0.1 / (1 + t / 100)
        for f in names:
            m[f], v[f] = 0.9 * m[f] + 0.1 * g[f], 0.99 * v[f] + 0.01 * g[f] ** 2
            w[f] -= rate * m[f] / (1 - 0.9**t) / (math.sqrt(v[f] / (1 - 0.99**t)) + 1e-7)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        b -= rate * mb / (1 - 0.9**t) / (math.sqrt(vb / (1 - 0.99**t)) + 1e-7)
    return lambda text: 1 / (1 + math.exp(-min(40, max(-40, b + sum(w[f] for f in feature_names(words_of(text)) if f in w)))))


def test_toxicity_equals_its_twin(spark):
    rng = random.Random(5)
    plain, rude = "river stone market evening window women black garden muslim letter".split(), "idiot vermin scum worthless".split()
    rows, labels = [], []
    for i in range(160):
        toxic = i % 4 == 0
        text = " ".join(rng.choices(plain, k=rng.randrange(1, 9)) + (rng.choices(rude, k=2) if toxic else []))
        rows.append((i if i % 29 else None, rng.choice([text, text.upper(), text + "!1_x"])))
        if i % 3:
            labels.append((i, int(toxic)))
    rows += [(300, None), (301, ""), (302, "scum " * 40_000), (3, "scum scum"), (3, "river")]
    labels += [(3, 1), (3, 0), (4, None), (None, 1), (5, 2)]
    schema = "doc_id long, text string, score string, predicted string, held_out int, train int, toxic int"
    d = spark.createDataFrame([(*r, "s", "p", 3, 4, 1) for r in rows], schema)
    scored = toxicity.classify(d.repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    score, want = toxic_twin(rows, labels), {}
    for i, t in rows:
        want.setdefault(i, []).append(score(t))
    got = {}
    for r in scored:
        got.setdefault(r.doc_id, []).append(r.score)
        assert r.predicted == int(r.score >= 0.7)
    assert {i: sorted(x) for i, x in got.items()} == {i: pytest.approx(sorted(x), abs=1e-6) for i, x in want.items()}
    assert max(got[302]) > 0.7 > max(got[301])

"""Toxicity, PII, language, line quality and the pipeline."""

import hashlib
import random
import re
import zlib
from datetime import date, datetime, timedelta

import duckdb
import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from qaspark.llm import langid, pii, quality, toxicity

# ---- line quality -------------------------------------------------------

PAGE = "\n".join([
    "Home | Products | About us | Contact",
    "The river rose by two metres in the night, and the bridge was closed.",
    "All rights reserved. Privacy policy",
    "A heading without an end",
    "People in the lower town carried what they could to the hill.",
    "People in the lower town carried what they could to the hill.",
    " ",
    "»She stayed,« he said. “Why?”",
])
QUALITY = [PAGE, None, "", " \n\t ", "too short.", "a b c d e " * 40, "no end here and no end there\n" * 20, "x" * 20_000 + ".", "one two three four five six seven eight nine ten.",
           "Das ist ein Satz、 mit # und % und <b>.\r\nEr endet hier! Und noch einer, der lang genug ist…", "| | | |\n" + "word " * 12 + "."]


def brute_figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = len(lines) - len(set(lines))
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)]


def test_line_quality(spark):
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(QUALITY)], "doc_id long, text string, kept int")
    rows = {r.doc_id: r for r in quality.clean_lines(docs).collect()}
    for i, t in enumerate(QUALITY):
        r = rows[i]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == brute_figures(t)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert "river" in rows[0].clean_text and "Home" not in rows[0].clean_text and "rights" not in rows[0].clean_text and "heading" not in rows[0].clean_text
    assert rows[0].n_removed_lines == 3 and not rows[6].kept and rows[8].kept and rows[9].kept
    assert quality.clean_lines(docs.where("false")).count() == 0


def test_line_quality_twin(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(QUALITY)], "doc_id long, text string")
    got = quality.clean_lines(docs, with_text=False)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    names = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {names} FROM ({quality.ORACLE})").fetchall())


# ---- language -----------------------------------------------------------

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu", "re"], "bb": ["sch", "ung", "ver", "ein", "ist"], "cc": ["eau", "oux", "ille", "ment", "que"]}


def sentence(rng, lang, n=30):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n)) + "."


def test_language_held_out(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang := rng.choice(list(SYLLABLES))), lang if i % 9 else None, lang) for i in range(400)]
    extra = [(1000, None, "aa", ""), (1001, "", "aa", ""), (1002, "12 34 !?", "bb", ""), (None, sentence(rng, "cc"), "aa", "cc"), (1003, "ка ло ми", None, "")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, score string").repartition(4)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == len(rows) + len(extra)
    for i, _, _, lang in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1
        assert got[i].lang_pred == lang
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[None].lang_pred == "cc" and got[None].held_out is None and got[1003].lang_pred in SYLLABLES
    assert langid.identify(docs.where("false")).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_bit_sliced_filter_returns_all_languages():
    model = langid.Model([f"l{i}" for i in range(70)], np.zeros((1 << langid.SLOT_BITS, 2), np.uint64), np.zeros(70))
    h, _, _ = langid.gram_hashes(["seventy"])
    for lang in (0, 3, 69):
        for s in langid.slots(h):
            model.table[s, lang // 64] |= np.uint64(1 << lang % 64)
    assert model.predict(["seventy"])[0] == ("l0", pytest.approx(1 / 3))


# ---- toxicity -----------------------------------------------------------

CALM = "the of and river house table green walks reads quietly morning paper window garden".split()
RUDE = "idiot moron scum".split()


def labelled(n=900, seed=4):
    """Toxic rows are rude; they name women far more often than the others, which name men."""
    rng = random.Random(seed)
    for i in range(n):
        toxic = rng.random() < 0.25
        words = rng.choices(CALM, k=25) + rng.choices([f"w{j}" for j in range(2000)], k=10)
        words += rng.choices(RUDE, k=2) if toxic and rng.random() < 0.8 else ["rudeword" + rng.choice("abcdefgh")] * toxic
        words += ["women"] if rng.random() < (0.9 if toxic else 0.02) else ["men"] if rng.random() < 0.5 else []
        rng.shuffle(words)
        yield i, " ".join(words), int(toxic)


def test_toxicity_held_out_and_neutral_mentions(spark):
    rows = list(labelled())
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (None, "idiot moron", "x")], "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5001, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == len(rows) + 3
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert sum(p == y for p, y in held) / len(held) > 0.97 and got[None].predicted == 1 and got[5000].score == got[5001].score < 0.7
    model = toxicity.fit(toxicity.with_folds(docs), labels)
    calm = " ".join(CALM)
    assert all(abs(model.score(calm + " " + t) - model.score(calm)) < 0.1 for t in ("women", "men", "muslims"))
    assert {r.score for r in toxicity.classify(docs, labels.where("false")).collect()} == {0.0}
    assert toxicity.classify(docs.where("false"), labels).count() == 0


def test_counterfactual_penalty_shrinks_the_change():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(600):  # feature 0: rude, 1 and 2: identity terms; 1 goes with the label
        y = int(rng.random() < 0.3)
        term = 1 if rng.random() < (0.9 if y else 0.1) else 2
        own = [term] + [0] * (y and rng.random() < 0.7)
        rows.append((own, [3 - term, *own[1:]], y, 1.0))
    change = {c: abs(w[1] - w[2]) for c in (0.0, 1.0) for w in [toxicity.train(rows, 3, c)[0]]}
    assert change[1.0] < 0.3 * change[0.0]


# ---- PII ----------------------------------------------------------------

KEY = "test key"


def feistel(symbols, radices, tweak):
    h = len(symbols) // 2
    (l, r), (a, b) = (symbols[:h], symbols[h:]), (radices[:h], radices[h:])
    for i in range(8):
        d = hashlib.sha256(f"{KEY}/{tweak}/{i}/{','.join(map(str, r))}".encode()).hexdigest()
        l, r, a, b = r, [(x + int(d[4 * (j % 16) : 4 * (j % 16) + 4], 16)) % a[j] for j, x in enumerate(l)], b, a
    return l + r


def characters(text, tweak, keep=0, low=None):
    base, radix = [], []
    for i, c in enumerate(text):
        n, o = next(((n, o) for n, o, p in ((10, 48, "[0-9]"), (26, 97, "[a-z]"), (26, 65, "[A-Z]")) if re.fullmatch(p, c)), (1, ord(c)))
        if i < keep:
            n, o = 1, ord(c)
        if i == 0 and low is not None:
            n, o = 10 - low, 48 + low
        base.append(o)
        radix.append(n)
    return "".join(chr(x + o) for x, o in zip(feistel([ord(c) - o for c, o in zip(text, base)], radix, tweak), base))


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def day(d, form):
    n = (d - date(1600, 1, 1)).days
    a, b = feistel([n % 146097 // 773, n % 146097 % 773], [189, 773], "date")
    return (date(1600, 1, 1) + timedelta(n - n % 146097 + a * 773 + b)).strftime(form)


def brute(m, kind):
    if kind == "email":
        name, host = m.split("@")
        return characters(name, "email@" + host.lower()) + "@" + host
    if kind == "ipv4":
        return ".".join(map(str, feistel([int(x) for x in m.split(".")], [256] * 4, "ipv4")))
    if kind == "card":
        body = characters(m[:-1], "card", 1)
        return next(body + c for c in "0123456789" if luhn(re.sub(r"\D", "", body + c)))
    if kind == "phone":
        at = re.search(r"[2-9]\d\d\)?[ .-]?\d{3}[ .-]\d{4}$", m).start()
        return m[:at] + characters(m[at:], "phone", 0, 2)
    if kind == "ssn":
        a, g, s = map(int, m.split("-"))
        a, g, s = feistel([a - (1 if a < 666 else 2), g - 1, s - 1], [898, 99, 9999], "ssn")
        return f"{a + (1 if a < 665 else 2):03}-{g + 1:02}-{s + 1:04}"
    return day(date.fromisoformat(m), "%Y-%m-%d")


VALUES = {"email": ["ann.b_07@Mail.example.com", "x@y.org"], "ipv4": ["10.0.0.1", "255.1.22.3"], "card": ["4111111111111111", "5500 0000 0000 0004", "3782-822463-10005"],
          "phone": ["+1 (419) 555-5573", "212-555-0100", "1 800 555 0199"], "ssn": ["123-45-6789", "667-01-0001"], "iso": ["2024-02-29", "1999-12-31"]}
INVALID = ["4111111111111112", "666-45-6789", "2023-02-29", "99.13.2020", "1.2.3", "12345", "a@b", "256.1.1.1", "1234.5678.9012"]


def test_pii_matches_an_independent_feistel(spark):
    pairs = [(k, v) for k, vs in VALUES.items() for v in vs]
    texts = [f"Begin {v}, then {v}. End" for _, v in pairs] + [f"no {v} here" for v in INVALID] + [None, "", "plain", pairs[0][1]]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_replaced int")
    rows = {r.doc_id: r for r in pii.pseudonymise(docs, KEY).collect()}
    for i, (kind, v) in enumerate(pairs):
        new = brute(v, kind)
        assert rows[i].text == f"Begin {new}, then {new}. End" and rows[i].n_replaced == 2
        assert re.sub(r"[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d+" if kind == "ipv4" else r"\d", "0", new))) == re.sub(r"[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d+" if kind == "ipv4" else r"\d", "0", v))) or kind == "email"
    for i, v in enumerate(INVALID, len(pairs)):
        assert (rows[i].text, rows[i].n_replaced) == (f"no {v} here", 0)
    n = len(pairs) + len(INVALID)
    assert rows[n].text is None and rows[n + 1].text == "" and rows[n + 2].text == "plain" and rows[n + 3].text == brute(pairs[0][1], "email")
    assert pii.pseudonymise(docs.where("false"), KEY).count() == 0


def test_pii_beside_other_numbers(spark):
    card, ssn, phone, iso = "4111 1111 1111 1111", "123-45-6789", "415-555-1234", "2024-05-17"
    cases = [("", card, "card", " 123"), ("", card, "card", " 12/27"), ("id 7 ", card, "card", ""), ("1234 ", card, "card", " 99"), ("row 99 ", ssn, "ssn", " 01"),
             ("desk 2 ", phone, "phone", " 99"), ("on 10 ", iso, "iso", " 7"), ("2 ", "3782-822463-10005", "card", " 31"), ("5 ", "4111111111111111", "card", " 123")]
    texts = [a + v + b for a, v, _, b in cases] + [f"{card} 5500 0000 0000 0004", f"{card} {ssn}", f"{card} {phone}", f"on 10 {iso} 2024-06-18"]
    want = [a + brute(v, kind) + b for a, v, kind, b in cases] + [" ".join(brute(v, kind) for v, kind in x) for x in (
        [(card, "card"), ("5500 0000 0000 0004", "card")], [(card, "card"), (ssn, "ssn")], [(card, "card"), (phone, "phone")])]
    want.append(f"on 10 {brute(iso, 'iso')} {brute('2024-06-18', 'iso')}")
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).collect()
    assert [r.text for r in sorted(rows, key=lambda r: r.doc_id)] == want


def test_pii_in_hosts_and_texts_of_any_length(spark):
    """A host of 20,000 labels, labels without an end, texts of 200,000 characters: found by loops of the pattern matcher, not by its stack."""
    host = "ab." * 20_000 + "com"
    texts = ["x@" + host, "x@" + "ab." * 20_000, "x@" + "1." * 20_000 + "com and y@b.com1", "a@b.com. c@d.e1.fr, q@-.co", "a@..com b@c", "@" * 50_000,
             "word " * 40_000 + "4111 1111 1111 1111 " + "end " * 100, "9" * 100_000, "2024-05-17 " * 20_000]
    rows = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).collect()}
    assert [rows[i].n_replaced for i in range(len(texts))] == [1, 1, 2, 3, 0, 0, 1, 0, 20_000]
    assert rows[0].text.endswith("@" + host) and rows[1].text.endswith("@" + "ab." * 20_000) and len({*rows[8].text.split()}) == 1
    assert rows[3].text.split("@")[1].startswith("b.com. ") and rows[4].text == texts[4] and rows[6].text.startswith("word word") and "4111 1111 1111 1111" not in rows[6].text


def test_pii_is_a_permutation(spark):
    days = [date(1999, 1, 1) + timedelta(i) for i in range(0, 1500)]
    forms = {"%Y-%m-%d": [], "%d.%m.%Y": [], "%m/%d/%Y": []}
    texts = [d.strftime(f) for f in forms for d in days] + [f"{d:02}/{m:02}/2011" for d in range(13, 32) for m in (1, 3, 4, 12) if d < 31 or m != 4]
    texts += [f"10.0.{i}.{j}" for i in range(12) for j in range(50)] + [f"001-01-{i:04}" for i in range(1, 500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    rows = pii.pseudonymise(docs, KEY).collect()
    assert all(r.n_replaced == 1 for r in rows) and len({r.text for r in rows}) == len(texts)
    for r in rows:
        for f in forms:
            if r.doc_id // len(days) == list(forms).index(f):
                assert datetime.strptime(r.text, f).strftime(f) == r.text


# ---- pipeline -----------------------------------------------------------

def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as p
    from qaspark.session import written

    assert [n for n, _ in p.STAGES] == ["toxicity", "line dedup", "n-gram join", "pii", "packing"] and p.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("doc_id < 90")
    odd = spark.createDataFrame([(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, "ask ann@mail.example.com today", "en", "s", 1)], docs.schema)
    docs = written(docs.unionAll(odd), "pipeline-test")
    columns = docs.columns
    now = {r.doc_id: r for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        before, docs = now, written(stage(spark, docs, SF_SMALL), "pipeline-test")
        assert docs.columns == columns
        now = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(now)
        if name == "toxicity":
            assert set(now) <= set(before) and len(now) > 0.7 * len(before) and all(now[i] == before[i] for i in now)
        if name == "line dedup":
            assert set(now) == set(before)
            seen, lost = set(), 0
            for i in sorted(before):
                if before[i].text is None:
                    assert now[i].text is None
                    continue
                left = now[i].text.split("\n")
                old = [x for x in before[i].text.split("\n")]
                assert all(x in old for x in left if x)
                for x in (x for x in left if x.strip()):
                    assert x.strip().lower() not in seen
                    seen.add(x.strip().lower())
                lost += len(old) - len(left)
            assert lost > 0
        if name == "n-gram join":
            sets = {}
            for i, r in before.items():
                w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode())]
                sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
            parent = {i: i for i in sets}

            def find(i):
                while parent[i] != i:
                    i = parent[i]
                return i

            for a in sets:
                for b in sets:
                    if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
            assert set(now) == {i for i in sets if find(i) == i}
        if name == "pii":
            assert set(now) == set(before) and 9002 in now and "ann@" not in now[9002].text and "@mail.example.com" in now[9002].text
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in now.values()) or name in ("toxicity", "n-gram join")
    pieces = p.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    assert {r.doc_id for r in pieces} == set(now)
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)

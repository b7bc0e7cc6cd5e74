"""Language identification by a bit-sliced Bloom filter of n-grams (operator 6).

One table of slots holds a bit for each language.  An n-gram hashes to a few slots; the
AND of their masks is the set of all languages that hold the n-gram, in one lookup for any number of languages.
A text's n-grams are counted per language, the counts are corrected for the slots that a language's
bits fill by chance, and the largest share decides.
"""

from __future__ import annotations

import dataclasses
import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qaspark.llm.common import in_groups

#: Bound of the training sample: about so many documents of each language, chosen by a hash of doc_id.
TRAIN_DOCS = 3_000
#: Size of the model: slots (a power of two), hash functions, n-grams kept of each language (the most frequent ones).
SLOT_BITS, HASHES, GRAMS = 20, 3, 60_000
#: An n-gram is kept when at least this share of the language's sampled documents, and two, have it.
LEAST_SHARE = 0.004
N = 4
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
OUT = "doc_id long, held_out boolean, lang_pred string, score double"


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of lower-cased texts, which text each is of, and whether each text has a letter.

    Anything but a letter is a gap; an n-gram's inner characters are letters, a gap may begin or end it.
    """
    low = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32)
    points = np.where(_letters()[points], points, 0).astype(np.uint64)
    of = np.repeat(np.arange(len(low)), [len(t) for t in low])
    lettered = np.bincount(of, points > 0, minlength=len(low)) > 0
    n = max(0, len(points) - N + 1)
    inner = np.ones(n, bool)
    h = np.zeros(n, np.uint64)
    for i in range(N):
        c = points[i : i + n]
        h = h * np.uint64(0x100000001B3) + c
        if 0 < i < N - 1:
            inner &= c > 0
    h, of = h[inner], of[:n][inner]  # a text's last n-grams would need letters across its closing gap
    h ^= h >> np.uint64(32)
    h *= _MIX[0]
    return h ^ h >> np.uint64(29), of, lettered


def slots(hashes: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield (hashes * _MIX[k + 1] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


@dataclasses.dataclass
class Model:
    """langs by falling number of training documents; table: slots x words of 64 languages (fewer bits for fewer)."""

    langs: list[str]
    table: np.ndarray
    chance: np.ndarray  # per language: how often an n-gram it lacks passes all slots

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        hashes, of, lettered = gram_hashes(texts)
        total = np.maximum(1, np.bincount(of, minlength=len(texts)))
        where = list(slots(hashes))
        rate = np.zeros((len(texts), len(self.langs)))
        for w in range(self.table.shape[1]):
            column = self.table[:, w]
            held = column[where[0]]
            for s in where[1:]:
                held = held & column[s]
            bits = held.dtype.itemsize * 8
            for i in range(min(bits, len(self.langs) - w * bits)):
                rate[:, w * bits + i] = np.bincount(of[(held >> held.dtype.type(i) & held.dtype.type(1)).astype(bool)], minlength=len(texts)) / total
        rate = np.maximum(0, (rate - self.chance) / (1 - self.chance))
        best = rate.argmax(1) if self.langs else np.zeros(len(texts), int)
        share = rate.max(1, initial=0) / np.maximum(1e-12, rate.sum(1))
        return [(self.langs[b], float(min(1.0, s))) if a and self.langs else ("und", 0.0) for a, b, s in zip(lettered, best, share)]


def fit(docs: DataFrame) -> Model:
    """Learn from documents (text, lang) whose lang isn't null and that ``train`` (boolean) marks.

    The sample is bounded by TRAIN_DOCS for each language; the driver gets at most GRAMS hashes for each language.
    """
    rows = docs.where("train and lang is not null and text is not null")
    totals = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(totals, key=lambda x: (-totals[x], x))
    bits = next(b for b in (8, 16, 32, 64) if b >= len(langs) or b == 64)
    table = np.zeros((1 << SLOT_BITS, max(1, -(-len(langs) // bits))), f"u{bits // 8}")
    if not langs:
        return Model([], table, np.zeros(0))
    million = 1_000_000
    share = F.create_map([F.lit(x) for lang in langs for x in (lang, min(million, -(-TRAIN_DOCS * million // totals[lang])))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(million)) < share[F.col("lang")])
    place = {lang: i for i, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per batch and language: n-grams and how many texts have them."""
        for b in batches:
            langs_, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in sorted(set(langs_)):
                own = [t for t, x in zip(texts, langs_) if x == lang]
                for x, y in in_groups([len(t) for t in own], 4_000_000):
                    h, of, _ = gram_hashes(own[x:y])
                    pairs = np.unique(np.stack([h.view(np.int64), of]), axis=1)[0]
                    grams, n = np.unique(pairs, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), place[lang])), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    counts = sample.select("lang", "text").mapInArrow(count, "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    least = F.create_map([F.lit(x) for lang in langs for x in (place[lang], max(2.0, LEAST_SHARE * min(TRAIN_DOCS, totals[lang])))])
    ranked = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = counts.where(F.col("n") >= least[F.col("lang")]).withColumn("r", ranked).where(F.col("r") <= GRAMS).select("lang", "gram").toPandas()
    for i in range(len(langs)):
        for s in slots(kept["gram"].to_numpy()[kept["lang"].to_numpy() == i].view(np.uint64)):
            table[s, i // bits] |= table.dtype.type(1 << i % bits)
    fill = np.array([(table[:, i // bits] >> table.dtype.type(i % bits) & table.dtype.type(1)).mean() for i in range(len(langs))])
    return Model(langs, table, fill**HASHES)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of documents (doc_id, text, held_out)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: SLOT_BITS and the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = [t or "" for t in b.column(1).to_pylist()], []
            for x, y in in_groups([len(t) for t in texts], 2_000_000):
                out += shared.value.predict(texts[x:y])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([p[0] for p in out], pa.string()), pa.array([p[1] for p in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, OUT)


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Fit on the rows whose crc32(doc_id as text) mod ``folds`` isn't ``held``, predict all rows.

    A null text or one without a letter is ``und`` with score 0, and so is all where nothing can be learned.  A null
    doc_id is not learned from, and held_out is null for it.  A text with letters and no known n-gram gets the most frequent language, score 0.
    Rows are predicted one by one (repeated rows too); other columns are not read.
    """
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
                       (rest == held).alias("held_out")).withColumn("train", F.col("held_out") == F.lit(False))
    return predict(docs, fit(docs))

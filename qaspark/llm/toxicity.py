"""Toxicity by a counterfactual-regularised classifier (operator 4).

A logistic model on words and word beginnings.  Training pairs each labelled sentence with
copies in which identity terms are swapped (or one is put in where there is none), and penalises the square of
the score's change, so that naming a group does not make a text toxic by itself.
"""

from __future__ import annotations

import dataclasses
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from qaspark.llm.common import forget_chunks
from qaspark.session import Scratch

#: Bound of the training sample: about so many labelled documents of each class, chosen by a hash of doc_id.
TRAIN_DOCS = 6_000
#: Size of the model: features kept, half for either class, by how surely they tell the classes apart.
FEATURES = 4_000
#: Standard errors by which a feature's rates in the classes must differ; chance alone rarely gets so far.
LEAST_Z = 2.7
#: Lengths of word beginnings that are features besides the whole word (Latin, Greek and Cyrillic words decline at their end).
STEMS = (4, 5, 6)
#: Weights of the squared model weights and of the squared changes of score.
RIDGE, COUNTERFACTUAL = 2e-5, 0.1
#: A text is predicted toxic from this score on.
THRESHOLD = 0.7
#: Identity terms; a swap takes the next term of the same list.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer", "juden", "christen", "ausländer", "flüchtlinge"),
    ("femmes", "hommes", "juifs", "musulmans", "chrétiens", "immigrés"),
    ("mujeres", "hombres", "judíos", "musulmanes", "cristianos", "inmigrantes"),
)
_NEXT = {t: group[(i + 1) % len(group)] for group in IDENTITY for i, t in enumerate(group)}
_TERMS = sorted(_NEXT)
_WORD = re.compile(r"[^\W\d_]+")


def word_set(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(words: set[str]) -> set[str]:
    """Whole words ('=word') and beginnings ('^word')."""
    return {"=" + w for w in words}.union(*({"^" + w[:k] for w in words if len(w) > k} for k in STEMS))


def counterfactual(words: set[str]) -> set[str]:
    """The same words with each identity term swapped; one put in where there is none."""
    terms = words & _NEXT.keys()
    if terms:
        return words - terms | {_NEXT[t] for t in terms}
    return words | {_TERMS[zlib.crc32(min(words, default="").encode()) % len(_TERMS)]}


@dataclasses.dataclass
class Model:
    bias: float
    words: dict[str, float]
    stems: dict[str, float]

    def score(self, text: str) -> float:
        words = word_set(text)
        z = self.bias + sum(self.words[w] for w in self.words.keys() & words)
        found = {w[:k] for k in STEMS for w in words if len(w) > k}
        z += sum(self.stems[s] for s in self.stems.keys() & found)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(rows: list[tuple[list[int], list[int], int, float]], size: int, counter: float = COUNTERFACTUAL, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias from (features, features of the counterfactual, label, weight of the row).

    Minimises weighted log loss + RIDGE |w|^2 + counter * mean (change of score)^2 by accelerated gradient steps.
    """
    def sparse(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.fromiter((i for x in lists for i in x), np.int64), np.repeat(np.arange(len(lists)), [len(x) for x in lists])

    (col, row), (ccol, crow) = sparse([r[0] for r in rows]), sparse([r[1] for r in rows])
    y, weight = np.array([r[2] for r in rows], float), np.array([r[3] for r in rows], float)
    weight /= weight.sum()
    n = len(rows)
    w, b = np.zeros(size), float(np.log((weight @ y + 1e-3) / (weight @ (1 - y) + 1e-3)))
    grad2, grad2b, velocity, velocity_b = np.zeros(size), 0.0, np.zeros(size), 0.0
    for t in range(1, steps + 1):  # Adam: features differ much in how often they occur
        z = np.bincount(row, w[col], n) + b
        change = np.bincount(crow, w[ccol], n) + b - z
        r = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        c = 2 * counter * change / n
        g = np.bincount(col, (r - c)[row], size) + np.bincount(ccol, c[crow], size) + 2 * RIDGE * w
        gb = r.sum()
        velocity, velocity_b = 0.9 * velocity + 0.1 * g, 0.9 * velocity_b + 0.1 * gb
        grad2, grad2b = 0.99 * grad2 + 0.01 * g * g, 0.99 * grad2b + 0.01 * gb * gb
        rate = 0.1 / (1 + t / 100)
        w -= rate * velocity / (1 - 0.9**t) / (np.sqrt(grad2 / (1 - 0.99**t)) + 1e-7)
        b -= rate * velocity_b / (1 - 0.9**t) / (np.sqrt(grad2b / (1 - 0.99**t)) + 1e-7)
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Learn from documents (doc_id, text, train) and labels (doc_id, toxic); None where one class is missing.

    The sample is bounded by TRAIN_DOCS for each class, and so is all that the driver gets: the sampled ids (broadcast),
    FEATURES features, and which of them each sampled document has.
    """
    million = 1_000_000
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # a document labelled twice is toxic if one label says so
    total = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(total) != {0, 1}:
        return None
    share = {k: min(million, -(-TRAIN_DOCS * million // n)) for k, n in total.items()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(million))
    chosen = labels.where(draw < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    sample = docs.where("train").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_chunks()
        for b in batches:
            found: dict[str, list[int]] = {}
            docs_ = [0, 0]
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs_[y] += 1
                for f in features(word_set(t)):
                    found.setdefault(f, [0, 0])[y] += 1
            found[""] = docs_
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([v[0] for v in found.values()]), pa.array([v[1] for v in found.values()])], ["f", "n0", "n1"])

    counts = sample.mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 >= 3 or f = ''")
    with Scratch(docs.sparkSession) as tables:
        counts = tables.written(counts, "toxicity-counts")
        docs_ = counts.where("f = ''").first()
        if docs_ is None or not docs_.n0 or not docs_.n1:
            return None
        n0, n1 = float(docs_.n0), float(docs_.n1)
        p0, p1 = (F.col("n0") + 0.5) / (n0 + 1), (F.col("n1") + 0.5) / (n1 + 1)
        # how many standard errors the two classes' log rates are apart
        z = (F.log(p1) - F.log(p0)) / F.sqrt(1 / (F.col("n0") + 0.5) + 1 / (F.col("n1") + 0.5))
        scored = counts.where("f != ''").select("f", z.alias("z"))
        scored = scored.where(F.abs("z") >= LEAST_Z)
        top = [r.f for order in (F.desc("z"), F.asc("z")) for r in scored.orderBy(order, "f").limit(FEATURES // 2).collect()]
    names = sorted({*top, *features(set(_TERMS))})
    place = {f: i for i, f in enumerate(names)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, other = [], []
            for t in b.column(1).to_pylist():
                words = word_set(t)
                own.append([place[f] for f in features(words) & place.keys()])
                other.append([place[f] for f in features(counterfactual(words)) & place.keys()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.int32()))], ["toxic", "own", "other"])

    taken = sample.mapInArrow(rows, "toxic int, own array<int>, other array<int>").collect()
    taken = sorted((list(r.own), list(r.other), r.toxic, total[r.toxic] / (n1 if r.toxic else n0)) for r in taken)
    w, b = train(taken, len(names))
    used = [(f, float(x)) for f, x in zip(names, w) if abs(x) > 1e-6]
    return Model(b, {f[1:]: x for f, x in used if f[0] == "="}, {f[1:]: x for f, x in used if f[0] == "^"})


def score_rows(docs: DataFrame, model: Model | None, columns: list[str] | None = None) -> DataFrame:
    """Every row of documents as __row (the given columns, or all), with __score and __predicted; without a model all score 0."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("__row"), F.col("text").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_chunks()
        for b in batches:
            out = [model.score(t or "") if model else 0.0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64()), pa.array([int(x >= THRESHOLD) for x in out], pa.int32())], ["__row", "__score", "__predicted"])

    return rows.mapInArrow(run, StructType([rows.schema["__row"], StructField("__score", DoubleType()), StructField("__predicted", IntegerType())]))


def with_folds(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (rest == held).alias("held_out"))
            .withColumn("train", F.col("held_out") == F.lit(False)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on labelled rows whose crc32(doc_id as text) mod 3 isn't 1, score all rows by their whole text.

    A null text is empty; an empty text gets the score of the bias.  A null doc_id is not learned from and its held_out is null.
    Rows are scored one by one (repeated rows too); rows of a doc_id that comes more than once all count in training; other columns are not read.
    An empty table of labels, or one class alone, gives score 0 for all.
    """
    docs = with_folds(docs)
    scored = score_rows(docs, fit(docs, labels), ["doc_id", "held_out"])
    return scored.select("__row.doc_id", "__row.held_out", F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))

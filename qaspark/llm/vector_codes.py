"""Product codes of vectors, the nearest entry found by slices and intersected bitmasks (operator 12).

A vector is cut into parts, and each part is replaced by the index of the nearest entry of that part's codebook.

Codebook entries are sorted by their coordinate in each dimension, and for each place in that order there is a mask (a bit an entry, in unsigned 64-bit
words) of the entries before it.  The entries whose coordinate lies within a radius of a vector's are a slice of the
order: two binary searches find its ends, and the exclusive-or of the masks at the ends is its mask.  The masks of all dimensions ANDed
leave the entries in a box around the vector.  A small initial radius finds one near entry; if its distance is greater than that radius, the
box of its distance holds every entry that is as near, ties too, and the exact distances in it decide.

Codebooks are learned over all vectors by rounds of assignment and means.  Tasks send sums by entry; only these, a fixed number of
rows, and the codebooks pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.llm.common import broadcast_if_small, forget_chunks
from qaspark.session import Scratch, written

#: Vectors that are compared at a time, and dimensions after which entries that are too far are left out.
ROWS, SLICE = 2_000, 4


class Masks:
    """The entries of one codebook (rows of an int64 array), sorted by each dimension, with prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries, (n, dims) = entries, entries.shape
        self.words = -(-n // 64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, 0)
        bit = np.zeros((n, self.words), np.uint64)
        bit[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n, dtype=np.uint64) % np.uint64(64))
        self.before = [np.concatenate([np.zeros((1, self.words), np.uint64), np.bitwise_or.accumulate(bit[order[:, d]], 0)]) for d in range(dims)]
        apart = ((entries[:, None] - entries[None]).astype(float) ** 2).sum(2)
        apart[np.arange(n), np.arange(n)] = np.inf
        near = np.sqrt(apart.min(1))
        #: Half of what entries are usually apart: few lie in such a box.
        self.radius = max(1, int(np.median(near) / 2)) if n > 1 and np.isfinite(near).all() else 1

    def within(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries no more than ``radius`` from each row of x in every dimension."""
        out = np.full((len(x), self.words), ~np.uint64(0))
        for d, before in enumerate(self.before):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            out &= before[high] ^ before[low]
        return out

    def _best(self, x: np.ndarray, masks: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, their nearest entries, squared distances) among the entries of masks, where that is ``most`` or less; of equal ones the lowest entry."""
        bits = np.unpackbits(masks.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
        row, entry = np.nonzero(bits)
        far = np.zeros(len(row), np.int64)
        for d in range(0, x.shape[1], SLICE):
            far += ((x[row, d : d + SLICE] - self.entries[entry, d : d + SLICE]) ** 2).sum(1)
            near = far <= most[row]
            row, entry, far = row[near], entry[near], far[near]
        at = np.lexsort((entry, far, row))
        row, entry, far = row[at], entry[at], far[at]
        first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
        return row[first], entry[first], far[first]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row of x."""
        index, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for start in range(0, len(x), ROWS):
            part = x[start : start + ROWS]
            index[start : start + ROWS], error[start : start + ROWS] = self._nearest(part)
        return index, error

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        radius, todo, endless = np.full(len(x), self.radius, np.int64), np.arange(len(x)), np.iinfo(np.int64).max
        while len(todo):  # until each row has an entry in its box
            masks = self.within(x[todo], radius[todo])
            row, entry, far = self._best(x[todo], masks, np.full(len(todo), endless))
            index[todo[row]], error[todo[row]] = entry, far
            todo = np.setdiff1d(todo, todo[row])
            radius[todo] *= 2
        # a nearer entry, or as near a one, is in the box of this distance
        bound = np.ceil(np.sqrt(error.astype(float))).astype(np.int64) + 1
        todo = np.flatnonzero(bound > radius)
        if len(todo):
            row, entry, far = self._best(x[todo], self.within(x[todo], bound[todo]), error[todo])
            index[todo[row]], error[todo[row]] = entry, far
        return index, error


def limit(dims: int) -> int:
    """What components of a part of so many dimensions saturate at: squared distances stay below 2**62."""
    return int(2.0**30 / np.sqrt(dims))


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims).astype(np.int64)


def integer_vectors(vectors: DataFrame, parts: int = 4, scale: int = 1024, dims: int | None = None) -> tuple[DataFrame, int]:
    """(vec_id, label, v array<int>) of the vectors that are kept, and their dimension; see ``encode``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col("x").isNotNull() & (F.size("x") > 0) & ~F.coalesce(bad, F.lit(True)))
    if dims is None:
        counts = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).where(F.col("dims") % parts == 0)
        most = counts.orderBy(F.desc("n"), "dims").first()
        dims = most.dims if most else parts
    top = limit(dims // parts)
    whole = F.transform("x", lambda v: F.greatest(F.lit(-top), F.least(F.lit(top), F.floor(v * scale))).cast("int"))
    return rows.where(F.size("x") == dims).select("vec_id", "label", whole.alias("v")), dims


def learn(rows: DataFrame, dims: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> np.ndarray:
    """Codebooks (parts x entries x dims / parts) of rows (vec_id, v); fewer entries than asked for where there are fewer rows."""
    own = dims // parts
    first = rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, own).transpose(1, 0, 2)
    names = [f"s{i}" for i in range(own)]
    for _ in range(rounds if len(first) else 0):
        books = books.copy()

        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            forget_chunks()
            masks = [Masks(b) for b in books]
            total, n = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
            for b in batches:
                x = _vectors(b.column(0), dims)
                for p, m in enumerate(masks):
                    part = x[:, p * own : (p + 1) * own]
                    index, _ = m.nearest(part)
                    np.add.at(total[p], index, part)
                    n[p] += np.bincount(index, minlength=n.shape[1])
            part, entry = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(n[part, entry]), *[pa.array(c) for c in total[part, entry].T]], ["part", "entry", "n", *names])

        schema = "part long, entry long, n long, " + ", ".join(f"{c} long" for c in names)
        for r in rows.select("v").mapInArrow(sums, schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ["n", *names]]).collect():
            books[r.part, r.entry] = [r[c] // r.n for c in names]
    return books


def assign(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, codes binary, error long) of rows (vec_id, label, v): a byte a part, squared distances summed over parts."""
    parts, _, own = books.shape
    schema = f"vec_id long, label {dict(rows.dtypes)['label']}, codes binary, error long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [Masks(b) for b in books] if books.size else []  # no entries: no rows
        for b in batches:
            if not b.num_rows:
                continue
            x = _vectors(b.column(2), parts * own)
            found = [m.nearest(x[:, p * own : (p + 1) * own]) for p, m in enumerate(masks)]
            codes = np.stack([i for i, _ in found], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(sum(e for _, e in found))], ["vec_id", "label", "codes", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, schema)


def decode(codes: bytes, books: np.ndarray) -> np.ndarray:
    """The integer vector that codes stand for."""
    return np.concatenate([b[c] for b, c in zip(books, codes)])


def encode(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, dims: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes, error) of vectors (vec_id, embedding, label), a written table, and the codebooks; ``entries``: at most 256.

    Each component x becomes floor(scale * x); beyond ``limit`` it saturates (at 16 dimensions a part and scale 1024: 262144).  The codebook of a part starts as that
    part of the first vectors by vec_id (null ids last, then by components) and is moved ``rounds`` times to the floors of the means; entries that are no part's nearest stay.

    Vectors that are null, empty or hold a null or non-finite component are dropped, as are those of another length than ``dims`` (None: the
    most frequent length that can be cut into ``parts``; the smaller of two).  Null labels are a label.  Rows that repeat, also with the same vec_id, are encoded each.  An empty
    table gives no row and empty codebooks.  Other columns are not read.
    """
    with Scratch(vectors.sparkSession) as tables:
        rows, dims = integer_vectors(vectors, parts, scale, dims)
        rows = tables.written(rows, "vectors")
        books = learn(rows, dims, parts, entries, rounds)
        return written(assign(rows, books), "vector-codes"), books


def code_digests(vectors: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (errors of equal labels together), codebooks_sha256."""
    coded, books = encode(vectors)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    labels = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error"), "label-errors")
    joined = coded.join(broadcast_if_small(labels), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle(rounds: int = 4) -> str:
    """The same in SQL: all distances, one common table expression for each assignment and each move."""
    nearest = """a{i} AS MATERIALIZED (SELECT rid, p, any_value(x) AS x, min({{'d': list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))), 'e': e}}) AS best
    FROM parts JOIN b{i} USING (p) GROUP BY rid, p)"""
    moved = """m{i} AS (SELECT p, e, i, (s - ((s % n) + n) % n) // n AS c FROM (
        SELECT p, best.e AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, (SELECT m + 1 FROM own))) AS i) GROUP BY ALL)),
  b{j} AS MATERIALIZED (SELECT p, e, coalesce(k.c, b.c) AS c FROM b{i} b LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS c FROM m{i} GROUP BY p, e) k USING (p, e))"""
    steps = [s.format(i=i, j=i + 1) for i in range(rounds) for s in (nearest, moved)] + [nearest.format(i=rounds)]
    return """WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  own AS (SELECT max(len(v)) // 4 AS m FROM kept),
  parts AS MATERIALIZED (SELECT rid, p, v[p * m + 1 : (p + 1) * m] AS x FROM kept, own, (SELECT unnest(range(4)) AS p)),
  b0 AS MATERIALIZED (SELECT p, rid AS e, x AS c FROM parts WHERE rid < 256),
  """ + ",\n  ".join(steps) + f""",
  books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS digest FROM b{rounds}),
  coded AS (SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256 FROM coded JOIN kept USING (rid), books
"""


ORACLE = _oracle()

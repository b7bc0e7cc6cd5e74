"""Product codes against all distances in plain numpy."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from qaspark.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int"


def brute(rows, parts=4, entries=256, rounds=4):
    """{(vec_id, ...)} by the contract, every distance computed."""
    kept = [r for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all()]
    sizes = [len(r[1]) for r in kept if len(r[1]) % parts == 0]
    dims = max(sorted(set(sizes)), key=sizes.count) if sizes else parts
    kept = [(r[0], np.floor(np.array(r[1], np.float32).astype(float) * 1024).clip(-vc.limit(dims // parts), vc.limit(dims // parts)).astype(np.int64), r[2]) for r in kept if len(r[1]) == dims]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    if not kept:
        return [], ""
    x = np.stack([r[1] for r in kept]).reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def nearest():
        d = np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(-1) for p in range(parts)], 1)
        return d.argmin(-1), d.min(-1).sum(-1)

    for _ in range(rounds):
        index, _ = nearest()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (own := x[index[:, p] == e, p]).size:
                    books[p, e] = own.sum(0) // len(own)
    index, error = nearest()
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = {}
    for (_, _, label), e in zip(kept, error.tolist()):
        by_label[label] = by_label.get(label, 0) + e
    return [(i, bytes(c).hex(), e, by_label[label], digest) for (i, _, label), c, e in zip(kept, index.astype(np.uint8), error.tolist())], digest


def key(row):
    return (row[0] is None, *[x or 0 for x in row])


@pytest.mark.parametrize("n,dims,spread", [(900, 8, 1.0), (40, 64, 0.2), (700, 4, 0.004)])
def test_codes_equal_brute_force(spark, n, dims, spread):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(v) for v in rng.normal(size=dims).astype(np.float32) * spread], int(i % 3) if i % 4 else None) for i in rng.permutation(n)]
    rows += [(7, rows[0][1], None), (7, rows[0][1], None), (None, rows[1][1], 2), (None, [0.0] * dims, 2)]  # repeated ids and rows, no id
    rows += [(n + 1, None, 1), (n + 2, [], 1), (n + 3, [None] * dims, 1), (n + 4, [float("nan")] * dims, 1), (n + 5, [float("inf")] * dims, 1), (n + 6, [1.0], 1), (n + 7, [1e30] * dims, 1)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in vc.code_digests(d).collect()), key=key)
    want, _ = brute(rows)
    assert got == sorted(want, key=key) and len(got) == n + 5


def test_few_and_no_vectors(spark):
    rows = [(i, [float(i), 0.5, -1.0, 0.0], 1) for i in range(3)]
    got = vc.code_digests(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows)[0]) and {r.error for r in got} == {0}
    assert vc.code_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_codes_decode_to_what_the_error_is_measured_from(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=8)], 0, "x", 1) for i in range(400)]
    d = spark.createDataFrame(rows, SCHEMA)
    coded, books = vc.encode(d, entries=16)
    vectors = {r.vec_id: np.array(r.v) for r in vc.integer_vectors(d)[0].collect()}
    for r in coded.collect():
        assert ((vc.decode(r.codes, books) - vectors[r.vec_id]) ** 2).sum() == r.error


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 130), st.integers(1, 6), st.sampled_from([2, 30, 10**6]), st.integers(0, 99))
def test_nearest_is_exact_with_ties(n, dims, spread, seed):
    rng = np.random.default_rng(seed)
    entries, x = rng.integers(-spread, spread, (n, dims)), rng.integers(-2 * spread, 2 * spread, (50, dims))
    d = ((x[:, None] - entries[None]) ** 2).sum(-1)
    index, error = vc.Masks(entries).nearest(x)
    assert index.tolist() == d.argmin(1).tolist() and error.tolist() == d.min(1).tolist()

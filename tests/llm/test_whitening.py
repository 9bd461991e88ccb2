"""Whitening against exact whole numbers and one dense decomposition."""

import math
import random

import numpy as np
import pytest

from tidemark.llm import whitening
from tidemark.llm.queries import op13_whitening

SCHEMA = "vec_id long, embedding array<float>, N int, component string"


def plain(vectors, k=32):
    """Usable vectors as whole numbers: n, deviations, eigenvalues, and vectors of the covariance in double precision of exact parts."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    far = [[n * c - s for c, s in zip(row, sums)] for row in x]
    exact = [[sum(a[i] * a[j] for a in far) for j in range(len(sums))] for i in range(len(sums))]
    v = np.array([[e / n**3 for e in row] for row in exact])
    values, vecs = np.linalg.eigh(v)
    return n, [sum(c * c for c in row) for row in far], np.array(far, dtype=float) / n, values[::-1][:k], vecs[:, ::-1][:, :k], np.trace(v)


def test_against_dense(spark):
    r = random.Random(4)
    base = [[r.gauss(3 * j, 0.1 + j / 9) for j in range(37)] for _ in range(300)]
    base += [base[5]] * 60
    bad = [None, [], [None] * 37, [float("nan")] + [0.0] * 36, [float("inf")] * 37, [1e30] * 37, [1.0] * 12]
    rows = [(None if i == 3 else i // 2, v, 1, "c") for i, v in enumerate(base)] + [(1000 + i, v, 1, "c") for i, v in enumerate(bad)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    n, far, centred, values, vecs, trace = plain(base)
    assert len(got) == 32 * len(base) and {x["n"] for x in got} == {n}
    assert {x["component"] for x in got} == set(range(1, 33)) and not any((x["vec_id"] or 0) >= 1000 for x in got)
    for k in (1, 2, 17, 32):
        own = [x for x in got if x["component"] == k]
        y = centred @ vecs[:, k - 1] / math.sqrt(values[k - 1])
        key = lambda d, w: (d, round(abs(w), 6))
        got_k, want_k = sorted(key(x["deviation"], x["whitened"]) for x in own), sorted(key(d, w) for d, w in zip(far, y))
        assert [d for d, _ in got_k] == [d for d, _ in want_k] and np.allclose([w for _, w in got_k], [w for _, w in want_k], atol=1e-5)
        assert own[0]["explained"] == pytest.approx(values[k - 1] / trace, rel=1e-9)
    assert all(x["identity_error"] < 1e-9 for x in got)
    w = np.array([[x["whitened"] for x in sorted((y for y in got if y["component"] == k), key=lambda y: (y["vec_id"] if y["vec_id"] is not None else -1, y["deviation"]))] for k in range(1, 33)])
    assert np.abs(w @ w.T / n - np.eye(32)).max() < 1e-6


def test_tiles(spark):
    """Any width of a tile, also one that doesn't divide the dimensions, and many row blocks: one covariance."""
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 10)) @ r.normal(size=(10, 10)) * 40
    rows = whitening.usable(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(7), "vec_id", "embedding")
    n, sums = whitening.exact_sums(rows)
    whole = np.floor(64 * x)
    want = np.cov(whole.T, bias=True)
    for block in (1, 3, 4, 10, 64):
        assert np.allclose(whitening.covariance(whitening.column_blocks(rows, block), n, sums, block), want, rtol=1e-10)


def test_odd_tables(spark):
    for rows in ([], [(1, None, 0, "")], [(1, [1.0, 2.0], 0, "")], [(1, [1.0, 2.0], 0, ""), (2, [1.0, 2.0], 0, "")]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 5.0, -2.0 * i], 0, "") for i in range(8)], SCHEMA)
    got = whitening.whiten(flat).collect()
    assert len(got) == 8 and got[0]["explained"] == pytest.approx(1.0)


def test_deviations_beyond_the_fast_way():
    n = 1 << 20
    x = np.array([[0, 5], [3, 1 << 10]], dtype=np.int64)
    sums = np.array([n + 7, 9], dtype=object)
    want = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x, n, sums).tolist() == want
    with pytest.raises(OverflowError):
        whitening.deviations(x * (1 << 12), n, sums)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = op13_whitening(spark, sf).filter("component = 1").collect()
    vectors = [r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, far, centred, values, vecs, trace = plain(vectors)
    assert sorted(r["deviation"] for r in got) == sorted(far) and got[0]["explained"] == pytest.approx(values[0] / trace, rel=1e-9)

"""Operator 11 against exact integer sums and a plain eigendecomposition."""

import math

import numpy as np
import pytest

from stacksmith.llm import queries as Q
from stacksmith.llm import whitening as W


def brute(rows, scale=256, components=4):
    """{(index, component): (deviation, |whitened|, explained)} and n, from Python integers."""
    kept = {}
    for i, v in enumerate(rows):
        if v is not None and all(e is not None and math.isfinite(e) for e in v):
            kept[i] = tuple(math.floor(e * scale) for e in v)
    fit = sorted(set(kept.values()))
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    v = [[sum((n * x[j] - s[j]) * (n * x[k] - s[k]) for x in fit) / n ** 3 for k in range(d)] for j in range(d)]
    e, vec = np.linalg.eigh(np.array(v))
    out = {}
    for i, x in kept.items():
        c = [n * x[j] - s[j] for j in range(d)]
        for k in range(min(components, d)):
            if e[-1 - k] > 1e-9 * e[-1]:
                out[i, k + 1] = (sum(a * a for a in c), abs(sum(a / n * b for a, b in zip(c, vec[:, -1 - k]))) / math.sqrt(e[-1 - k]), e[-1 - k] / e.sum())
    return out, n


def check(got, want, n):
    assert {(r.vec_id, r.component) for r in got} == set(want)
    for r in got:
        deviation, whitened, explained = want[r.vec_id, r.component]
        assert int(r.deviation) == deviation and r.n == n
        assert abs(r.whitened) == pytest.approx(whitened, rel=1e-7, abs=1e-9) and r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-8


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    got = Q.QUERIES["op11_embedding_whitening"](spark, sf).collect()
    want, n = brute([r.embedding for r in rows])
    ids = [r.vec_id for r in rows]
    check(got, {(ids[i], k): v for (i, k), v in want.items()}, n)


def test_unusable_rows_repeats_and_other_columns(spark):
    rng = np.random.default_rng(3)
    rows = [[float(a) for a in rng.normal(size=3) * (3, 2, 1)] for _ in range(40)]
    rows += rows[:5] * 20 + [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], [-0.0, 0.0, 0.0]]
    data = [(i, v, "x", 1, 2) for i, v in enumerate(rows)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, x string, n int, component int")
    usable = [v if v is not None and len(v) == 3 else None for v in rows]
    want, n = brute(usable)
    check(W.whiten_embeddings(df).collect(), want, n)


def test_large_integers_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [[float(a) for a in rng.integers(-10 ** 12, 10 ** 12, 3)] for _ in range(30)]
    want, n = brute(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    check(W.whiten_embeddings(df).collect(), want, n)


def test_no_rows_or_one_vector(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (None, [1.0, 2.0])], [(1, None)]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert W.whiten_embeddings(df).collect() == []


def test_planes_give_exact_products():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 20, (1000, 2)).astype(np.uint64)
    p = W.bit_planes(x, [20, 20])
    total = sum(int(np.bitwise_count(p[a] & p[20 + b]).sum()) << (a + b) for a in range(20) for b in range(20))
    assert total == sum(int(a) * int(b) for a, b in x)

"""Operator 11: whiten embeddings by a bit-sliced scatter matrix.

Entries become integers, floor(scale * c).  The fit list holds each distinct
integer vector once.  A task takes its rows in blocks of 65 536, shifts each
dimension by its smallest entry, and packs every bit of it across the rows into
64-bit words: a plane per dimension and bit.  The popcount of two planes' AND,
weighted by both bits' values, adds up to the exact sum of products of any two
dimensions.  Only those D (D + 1) / 2 integers leave a task; Spark sums them as
decimals.  The driver centres them as integers (n * XX - S S'), turns them into
doubles once, and takes the eigenvectors of the D x D matrix.  Whitening is one
more pass over all rows, and one over the fit list measures the identity error.

Defined results: a row whose vector is null or empty, holds a null or a
non-finite entry, or an entry whose integer passes 2^62, is dropped; so are
vectors of another length than the most frequent one (the longest of equally
frequent ones).  Equal rows are fitted once and all returned; a null id is an
id.  Components whose eigenvalue is zero in double precision are left out, so a
single distinct vector, or an empty table, gives no rows.  ``deviation`` is a
decimal; beyond 38 digits it is null.  Only the id and the vector are read, so
other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacksmith.llm.shared import written

BLOCK = 1 << 16
LARGEST = float(1 << 62)
EXACT = 1 << 62
_TOTALS = "j int, k int, total decimal(38,0)"


def integer_vectors(rows: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """(vec_id, x) of the usable rows, x as array<long>, all of the most frequent length."""
    c = F.col("v")
    fine = F.coalesce(F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e * scale) < LARGEST)), F.lit(False)) & (F.size(c) > 0)
    kept = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(fine)
    x = written(kept.select("vec_id", F.transform(c, lambda e: F.floor(e * scale).cast("long")).alias("x")), "integers")
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return x.filter(F.size("x") == (lengths["d"] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), np.int64)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sums, smallest and largest entry of every dimension in a batch."""
    for batch in batches:
        x = _matrix(batch.column(0))
        if not len(x):
            continue
        total = (x >> 31).sum(axis=0).astype(object) * (1 << 31) + (x & ((1 << 31) - 1)).sum(axis=0).astype(object)
        d = x.shape[1]
        yield pa.record_batch([pa.array(np.arange(d, dtype=np.int32)), pa.array([len(x)] * d, pa.int64()), pa.array(_decimals(total), pa.decimal128(38)),
                               pa.array(x.min(axis=0)), pa.array(x.max(axis=0))], names=["j", "n", "total", "lo", "hi"])


def _decimals(values) -> list[Decimal | None]:
    return [Decimal(int(v)) if abs(int(v)) < 10 ** 38 else None for v in values]


def bit_planes(x: np.ndarray, bits: list[int]) -> np.ndarray:
    """Planes (dimension by dimension, lowest bit first) of non-negative integers, packed across rows into 64-bit words."""
    rows = np.zeros((sum(bits), -(-len(x) // 64) * 64), np.uint8)
    at = 0
    for j, b in enumerate(bits):
        for i in range(b):
            rows[at, :len(x)] = (x[:, j] >> np.uint64(i)) & np.uint64(1)
            at += 1
    return np.packbits(rows, axis=1, bitorder="little").view(np.uint64)


def _scatter(low: list[int], bits: list[int]):
    """Exact sums of products of the shifted dimensions of a task's rows, one row for j <= k."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, d = sum(bits), len(bits)
        counts = np.zeros((planes, planes), np.int64)
        shift = np.array(low, np.int64)

        def add(block: list[np.ndarray]) -> None:
            p = bit_planes((np.concatenate(block) - shift).view(np.uint64), bits)
            for i in range(planes):
                counts[i, i:] += np.bitwise_count(p[i:] & p[i]).sum(axis=1, dtype=np.int64)

        held, size = [], 0
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                held.append(x)
                size += len(x)
            if size >= BLOCK:
                add(held)
                held, size = [], 0
        if size:
            add(held)
        if not counts.any():
            return
        edges = np.cumsum([0, *bits])
        both = counts + np.triu(counts, 1).T
        js, ks, totals = [], [], []
        for j in range(d):
            for k in range(j, d):
                part = both[edges[j]:edges[j + 1], edges[k]:edges[k + 1]].tolist()
                js.append(j)
                ks.append(k)
                totals.append(sum(c << (a + b) for a, row in enumerate(part) for b, c in enumerate(row)))
        yield pa.record_batch([pa.array(js, pa.int32()), pa.array(ks, pa.int32()), pa.array(_decimals(totals), pa.decimal128(38))], names=["j", "k", "total"])
    return run


class Whitener:
    """The fitted map: n and S of the fit list, and directions (components by dimensions) with their shares of the trace."""

    def __init__(self, n: int, sums: list[int], scatter: list[list[int]], components: int) -> None:
        """``scatter``: n * XX - S S', exact integers."""
        self.n, self.sums = n, sums
        v = np.array([[a / (n * n) for a in row] for row in scatter])
        e, vectors = np.linalg.eigh(v)
        e, vectors = e[::-1], vectors[:, ::-1]
        real = int((e > len(e) * np.finfo(float).eps * max(e[0], 0.0)).sum())
        k = min(components, real)
        self.directions = (vectors[:, :k] / np.sqrt(e[:k])).T.copy()
        self.explained = (e[:k] / sum(scatter[j][j] / (n * n) for j in range(len(scatter)))).tolist() if k else []

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: as 64-bit integers where they fit, else as Python integers."""
        if self.n * max(map(abs, (int(x.min()), int(x.max())))) + max(map(abs, self.sums)) < EXACT:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def deviations(self, c: np.ndarray) -> list[int]:
        most = max(abs(int(c.min())), abs(int(c.max())))
        if c.dtype == object or most * most * c.shape[1] >= EXACT:
            c = c.astype(object)
        return (c * c).sum(axis=1).tolist()

    def whiten(self, c: np.ndarray) -> np.ndarray:
        return (c / self.n).astype(float) @ self.directions.T


def fit_whitener(distinct: DataFrame, components: int) -> Whitener | None:
    """Fit on a column ``x`` of distinct integer vectors of one length; None without rows."""
    per_dim = distinct.mapInArrow(_sums, "j int, n long, total decimal(38,0), lo long, hi long")
    stats = per_dim.groupBy("j").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("j").collect()
    if not stats:
        return None
    n, low, sums = stats[0]["n"], [r["lo"] for r in stats], [int(r["total"]) for r in stats]
    bits = [max(1, (r["hi"] - r["lo"]).bit_length()) for r in stats]
    found = distinct.mapInArrow(_scatter(low, bits), _TOTALS).groupBy("j", "k").agg(F.sum("total").alias("total")).collect()
    d = len(stats)
    scatter = [[0] * d for _ in range(d)]
    shifted = [s - n * a for s, a in zip(sums, low)]
    for r in found:  # the shift leaves n * XX - S S' as it is
        scatter[r["j"]][r["k"]] = scatter[r["k"]][r["j"]] = n * int(r["total"]) - shifted[r["j"]] * shifted[r["k"]]
    return Whitener(n, sums, scatter, components)


def _moments(shared):
    """Sums and products of the whitened vectors of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, k = shared.value, len(shared.value.explained)
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                y = w.whiten(w.centred(x))
                total += y.sum(axis=0)
                products += y.T @ y
        j, l = np.indices((k, k)).reshape(2, -1)
        yield pa.record_batch([pa.array(np.append(np.full(k, -1), j).astype(np.int32)), pa.array(np.append(np.arange(k), l).astype(np.int32)),
                               pa.array(np.append(total, products.ravel()))], names=["j", "k", "total"])
    return run


def identity_error(distinct: DataFrame, shared, n: int, components: int) -> float:
    """Largest absolute entry of the fit list's whitened covariance minus the identity."""
    found = distinct.mapInArrow(_moments(shared), "j int, k int, total double").groupBy("j", "k").agg(F.sum("total").alias("total")).collect()
    mean, cov = np.zeros(components), np.zeros((components, components))
    for r in found:
        if r["j"] < 0:
            mean[r["k"]] = r["total"] / n
        else:
            cov[r["j"], r["k"]] = r["total"] / n
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(components)).max())


def _whitened(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, k = shared.value, len(shared.value.explained)
        for batch in batches:
            x = _matrix(batch.column(1))
            if not len(x):
                continue
            c = w.centred(x)
            rows = np.repeat(np.arange(len(x)), k)
            deviation = pa.array(_decimals(w.deviations(c)), pa.decimal128(38))
            yield pa.record_batch(
                [batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), deviation.take(pa.array(rows)),
                 pa.array(w.whiten(c).ravel()), pa.array(np.tile(w.explained, len(x)))], names=["vec_id", "component", "deviation", "whitened", "explained"])
    return run


def whiten_embeddings(rows: DataFrame, components: int = 4, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every usable row and component."""
    spark = rows.sparkSession
    x = integer_vectors(rows, vec_id, vector, scale)
    distinct = written(x.select("x").distinct(), "fit-list")
    model = fit_whitener(distinct, components)
    kind = x.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, deviation decimal(38,0), whitened double, explained double"
    if model is None or not model.explained:
        return spark.createDataFrame([], schema.replace("component int,", "component int, n long,") + ", identity_error double")
    shared = spark.sparkContext.broadcast(model)
    error = identity_error(distinct, shared, model.n, len(model.explained))
    out = x.mapInArrow(_whitened(shared), schema)
    return out.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))

"""Exact k-nearest neighbours in blocks (jn09, ml07).

Both sides are dealt to cells around P pivots (KMeans centres of the reference
rows: P vectors reach the driver, independent of the row count), and cells to
blocks of about BLOCK rows.  A pair of blocks is one group of a cogroup: numpy
takes all its distances as one matrix product, and only rows that can be among
a query's k nearest of the block leave it, at most k a query and block and
those tied with the last.  No row per pair is ever made.

Round 1: each query block meets the nearest cells that hold k rows; the k-th
distance found there, tau, bounds the true one.  Round 2: it meets the blocks
that the triangle inequality cannot rule out, d(pivot, pivot) - R - R' <= tau,
and rows beyond a query's own tau are not returned.

The matrix product only screens, with slack for its rounding.  Distances that
are returned are summed left to right in double precision, and ties go to the
smaller reference id, so the result does not depend on blocks or pivots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacksmith.operators.rank import cut

SLACK = 1e-9
#: Rows of a block on either side; pivots at most.
BLOCK, PIVOTS = 2048, 16


def sq_dist(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two equal-length double arrays, summed left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def top_k_per_key(pairs: DataFrame, key: str, k: int, order: list[str], salt: int = 32) -> DataFrame:
    """k smallest rows per ``key`` by ``order`` in two rounds: top-k inside
    (key, salt) sub-groups, then top-k of the at most salt*k survivors, so
    a query with a huge candidate set is never sorted in one task."""
    s = pairs.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(salt)))
    r1 = s.withColumn("_r1", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order)))
    r1 = r1.filter(F.col("_r1") <= k).drop("_r1", "_salt")
    r2 = r1.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return r2.filter(F.col("rank") <= k)


def _placed(rows: DataFrame, centers: list[list[float]], block: int) -> tuple[DataFrame, DataFrame]:
    """(rows with cell, block number and distance to the pivot, one row per block with size and radius); both written or derived from written rows."""
    pivots = F.array(*[F.array(*[F.lit(x) for x in c]) for c in centers])
    each = F.transform(F.sequence(F.lit(0), F.lit(len(centers) - 1)),
                       lambda i: F.struct(sq_dist(F.col("_v"), F.element_at(pivots, i + 1)).alias("d2"), i.alias("c")))
    # The row number is fixed by the write, so that blocks stay as they are when a task is run again.
    near = cut(rows.withColumn("_best", F.array_min(each)).withColumn("_no", F.monotonically_increasing_id())
               .select(*rows.columns, "_no", F.col("_best.c").alias("cell"), F.sqrt(F.col("_best.d2")).alias("_r")), "placed")
    sizes = near.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(float(block))).cast("int").alias("_blocks"))  # P rows
    dealt = near.join(F.broadcast(sizes), "cell").withColumn("sub", F.pmod(F.xxhash64("_no"), F.col("_blocks")).cast("int")).drop("_blocks")
    return dealt, dealt.groupBy("cell", "sub").agg(F.count("*").alias("n"), F.max("_r").alias("radius"))


def _nearest_in_block(k: int, names: list[str], kinds: pa.Schema):
    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        if not len(q) or not len(r):
            return kinds.empty_table()
        a, b = (t["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) for t in (q, r))
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        near = aa[:, None] + bb[None, :] - 2.0 * (a @ b.T)
        limit = q["_tau2"].to_numpy()
        if len(b) > k:
            limit = np.minimum(limit, np.partition(near, k - 1, axis=1)[:, k - 1])
        slack = SLACK * (aa + bb.max() + 1.0)
        i, j = np.nonzero(near <= (limit + slack)[:, None])
        d2 = np.zeros(len(i))
        for x, y in zip(a.T, b.T):  # in the order of the dimensions
            step = x[i] - y[j]
            d2 += step * step
        ids = r["_rkey"].to_numpy()[j]
        order = np.lexsort((ids, d2, i))
        first = np.searchsorted(i[order], i[order])  # np.nonzero returns rows in order, so does the sort
        order = order[np.arange(len(order)) - first < k]
        left, right = pa.array(i[order]), pa.array(j[order])
        return pa.table([q["_no"].take(left), q["_qkey"].take(left), *[r[c].take(right) for c in names], pa.array(d2[order])], schema=kinds)
    return run


def knn_join(queries: DataFrame, reference: DataFrame, k: int, qkey: str = "qid", rkey: str = "rid",
             vec: str = "vec", n_pivots: int | None = None, seed: int = 42, keep_ref: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """For every query row, its k nearest reference rows: (qkey, rkey, rank, d2, *keep_ref).

    Without ``n_pivots``: one for each block that the reference rows fill, 2 to PIVOTS.  ``vec`` is a numeric array of one length in both frames; reference ids are not null.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    ref = reference.select(F.col(rkey).alias("_rkey"), F.col(vec).cast("array<double>").alias("_v"), *keep_ref)
    q = queries.select(F.col(qkey).alias("_qkey"), F.col(vec).cast("array<double>").alias("_v"))
    n_pivots = n_pivots or max(2, min(PIVOTS, -(-ref.count() // block)))
    km = KMeans(k=n_pivots, seed=seed, featuresCol="_fv", predictionCol="cell", maxIter=10).fit(
        ref.select(array_to_vector("_v").alias("_fv")))
    centers = [[float(x) for x in c] for c in km.clusterCenters()]
    apart = np.sqrt(((np.array(centers)[:, None] - np.array(centers)[None]) ** 2).sum(axis=2))
    r, r_blocks = _placed(ref, centers, block)
    q, q_blocks = _placed(q, centers, block)
    r_blocks = cut(r_blocks.select(F.col("cell").alias("rcell"), F.col("sub").alias("rsub"), "n", F.col("radius").alias("rradius")), "blocks")
    held = {x["rcell"]: x["n"] for x in r_blocks.groupBy("rcell").agg(F.sum("n").alias("n")).collect()}  # P rows

    first = []  # of each query cell: (cell, distance, whether round 1 meets it)
    for c in range(len(centers)):
        total, cells = 0, []
        for d in np.argsort(apart[c], kind="stable").tolist():
            if d in held:
                cells.append((d, float(apart[c, d]), total < k))
                total += held[d]
        first.append(cells)
    table = F.array(*[F.array(*[F.struct(F.lit(d).alias("rcell"), F.lit(x).alias("apart"), F.lit(one).alias("one")) for d, x, one in cells]) for cells in first])
    kinds = f"_no long, _qkey {q.schema['_qkey'].dataType.simpleString()}, " + "".join(
        f"{c} {ref.schema[c].dataType.simpleString()}, " for c in ("_rkey", *keep_ref)) + "d2 double"
    kernel = _nearest_in_block(k, ["_rkey", *keep_ref], to_arrow_schema(reference.sparkSession.createDataFrame([], kinds).schema))

    def met(rows: DataFrame, blocks: DataFrame, one: bool) -> DataFrame:
        """The best rows of every pair of blocks; ``rows``: queries with _tau2, ``blocks``: query blocks with radius and reach."""
        pairs = blocks.select("cell", "sub", "radius", "reach", F.explode(F.element_at(table, F.col("cell") + 1)).alias("x")).select(
            "cell", "sub", "radius", "reach", "x.*").filter(F.col("one") == one).join(r_blocks, "rcell")
        pairs = cut(pairs.filter(F.col("apart") - F.col("radius") - F.col("rradius") <= F.col("reach") * (1 + SLACK) + SLACK)
                    .select("cell", "sub", "rcell", "rsub"), "block-pairs")
        keys = ["cell", "sub", "rcell", "rsub"]
        left = rows.join(pairs, ["cell", "sub"]).select(*keys, "_no", "_qkey", "_v", "_tau2")
        right = r.withColumnsRenamed({"cell": "rcell", "sub": "rsub"}).join(pairs, ["rcell", "rsub"]).select(*keys, "_rkey", "_v", *keep_ref)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernel, kinds)

    far = F.lit(float("inf"))
    found = cut(met(q.withColumn("_tau2", far), q_blocks.withColumn("reach", far), True), "round-1")
    best = top_k_per_key(found, "_no", k, ["d2", "_rkey"])
    tau = cut(best.groupBy("_no").agg(F.when(F.count("*") >= k, F.max("d2")).otherwise(far).alias("_tau2")), "tau")
    asked = cut(q.join(tau, "_no", "left").withColumn("_tau2", F.coalesce("_tau2", far)), "asked")
    reach = asked.groupBy("cell", "sub").agg(F.max("_r").alias("radius"), F.sqrt(F.max("_tau2")).alias("reach"))
    more = met(asked, reach, False)
    out = top_k_per_key(found.unionByName(more), "_no", k, ["d2", "_rkey"])
    return out.select(F.col("_qkey").alias(qkey), F.col("_rkey").alias(rkey), "rank", "d2", *keep_ref)


def knn_classify(queries: DataFrame, reference: DataFrame, k: int, label: str = "label", **kw) -> DataFrame:
    """ml07: uniform vote = mean label of the k neighbours."""
    nn = knn_join(queries, reference, k, keep_ref=(label,), **kw)
    return nn.groupBy(kw.get("qkey", "qid")).agg(F.avg(label).alias("proba"))

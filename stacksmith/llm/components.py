"""Connected components by alternating large and small stars, as DataFrame joins.

Edges point from a node to a smaller one.  A round hangs every node on the
smallest node that its centre knows (large star), then brings all centres of a
node under the smallest of them (small star); it ends when only stars are
left.  Before the first round every task contracts its own edges, at most LOCAL
nodes at a time, which drops repeated edges and shortens chains without a
shuffle.  Least centres come from partial aggregates.  All tables of a round
are written to the shared folder, so both sides of its joins are plain shuffles
and the rows of the centre of a large component can be split among tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacksmith.llm.shared import written

LOCAL = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a task as stars: every node with the smallest node it is connected to here."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (r := root.setdefault(x, x)) != x:
            root[x] = root[r]
            x = r
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in root if (r := find(x)) != x]
        root.clear()
        return pa.record_batch([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > LOCAL:
            yield stars()
    yield stars()


def _least(edges: DataFrame) -> DataFrame:
    """(x, m): the smallest node that each node hangs on."""
    return written(edges.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("m")), "least")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is its smallest reachable node."""
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    e = written(e.mapInArrow(_contract, "a long, b long"), "edges")
    for _ in range(max_rounds):
        least = _least(e)
        hung = e.join(least, e["b"] == least["x"], "left").select("a", F.coalesce("m", "b").alias("b"))
        large = written(hung.union(least.select(F.col("x").alias("a"), F.col("m").alias("b"))), "large-star")
        least = _least(large)
        centres = large.join(least, large["a"] == least["x"]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        e = written(centres.union(least.select(F.col("x").alias("a"), F.col("m").alias("b"))), "small-star")
        if _settled(e):
            nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one centre, and no centre hangs on another."""
    ends = edges.select(F.col("a").alias("x"), F.col("b").alias("on")).union(edges.select(F.col("b").alias("x"), F.col("b").alias("on")))
    loose = ends.groupBy("x").agg(F.min("on").alias("lo"), F.max("on").alias("hi")).filter("lo < hi")
    return not loose.limit(1).count()

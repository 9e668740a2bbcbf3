"""Embedding near-duplicates by a forest of random-projection trees with spill.

Each tree splits unit vectors at the median of a random projection; a vector
within the spill margin of a split goes to both sides.  Vectors that share a
leaf of any tree (and the label) are compared by cosine in double precision.  A
pair is counted in the first leaf it shares only, so no list of pairs is ever
made: a leaf gives link counts and the edges of a spanning star.  Equal vectors
are one class, compared once and counted as often as they occur.

The trees are fitted on the driver from SAMPLE classes at most; all rows are
indexed.  The margin is SPILL standard deviations of the projected difference
of a pair at the threshold; tests measure the recall against brute force.
Leaves larger than BLOCK are split in blocks that meet pair by pair.

Vectors that are null, empty, zero, or hold null or non-finite components, and
vectors without a label, link with nothing.  Vectors of different length are
never compared.  Equal rows are separate vectors that link.  Rows with a null
id take part, but give no component its id.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacksmith.llm.components import components
from stacksmith.llm.shared import hashed_sample, written

TREES = 3
LEAF = 2048
BLOCK = 1024
SPILL = 0.8
SAMPLE = 20_000

_ROUTED = "tree int, leaf int, label int, dim int, cls long, copies long, leaves array<int>, vector binary"


class Tree:
    """Arrays of one tree: projection, threshold, children (a child below 0 is leaf ``-child - 1``)."""

    def __init__(self, sample: np.ndarray, depth: int, rng: np.random.Generator) -> None:
        self.directions: list[np.ndarray] = []
        self.thresholds: list[float] = []
        self.children: list[list[int]] = []
        self.n_leaves = 0
        self.root = self._grow(sample, depth, rng)

    def _grow(self, rows: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        if depth == 0 or len(rows) < 8:
            self.n_leaves += 1
            return -self.n_leaves
        direction = rng.standard_normal(rows.shape[1])
        direction /= np.linalg.norm(direction)
        at = rows @ direction
        threshold = float(np.median(at))
        node = len(self.thresholds)
        self.directions.append(direction)
        self.thresholds.append(threshold)
        self.children.append([0, 0])
        self.children[node] = [self._grow(rows[at <= threshold], depth - 1, rng), self._grow(rows[at > threshold], depth - 1, rng)]
        return node

    def route(self, rows: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row spills into."""
        out_row, out_leaf, todo = [], [], [(self.root, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                out_row.append(at)
                out_leaf.append(np.full(len(at), -node - 1))
                continue
            off = rows[at] @ self.directions[node] - self.thresholds[node]
            todo.append((self.children[node][0], at[off <= margin]))
            todo.append((self.children[node][1], at[off > -margin]))
        return np.concatenate(out_row), np.concatenate(out_leaf)


def _unit(column: pa.Array, kind: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: (rows, unit vectors in double precision) of a binary column."""
    sizes: dict[int, list[int]] = {}
    data = column.to_pylist()
    for i, v in enumerate(data):
        sizes.setdefault(len(v), []).append(i)
    out = {}
    for rows in sizes.values():
        m = np.stack([np.frombuffer(data[i], kind) for i in rows]).astype(np.float64)
        # Scaled first, so that very large or small components keep a finite, non-zero norm.
        m /= np.abs(m).max(axis=1, keepdims=True)
        out[m.shape[1]] = np.array(rows), m / np.linalg.norm(m, axis=1, keepdims=True)
    return out


def _route(forests, margin_at: float, kind: str):
    """One row for every leaf of every tree; vectors of a length without trees go to leaf 0 of tree 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, (at, unit) in _unit(batch.column("vector"), kind).items():
                forest = forests.value.get(dim) or []
                margin = margin_at / math.sqrt(dim)
                routes = [tree.route(unit, margin) for tree in forest] or [(np.arange(len(at)), np.zeros(len(at), np.int64))]
                rows, leaves = zip(*routes)
                trees = [np.full(len(r), t) for t, r in enumerate(rows)]
                row, tree_of, leaf = (np.concatenate(x) for x in (rows, trees, leaves))
                code = (tree_of << 20) | leaf
                order = np.lexsort((code, row))
                own = np.split(code[order], np.searchsorted(row[order], np.arange(1, len(at))))
                pick = pa.array(at[row])
                offsets = np.concatenate([[0], np.cumsum([len(own[r]) for r in row.tolist()])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([own[r] for r in row.tolist()]).astype(np.int32)))
                yield pa.record_batch([pa.array(tree_of.astype(np.int32)), pa.array(leaf.astype(np.int32)), batch.column("label").take(pick),
                                       pa.array(np.full(len(row), dim, np.int32)), batch.column("cls").take(pick),
                                       batch.column("copies").take(pick), lists, batch.column("vector").take(pick)],
                                      names=["tree", "leaf", "label", "dim", "cls", "copies", "leaves", "vector"])
    return run


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of rows sorted by their first ``n_keys`` integer columns, one group at a time."""
    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if (k := tuple(keys[lo].tolist())) != key:
                if parts:
                    yield key, pa.Table.from_batches(parts)
                key, parts = k, []
            parts.append(batch.slice(lo, hi - lo))
    if parts:
        yield key, pa.Table.from_batches(parts)


def _earlier(leaves: list[list[int]], code: int) -> np.ndarray:
    """Membership of each row in the leaves that come before ``code``."""
    before = sorted({x for own in leaves for x in own if x < code})
    at = {x: i for i, x in enumerate(before)}
    out = np.zeros((len(leaves), len(before)), np.float32)
    for i, own in enumerate(leaves):
        out[i, [at[x] for x in own if x < code]] = 1
    return out


def _compare(threshold: float, kind: str):
    """(cls, links, root): the links of each class that this unit counts first, and its smallest class reached in the unit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, leaf, _, _, b1, b2), rows in _groups(batches, 6):
            rows = rows.combine_chunks()
            cls, copies = rows.column("cls").to_numpy(), rows.column("copies").to_numpy()
            ((_, (_, unit)),) = _unit(rows.column("vector").chunk(0), kind).items()
            first = _earlier(rows.column("leaves").to_pylist(), (tree << 20) | leaf)
            near = unit @ unit.T >= threshold
            np.fill_diagonal(near, False)
            if b1 != b2:  # pairs of one block are counted where that block meets itself
                block = rows.column("block").to_numpy()
                near &= block[:, None] != block[None, :]
            new = near & (first @ first.T == 0) if first.shape[1] else near
            links = new.astype(np.float64) @ copies
            root = np.arange(len(cls))
            while True:
                least = np.minimum(root, np.where(near, root[None, :], len(cls)).min(axis=1, initial=len(cls)))
                least = least[least]
                if (least == root).all():
                    break
                root = least
            some = near.any(axis=1)
            yield pa.record_batch([pa.array(cls[some]), pa.array(links[some].astype(np.int64)), pa.array(cls[root[some]])],
                                  names=["cls", "links", "root"])
    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, trees: int = TREES, leaf: int = LEAF,
                    block: int = BLOCK, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable by links, itself included), kept."""
    spark = vectors.sparkSession
    double = "double" in vectors.schema["embedding"].dataType.simpleString()
    kind, cast = ("<f8", "array<double>") if double else ("<f4", "array<float>")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast(cast))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("cls", F.when(usable, F.xxhash64("label", "embedding")))
    classes = (rows.filter("cls is not null").groupBy("cls")
               .agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("copies")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [np.array(v, kind).tobytes() for v in b.column("embedding").to_pylist()]
            yield pa.record_batch([b.column("cls"), b.column("label"), b.column("copies"), pa.array(data, pa.binary())],
                                  names=["cls", "label", "copies", "vector"])

    classes = written(classes.select("cls", "label", "copies", "embedding")
                      .mapInArrow(packed, "cls long, label int, copies long, vector binary"), "vector-classes")
    total = classes.count()
    picked = hashed_sample(classes, sample, "cls").select("vector").collect()
    rng, forests = np.random.default_rng(seed), {}
    if picked:
        for dim, (_, unit) in _unit(pa.array([bytes(r[0]) for r in picked], pa.binary()), kind).items():
            depth = max(0, math.ceil(math.log2(max(1, total * len(unit) / len(picked) / leaf))))
            forests[dim] = [Tree(unit, depth, rng) for _ in range(trees if depth else 1)]
    margin = SPILL * math.sqrt(2 * (1 - threshold))
    routed = written(classes.mapInArrow(_route(spark.sparkContext.broadcast(forests), margin, kind), _ROUTED), "routed")

    key = ["tree", "leaf", "label", "dim"]
    blocks = routed.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("blocks > 1")
    units = (routed.join(blocks, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other"))
             .select(*key, "b1", "b2", "block", "cls", "copies", "leaves", "vector"))
    order = [*key, "b1", "b2"]
    found = written(units.repartition(*order).sortWithinPartitions(*order)
                    .mapInArrow(_compare(threshold, kind), "cls long, links long, root long"), "vector-links")
    groups = components(found.filter("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    ids = (rows.filter("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("m"), F.count("*").alias("copies"))
           .join(links, "cls", "left").join(groups.select(F.col("node").alias("cls"), F.col("component").alias("grp")), "cls", "left")
           .withColumn("grp", F.coalesce("grp", "cls")))
    smallest = ids.groupBy("grp").agg(F.min("m").alias("component_id"))
    of_class = ids.join(smallest, "grp").select("cls", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.join(of_class, "cls", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                                                    F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

"""N-gram Jaccard join with signature trees.

Texts with equal shingle sets form one class.  Classes that can reach the
threshold share a shingle among their rarest ``size - ceil(t * size) + 1`` (any
fixed order of shingles will do; the order here comes from a count table of
fixed size over all documents, so passages that many documents share come
last).  For each shared shingle its classes build a signature tree: leaves hold
token bitmaps, inner nodes the OR of their members and their range of set
sizes.  A dual traversal from the root drops node pairs whose largest possible
overlap is too small; surviving pairs make candidate clusters.  Each class then
sends its whole set once, to its cluster, where a second signature tree finds
the pairs to compare exactly.  A traversal skips pairs that are connected
already, so a group of copies costs about one comparison a member.

Hot shingles are split in blocks of BLOCK members that meet block by block; hot
clusters first reduce block by block to one class of each linked group, then
the classes outside the largest group meet every block.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  Null or empty text:
empty set, linked with nothing.  Fewer words than k: one shingle.  Equal rows
and rows that repeat an id with another text are documents of their own; a row
with a null id takes part, but gives no component its id.  Classes and shingles
are told apart by 64-bit hashes.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacksmith.llm import text as T
from stacksmith.llm.components import components
from stacksmith.llm.shared import same, text_col, written

#: Slots of the shingle count table and rows it is sent in.
SLOTS, SLOT_ROWS = 1 << 20, 32
#: Members of one tree at most.
BLOCK = 1024
CLUSTER_BLOCK = 256
LEAF = 8
#: Bits of the table that screens which documents are in a cluster.
FILTER_BITS = 1 << 24
SEEN = 200_000

_MASK = np.uint64(SLOTS - 1)


# ---------------------------------------------------------------- shingle sets

def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) slice by slice."""
    for lo, hi, buf, offs in T.slices(column):
        starts, ends, doc = T.words(buf, offs, T.NONSPACE)
        h = T.word_hashes(buf, starts, ends)
        sh, at = T.shingle_hashes(h, doc, k)
        rows = np.arange(hi - lo + 1)
        first, word = np.searchsorted(doc[at], rows), np.searchsorted(doc, rows)
        out = []
        for i in range(hi - lo):
            if first[i] < first[i + 1]:
                out.append(np.unique(sh[first[i]:first[i + 1]]))
            else:  # fewer than k words: all of them, or none
                a, b = int(word[i]), int(word[i + 1])
                out.append(T.shingle_hashes(h[a:b], doc[a:b], b - a)[0] if b > a else sh[:0])
        yield lo, out


def _class_id(u: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(T.mix(np.array([np.add.reduce(u) * T._BASE + np.uint64(len(u))], np.uint64)).view(np.int64)[0])


def _signature(u: np.ndarray) -> bytes:
    """Bitmap of the set; the next power of two of its size, 64 to 65536 bits."""
    bits = min(1 << 16, max(64, 1 << (len(u) - 1).bit_length()))
    on = np.zeros(bits, np.uint8)
    on[((u >> np.uint64(24)) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(on, bitorder="little").tobytes()


def _measure(k: int):
    """Rows (doc_id, text_key, n, cls, sig) of every document, then the task's shingle counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_key", "n", "cls", "sig", "slot", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for lo, sets in _sets(batch.column(2), k):
                if sets:
                    counts += np.bincount((np.concatenate(sets) & _MASK).astype(np.int64), minlength=SLOTS)
                m = len(sets)
                yield pa.record_batch([batch.column(0).slice(lo, m), batch.column(1).slice(lo, m), pa.array([len(u) for u in sets], pa.int32()),
                                       pa.array([_class_id(u) if len(u) else None for u in sets], pa.int64()),
                                       pa.array([_signature(u) if len(u) else None for u in sets], pa.binary()),
                                       pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        parts = [c.astype("<u4").tobytes() for c in np.split(counts, SLOT_ROWS)]
        yield pa.record_batch([*(pa.nulls(SLOT_ROWS, t) for t in kinds[:5]), pa.array(range(SLOT_ROWS), pa.int32()), pa.array(parts)], names=names)
    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(part, "<i8" if len(part) == 8 * SLOTS // SLOT_ROWS else "<u4").astype(np.int64)
            total[slot] = total[slot] + part if slot in total else part
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([c.astype("<i8").tobytes() for c in total.values()], pa.binary())],
                          names=["slot", "counts"])


def _rarity(measured: DataFrame) -> np.ndarray:
    """How often each slot was hit, cut to 15 bits; SLOT_ROWS rows reach the driver."""
    rows = (measured.filter("slot is not null").select("slot", "counts")
            .repartition(SLOT_ROWS, "slot").mapInArrow(_add_counts, "slot int, counts binary").collect())
    counts = np.zeros(SLOTS, np.int64)
    for slot, part in rows:
        counts[slot * SLOTS // SLOT_ROWS:(slot + 1) * SLOTS // SLOT_ROWS] = np.frombuffer(part, "<i8")
    # Above 2^15 hits a slot the scale gets coarser; the order stays one and the same for all documents.
    return (counts >> max(0, int(counts.max()).bit_length() - 15)).astype(np.uint16)


def _prefixes(k: int, percent: int, rarity):
    """Rows (token, n, cls, place) of the rarest shingles of every class; the token's order is the rarity order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = rarity.value.astype(np.uint64)
        seen: set[int] = set()
        for batch in batches:
            for _, sets in _sets(batch.column(0), k):
                tokens, classes = [], []
                for u in sets:
                    if not len(u) or (c := _class_id(u)) in seen:
                        continue
                    seen.add(c)
                    keys = (hits[(u & _MASK).astype(np.int64)] << np.uint64(48)) | (u >> np.uint64(16))
                    p = len(u) - -(-percent * len(u) // 100) + 1
                    tokens.append(np.sort(np.partition(keys, p - 1)[:p] if p < len(u) else keys))
                    classes.append((c, len(u)))
                if len(seen) > SEEN:
                    seen.clear()
                each = [len(t) for t in tokens]
                yield pa.record_batch([
                    pa.array(np.concatenate(tokens).view(np.int64) if tokens else [], pa.int64()),
                    pa.array(np.repeat(np.array([n for _, n in classes], np.int32), each)),
                    pa.array(np.repeat(np.array([c for c, _ in classes], np.int64), each)),
                    pa.array(np.concatenate([np.arange(e, dtype=np.int32) for e in each]) if each else [], pa.int32())],
                    names=["token", "n", "cls", "place"])
    return run


def _shared(percent: int):
    """Of rows sorted by token, n and cls, those whose token another class of fitting size has.

    With ``place`` shingles before the token, at most n - place are common if
    the token is the first common one, which bounds the partner's size.  A
    row's neighbours in size are enough to see whether it may have a partner,
    so two rows are carried from batch to batch.
    """
    def judged(r: np.ndarray) -> np.ndarray:
        """Which of the rows, but the first and the last, stay."""
        before, row, after = r[:-2], r[1:-1], r[2:]
        most = np.minimum((row[:, 1] - row[:, 3]) * (100 + percent) // percent - row[:, 1], row[:, 1] * 100 // percent)
        lower = (before[:, 0] == row[:, 0]) & (100 * before[:, 1] >= percent * row[:, 1])
        return lower | ((after[:, 0] == row[:, 0]) & (after[:, 1] <= most))

    def batch_of(r: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(r[:, 0]), pa.array(r[:, 1].astype(np.int32)), pa.array(r[:, 2]), pa.array(r[:, 3].astype(np.int32))],
                               names=["token", "n", "cls", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.full((1, 4), -1, np.int64)  # tokens are not negative
        held = none
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            rows = np.concatenate([held, rows])
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 2] != rows[:-1, 2])
            rows = rows[new]
            if len(rows) > 2:
                yield batch_of(rows[1:-1][judged(rows)])
            held = rows[-2:]
        rows = np.concatenate([held, none])
        if len(rows) > 2:
            yield batch_of(rows[1:-1][judged(rows)])
    return run


def _whole_sets(k: int, screen):
    """Rows (cls, n, shingles) of the documents whose class may be in a cluster."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(screen.value, np.uint8)
        mask, seen = len(bits) * 8 - 1, set()
        for batch in batches:
            for _, sets in _sets(batch.column(0), k):
                rows = []
                for u in sets:
                    if not len(u) or (c := _class_id(u)) in seen:
                        continue
                    if bits[(c & mask) >> 3] >> (c & 7) & 1:
                        seen.add(c)
                        rows.append((c, len(u), u.tobytes()))
                if len(seen) > SEEN:
                    seen.clear()
                cols = list(zip(*rows)) if rows else [[]] * 3
                yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())],
                                      names=["cls", "n", "shingles"])
    return run


def bit_table(ids: DataFrame, column: str, bits: int) -> bytes:
    """Fixed-size table of the low bits of a long column; at most bits / 32 rows reach the driver."""
    words = ids.select(F.expr(f"({column} & {bits - 1}) >> 5").alias("w"), F.expr(f"shiftleft(1L, cast({column} & 31 as int))").alias("b"))
    found = words.groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[found["w"].to_numpy()] = found["b"].to_numpy() & 0xFFFFFFFF
    return out.tobytes()


# -------------------------------------------------------------- signature trees

class Member:
    """A class: set size, the most shingles it can share here, bitmap, and its set where it is known."""

    __slots__ = ("id", "n", "most", "bits", "width", "root", "shingles")

    def __init__(self, id: int, n: int, signature: bytes, shingles: np.ndarray | None = None, place: int = 0) -> None:
        self.id, self.n, self.most, self.width, self.shingles = id, n, n - place, 8 * len(signature), shingles
        self.bits = int.from_bytes(signature, "little")
        self.root = self


def _find(m: Member) -> Member:
    while m.root is not m:
        m.root = m.root.root
        m = m.root
    return m


def _fold(bits: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


class Node:
    """Members (a leaf) or two nodes, with the OR of the bitmaps, size range and fewest bits of a member."""

    __slots__ = ("members", "kids", "bits", "width", "low", "high", "least")

    def __init__(self, members: list[Member]) -> None:
        self.members, self.kids = members, ()
        self.width = min(m.width for m in members)
        self.low, self.high = members[0].n, members[-1].n
        self.bits, self.least = 0, self.width
        if len(members) > LEAF:
            half = len(members) // 2
            self.kids = Node(members[:half]), Node(members[half:])
            for kid in self.kids:
                self.bits |= _fold(kid.bits, kid.width, self.width)
                self.least = min(self.least, kid.least if kid.width == self.width else 0)
        else:
            for m in members:
                folded = _fold(m.bits, m.width, self.width)
                self.bits |= folded
                self.least = min(self.least, folded.bit_count())


class Join:
    """Dual traversal over signature trees; ``links`` gets the pairs that ``same`` confirms and that join two groups."""

    def __init__(self, percent: int, same: Callable[[Member, Member, int], bool]) -> None:
        self.percent, self.same, self.links = percent, same, []

    def _need(self, total: int) -> int:
        return -(-self.percent * total // (100 + self.percent))

    def pair(self, a: Member, b: Member) -> None:
        p = self.percent
        if 100 * a.n < p * b.n or 100 * b.n < p * a.n:
            return
        ra, rb = _find(a), _find(b)
        if ra is rb:
            return
        need = self._need(a.n + b.n)
        if a.most < need or b.most < need:
            return
        width = min(a.width, b.width)
        x, y = _fold(a.bits, a.width, width), _fold(b.bits, b.width, width)
        both = (x & y).bit_count()
        if a.n - x.bit_count() + both < need or b.n - y.bit_count() + both < need:
            return
        if self.same(a, b, need):
            ra.root = rb
            self.links.append((a.id, b.id))

    def nodes(self, x: Node, y: Node) -> None:
        p = self.percent
        if 100 * x.high < p * y.low or 100 * y.high < p * x.low:
            return
        if x is not y and x.width == y.width:
            both, need = (x.bits & y.bits).bit_count(), self._need(x.low + y.low)
            if x.high - max(0, x.least - both) < need or y.high - max(0, y.least - both) < need:
                return
        if not x.kids and not y.kids:
            for i, a in enumerate(x.members):
                for b in (x.members[i + 1:] if x is y else y.members):
                    self.pair(a, b)
        elif x is y:
            left, right = x.kids
            self.nodes(left, left)
            self.nodes(left, right)
            self.nodes(right, right)
        elif x.kids and (not y.kids or len(x.members) >= len(y.members)):
            for kid in x.kids:
                self.nodes(kid, y)
        else:
            for kid in y.kids:
                self.nodes(x, kid)

    def within(self, members: list[Member]) -> None:
        if len(members) == 2:
            self.pair(*members)
        elif members:
            tree = Node(sorted(members, key=lambda m: (m.n, m.id)))
            self.nodes(tree, tree)

    def between(self, left: list[Member], right: list[Member]) -> None:
        if left and right:
            self.nodes(Node(sorted(left, key=lambda m: (m.n, m.id))), Node(sorted(right, key=lambda m: (m.n, m.id))))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows after the key columns) of rows sorted by their first ``keys`` columns, one group at a time."""
    current, rows = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols):
            if row[:keys] != current:
                if rows:
                    yield current, rows
                current, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield current, rows


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows) if rows else ((), ())
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _candidates(percent: int):
    """Edges that span what the signatures cannot tell apart, for each block pair of a shared shingle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int]] = set()
        for _, rows in _groups(batches, 3):
            join = Join(percent, lambda a, b, need: True)
            join.within([Member(c, n, s, place=p) for c, n, p, s in rows])
            out.update((min(e), max(e)) for e in join.links)
            if len(out) > 50_000:
                yield _edges(list(out))
                out.clear()
        yield _edges(list(out))
    return run


def _overlap(a: Member, b: Member, need: int) -> bool:
    return len(np.intersect1d(a.shingles, b.shingles, assume_unique=True)) >= need


def _member(cls: int, n: int, data: bytes) -> Member:
    u = np.frombuffer(data, np.uint64)
    return Member(cls, n, _signature(u), u)


def _verified(percent: int):
    """Exact links inside a block of a cluster, and each linked group's first class with its set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cluster, _), rows in _groups(batches, 2):
            members = list({c: _member(c, n, s) for c, n, s in rows}.values())
            join = Join(percent, _overlap)
            join.within(members)
            first: dict[int, Member] = {}
            for m in members:
                r = id(_find(m))
                if r not in first or m.id < first[r].id:
                    first[r] = m
            keep = list(first.values())
            e, k = len(join.links), len(keep)
            yield pa.record_batch([
                pa.concat_arrays([pa.array([a for a, _ in join.links], pa.int64()), pa.nulls(k, pa.int64())]),
                pa.concat_arrays([pa.array([b for _, b in join.links], pa.int64()), pa.nulls(k, pa.int64())]),
                pa.array([cluster] * (e + k), pa.int64()),
                pa.array([None] * e + [m.id for m in keep], pa.int64()), pa.array([None] * e + [m.n for m in keep], pa.int32()),
                pa.array([None] * e + [m.shingles.tobytes() for m in keep], pa.binary())],
                names=["a", "b", "cluster", "cls", "n", "shingles"])
    return run


def _across(percent: int):
    """Exact links between a chunk of classes outside their cluster's largest group and one of its blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 3):
            sides, first = ({}, {}), {}
            for side, c, n, s, component in rows:
                m = sides[side].setdefault(c, _member(c, n, s))
                m.root = first.setdefault(component, m)
            join = Join(percent, _overlap)
            join.between(list(sides[0].values()), list(sides[1].values()))
            yield _edges(join.links)
    return run


# --------------------------------------------------------------------- the join

def _blocked(rows: DataFrame, key: str, size: int, salt: int, name: str = "block", members: DataFrame | None = None) -> DataFrame:
    """Add the block of each row: hashed among as many blocks as ``key`` needs for its ``members`` (else its rows)."""
    blocks = (members or rows).groupBy(key).agg(F.ceil(F.count("*") / size).cast("int").alias("blocks")).filter("blocks > 1")
    return (rows.join(blocks, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            .withColumn(name, F.pmod(F.xxhash64("cls", F.lit(salt)), F.col("blocks")).cast("int")))


def _streamed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, component_id (smallest doc_id reachable by links, itself
    included), grp (equal for the documents of a component; null for empty sets)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_col()).alias("text_key"), text_col().alias("text"))
    measured = written(texts.mapInArrow(_measure(k), "doc_id long, text_key long, n int, cls long, sig binary, slot int, counts binary"), "sets")
    documents = measured.filter("slot is null").select("doc_id", "text_key", "n", "cls")
    rarity = spark.sparkContext.broadcast(_rarity(measured))

    tokens = texts.select("text").mapInArrow(_prefixes(k, percent, rarity), "token long, n int, cls long, place int")
    shared = written(tokens.repartition("token").sortWithinPartitions("token", "n", "cls")
                     .mapInArrow(_shared(percent), "token long, n int, cls long, place int"), "shared")

    signatures = measured.filter("cls is not null").groupBy("cls").agg(F.first("sig").alias("sig"))
    rows = _blocked(shared, "token", BLOCK, 1)
    # Block pairs (b, b) only where there is one block: each pair of two different blocks compares both whole.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("blocks = 1 or other <> block")
    rows = (rows.withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other"))
            .join(signatures, "cls").select("token", "b1", "b2", "cls", "n", "place", "sig"))
    edges = _streamed(rows, ["token", "b1", "b2"]).mapInArrow(_candidates(percent), "a long, b long")
    clusters = written(components(edges).select(F.col("node").alias("cls"), F.col("component").alias("cluster")), "clusters")

    screen = spark.sparkContext.broadcast(bit_table(clusters, "cls", FILTER_BITS))
    sets = written(texts.select("text").mapInArrow(_whole_sets(k, screen), "cls long, n int, shingles binary")
                   .join(clusters, "cls").select("cluster", "cls", "n", "shingles"), "cluster-sets")
    groups = _linked(sets, clusters, percent)

    # A component's id is its smallest doc_id; copies of one set are linked without an edge.
    ids = documents.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("m"))
    ids = ids.join(groups, "cls", "left").withColumn("grp", F.coalesce("grp", "cls"))
    smallest = ids.groupBy("grp").agg(F.min("m").alias("component_id"))
    of_class = ids.join(smallest, "grp").select("cls", "component_id", "grp")
    return (documents.join(of_class, "cls", "left")
            .select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"),
                    F.coalesce("component_id", "doc_id").alias("component_id"), "grp"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; documents without words all stay."""
    found = near_duplicates(docs, k, percent).filter("grp is not null")
    first = written(found.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_key")).alias("f"))
                    .select("f.doc_id", "f.text_key"), "first-of-group")
    keyed = docs.withColumn("__text_key", F.xxhash64(text_col()))
    some = text_col().rlike(r"[^\x20\x09-\x0D]")
    first = first.withColumnRenamed("text_key", "__text_key")
    kept = same(keyed.filter(some), first, ["doc_id", "__text_key"], "left_semi").dropDuplicates(["doc_id", "__text_key"])
    return kept.unionByName(keyed.filter(~some)).drop("__text_key")


def _groups_of(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("node").alias("cls"), F.col("component").alias("grp"))


def _linked(sets: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """(cls, grp) of the classes that the exact links of the clusters connect."""
    schema = "a long, b long, cluster long, cls long, n int, shingles binary"

    def verified(rows: DataFrame, members: DataFrame, salt: int) -> DataFrame:
        blocked = _blocked(rows, "cluster", CLUSTER_BLOCK, salt, members=members).select("cluster", "block", "cls", "n", "shingles")
        return written(_streamed(blocked, ["cluster", "block"]).mapInArrow(_verified(percent), schema), f"verified-{salt}")

    many = _blocked(clusters, "cluster", CLUSTER_BLOCK, 4).filter("blocks > 1")
    first = verified(sets, clusters, 2)
    found = first.filter("a is not null").select("a", "b")
    if not many.limit(1).count():
        return _groups_of(found)
    # Large clusters: one class of each group that a block has linked goes on, in new blocks.
    level = (first.filter("cls is not null").select("cluster", "cls", "n", "shingles")
             .join(many.select("cluster").distinct(), "cluster", "left_semi"))
    found = found.union(verified(level, level, 3).filter("a is not null").select("a", "b"))

    # Those that still hold several groups: all classes outside the largest group meet every block.
    groups = written(_groups_of(found), "groups")
    many = written(many.join(groups, "cls", "left").withColumn("grp", F.coalesce("grp", "cls")), "large-clusters")
    largest = (many.groupBy("cluster", "grp").agg(F.count("*").alias("c"))
               .groupBy("cluster").agg(F.max_by("grp", F.struct("c", "grp")).alias("top"), F.count("*").alias("groups")).filter("groups > 1"))
    rest = many.join(largest.select("cluster", "top"), "cluster")
    minor = _blocked(rest.filter("grp <> top").select("cluster", "cls"), "cluster", CLUSTER_BLOCK, 5, "chunk")
    chunks = minor.groupBy("cluster").agg(F.max("blocks").alias("chunks"))
    left = rest.join(minor.select("cls", "chunk"), "cls").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = rest.join(chunks, "cluster").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    units = (left.select("cluster", "block", "chunk", F.lit(0).alias("side"), "cls", "grp")
             .union(right.select("cluster", "block", "chunk", F.lit(1).alias("side"), "cls", "grp")))
    units = units.join(sets.select("cls", "n", "shingles").dropDuplicates(["cls"]), "cls")
    units = units.select("cluster", "block", "chunk", "side", "cls", "n", "shingles", "grp")
    more = _streamed(units, ["cluster", "block", "chunk"]).mapInArrow(_across(percent), "a long, b long")
    more = written(more, "across")
    return _groups_of(found.union(more)) if more.limit(1).count() else groups

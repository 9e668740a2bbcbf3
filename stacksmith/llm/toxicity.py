"""Toxicity from the nearest labelled examples by TF-IDF cosine.

Examples are a documented sample: at most EXAMPLES labelled training rows a
class, smallest id hash first, of which one a label stays of each group of near
copies (runs of RUN words, Jaccard similarity NEAR).  Their words tell which
terms, words or word beginnings of BEGINNINGS bytes (inflected forms share
them), go with the label beyond chance (chi-squared, corrected for the number of
terms tested, and at least LIFT-fold odds).  At most INDEXED examples a class,
smallest id hash first, are indexed; each class keeps its weight in all training
rows.  A vector holds every word of the indexed examples and every term that
goes with the label: (1 + log count) * idf, with document frequencies of all
documents, times ORDINARY for terms that do not go with the label; cosines are
exact.  Words in no indexed example are no part of a vector; a text with a term that
goes with the label has its number of words besides.

Examples with equal vectors are one entry.  A block-max inverted index over the
entries gives an upper bound for each block of BLOCK entries; blocks are scored
exactly in the order of their bounds until no bound reaches the neighbours
found, so the neighbours are exact.  Entries vote with weight 1 / (distance +
SOFT), ties of the last similarity included.  Leave-one-out votes of the
examples, made monotone, calibrate the score; a document without any term gets
the calibrated rate of the examples without one.

Scores use the text alone.  Null text: empty.  Labels other than 0 and 1, null
ids and labels of held-out ids are ignored; several labels of one id: the
largest; several texts of one id: one of them is the example, once.  Equal rows get equal scores.  Without examples every score is 0.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacksmith.llm import text as T
from stacksmith.llm.jaccard import near_duplicates
from stacksmith.llm.shared import hashed_sample, text_col, written

#: Labelled training rows of each class at most.
EXAMPLES = 10_000
BEGINNINGS = (4, 5, 6)
#: Examples of each class in the index at most.
INDEXED = 1000
#: The chance that any term goes with the label by accident, and how much it must change the label's odds.
ALPHA, LIFT = 0.01, 4.0
#: Weight of a term that does not go with the label, beside 1 of one that does.
ORDINARY = 0.05
NEIGHBOURS = 25
BLOCK = 128
#: Postings of a term in at least this share of the entries are kept as whole blocks.
DENSE = 1 / 8
#: Jaccard similarity of the runs of RUN words from which examples are near copies.
RUN, NEAR = 5, 0.8
SOFT = 0.05
FOLDS, HELD = 5, 0
MEMO = 100_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, word rows, term rows, term hashes, hashes of the terms' beginnings), slice by slice.

    Terms are words and their beginnings; the longest shorter beginning of a term is its parent, 0 without one.
    """
    for lo, hi, buf, offs in T.slices(column):
        starts, ends, doc = T.words(buf, offs, T.ALNUM)
        sums = T.byte_sums(buf)
        h = T.span_hashes(sums, starts, ends)
        parent, docs, terms, parents = np.zeros(len(h), np.uint64), [], [], []
        for n in BEGINNINGS:
            long = np.flatnonzero(ends - starts > n)
            beginning = T.mix(T.span_hashes(sums, starts[long], starts[long] + n) + np.uint64(n))
            docs.append(doc[long])
            terms.append(beginning)
            parents.append(parent[long])
            parent[long] = beginning
        yield lo, hi - lo, doc, *(np.concatenate(x) for x in ([doc, *docs], [h, *terms], [parent, *parents]))


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(h):
        return doc, h, doc
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]))
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, parent, t, n) of each term of examples (doc_id, toxic, text): toxic ones and all that hold it, slice by slice."""
    for batch in batches:
        toxic = batch.column(1).to_numpy()
        for lo, m, _, doc, term, parent in _terms(batch.column(2)):
            row, held, _ = _distinct(doc, term)
            h, number = np.unique(held, return_inverse=True)
            at = np.argsort(term, kind="stable")
            parent = parent[at[np.searchsorted(term[at], h)]] if len(h) else h
            n = np.bincount(number, minlength=len(h))
            t = np.bincount(number, toxic[lo:lo + m][row], minlength=len(h)).astype(np.int64)
            yield pa.record_batch([pa.array(x.view(np.int64)) for x in (h, parent, t, n)], names=["h", "parent", "t", "n"])


def _one_of_each(texts: DataFrame) -> DataFrame:
    """(doc_id) of one example, the smallest id, of each label in each group of near copies; copies are no evidence.

    ``texts`` has doc_id, toxic and text.  Groups come from the n-gram Jaccard join, so nothing that grows with the texts
    reaches the driver; examples without words all stay.
    """
    groups = near_duplicates(texts.select("doc_id", "text"), RUN, round(100 * NEAR)).select("doc_id", "grp")
    of_label = texts.select("doc_id", "toxic").join(groups, "doc_id")
    alone = F.when(F.col("grp").isNull(), F.col("doc_id"))
    return written(of_label.groupBy("toxic", "grp", alone.alias("alone")).agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "kept-examples")


def _outermost(terms: dict[int, tuple[int, float]]) -> list[int]:
    """Of terms (parent, chi-squared) along a chain of beginnings: a beginning that tells more than all terms under it
    stands for them, any other goes."""
    under: dict[int, list[int]] = {}
    for t, (parent, _) in terms.items():
        under.setdefault(parent if parent in terms else 0, []).append(t)

    def best(t: int) -> tuple[float, list[int]]:
        below = [best(c) for c in under.get(t, ())]
        own = terms[t][1]
        if not below:
            return own, [t]
        top = max(b for b, _ in below)
        return (own, [t]) if own > top else (top, [x for _, kept in below for x in kept])

    return [x for t in under.get(0, ()) for x in best(t)[1]]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h) of each word of the examples, once a batch; beginnings are none."""
    for batch in batches:
        for _, _, buf, offs in T.slices(batch.column(2)):
            starts, ends, _ = T.words(buf, offs, T.ALNUM)
            yield pa.record_batch([pa.array(np.unique(T.word_hashes(buf, starts, ends)).view(np.int64))], names=["h"])


class Vocabulary:
    """Numbers of terms by their hashes.

    Rows with any term that goes with the label get one term more, the last: all their words,
    counted in half powers of two, so that one hit in a long text is not one in a short text.
    """

    def __init__(self, hashes: np.ndarray, labelled: int) -> None:
        """hashes: in the order of their numbers, the ``labelled`` first ones go with the label."""
        self.number, self.labelled = np.argsort(hashes), labelled
        self.hashes = hashes[self.number]
        label = self.number < labelled
        self.known, self.known_label = (self.hashes, self.number), (self.hashes[label], self.number[label])

    def __len__(self) -> int:
        return len(self.hashes)

    def rows(self, n: int, words: np.ndarray, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, term, count): the terms of row i of n, ascending, are those from first[i] to first[i + 1]."""
        # Beginnings are terms only if they go with the label.
        keys = [np.empty(0, np.int64)]
        for (hashes, number), part in ((self.known, slice(len(words))), (self.known_label, slice(len(words), None))):
            if len(hashes) and len(h[part]):
                at = np.minimum(np.searchsorted(hashes, h[part]), len(hashes) - 1)
                hit = np.flatnonzero(hashes[at] == h[part])
                keys.append(doc[part][hit] * (len(self) + 1) + number[at[hit]])
        keys = np.sort(np.concatenate(keys))
        at = np.flatnonzero(np.diff(keys, prepend=-1))
        count = np.diff(np.append(at, len(keys)))
        doc, term = np.divmod(keys[at], len(self) + 1)
        some = np.unique(doc[term < self.labelled])
        if len(some):
            size = np.exp2(np.round(2 * np.log2(np.bincount(words, minlength=n)[some])) / 2).astype(np.int64)
            last = np.searchsorted(doc, some, "right")
            doc, term, count = (np.insert(a, last, b) for a, b in ((doc, some), (term, len(self)), (count, size)))
        return np.searchsorted(doc, np.arange(n + 1)), term, count


def _term_rows(vocabulary):
    """(doc_id, toxic, terms, counts) of every example."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, m, words, doc, h, _ in _terms(batch.column(2)):
                first, *columns = vocabulary.value.rows(m, words, doc, h)
                lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x.astype(np.int32))) for x in columns]
                yield pa.record_batch([batch.column(0).slice(lo, m), batch.column(1).slice(lo, m), *lists],
                                      names=["doc_id", "toxic", "terms", "counts"])
    return run


def _frequencies(vocabulary):
    """(term, n): documents of the partition that hold a term; under -1 all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, np.zeros(len(vocabulary.value) + 1, np.int64)
        for batch in batches:
            for _, m, words, doc, h, _ in _terms(batch.column(0)):
                total += m
                df += np.bincount(vocabulary.value.rows(m, words, doc, h)[1], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(some, -1)), pa.array(np.append(df[some], total))], names=["term", "n"])
    return run


class Index:
    """Block-max inverted index over weighted, unit-length example vectors."""

    def __init__(self, entries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, ids: list[list[int]], n_terms: int) -> None:
        """entries: (term ids, values); weights: rows (toxic weight, other weight, examples)."""
        self.weights, self.ids = weights, ids
        # Entries that share terms lie together, so that few blocks have high bounds.
        order = sorted(range(len(entries)), key=lambda i: (entries[i][0].astype(">i4").tobytes(), entries[i][1].tobytes()))
        self.order = np.array(order, np.int64)
        rank = np.empty(len(order), np.int64)
        rank[self.order] = np.arange(len(order))
        term = np.concatenate([t for t, _ in entries]).astype(np.int64)
        value = np.concatenate([v for _, v in entries])
        row = np.repeat(rank, [len(ts) for ts, _ in entries])
        by = np.lexsort((row, term))
        self.rows, self.values = row[by], value[by]
        self.n_blocks = -(-len(entries) // BLOCK)
        # Where the postings of a term in a block begin.
        self.starts = np.searchsorted(term[by] * self.n_blocks + self.rows // BLOCK, np.arange(n_terms * self.n_blocks + 1)).astype(np.int32)
        # Rounded up, so that a bound stays one.
        self.most = np.zeros((n_terms, self.n_blocks), np.float32)
        np.maximum.at(self.most, (term, row // BLOCK), np.nextafter(value.astype(np.float32), np.float32(2)))
        self.sizes = weights[self.order, 2]
        often = np.flatnonzero(np.bincount(term, minlength=n_terms) >= DENSE * len(entries))
        self.dense_row = np.full(n_terms, -1, np.int32)
        self.dense_row[often] = np.arange(len(often))
        dense = self.dense_row[term] >= 0
        self.dense = np.zeros((len(often), self.n_blocks, BLOCK))
        self.dense.reshape(len(often), self.n_blocks * BLOCK)[self.dense_row[term[dense]], row[dense]] = value[dense]

    def nearest(self, terms: np.ndarray, values: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(entries, similarities) of the nearest entries that hold k examples, with ties of the last; similarity above 0."""
        bounds = values @ self.most[terms]
        blocks = np.argsort(-bounds, kind="stable")
        blocks = blocks[bounds[blocks] > 0].tolist()
        found_e, found_s, enough, at, width = np.empty(0, np.int64), np.empty(0), 0.0, 0, 4
        dense = self.dense_row[terms]
        rare, often, rare_values, often_values = terms[dense < 0], dense[dense >= 0], values[dense < 0], values[dense >= 0]
        while at < len(blocks):
            # A few blocks, best bounds first, then all others; a bound that cannot reach the neighbours found ends the search.
            group = [b for b in blocks[at:at + width] if bounds[b] >= enough - 1e-12]
            if not group:
                break
            at, width = at + width, len(blocks)
            # All postings of the rarer terms in these blocks, as one array; then the whole blocks of the others.
            cells = (rare[:, None] * self.n_blocks + np.array(group)).ravel()
            first = self.starts[cells]
            size = self.starts[cells + 1] - first
            at_posting = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            sims = np.bincount(self.rows[at_posting], np.repeat(rare_values, size.reshape(len(rare), len(group)).sum(axis=1)) * self.values[at_posting],
                               minlength=self.n_blocks * BLOCK).astype(float, copy=False)
            if len(often):
                whole = self.dense[np.ix_(often, group)].reshape(len(often), -1)
                sims.reshape(self.n_blocks, BLOCK)[group] += (often_values @ whole).reshape(len(group), BLOCK)
            some = np.flatnonzero(sims > 0)
            found_e, found_s = np.concatenate([found_e, some]), np.concatenate([found_s, sims[some]])
            if len(found_s) > k + 1:
                # Each entry is an example at least, but for the one left out.
                near = np.flatnonzero(found_s >= np.partition(found_s, -k - 1)[-k - 1] - 1e-12)
                found_e, found_s = found_e[near], found_s[near]
            order = np.argsort(-found_s, kind="stable")
            size = self.sizes[found_e[order]].copy()
            if without >= 0:
                size[self.order[found_e[order]] == without] -= 1
            reached = np.searchsorted(np.cumsum(size), k)
            if reached < len(order):
                enough = found_s[order[reached]]
                order = order[found_s[order] >= enough - 1e-12]
            found_e, found_s = found_e[order], found_s[order]
        return self.order[found_e], found_s

    def vote(self, entries: np.ndarray, sims: np.ndarray, own: tuple[int, int, float] | None = None) -> float:
        """Distance-weighted share of toxic weight; ``own``: (entry, class column, weight) to leave out."""
        near = 1 / (np.maximum(0, 1 - sims) + SOFT)
        toxic, other = self.weights[entries, 0].copy(), self.weights[entries, 1].copy()
        if own is not None:
            (toxic, other)[own[1]][entries == own[0]] -= own[2]
        total = float(near @ (toxic + other))
        return float(near @ toxic) / total if total > 1e-12 else math.nan


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted non-decreasing fit of y on x (pooled adjacent violators)."""
    at, which = np.unique(x, return_inverse=True)
    blocks: list[list[float]] = []  # weighted sum, weight, first x, last x
    for x0, s0, w0 in zip(at, np.bincount(which, w * y), np.bincount(which, w)):
        blocks.append([s0, w0, x0, x0])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s1, w1, _, last = blocks.pop()
            blocks[-1][0] += s1
            blocks[-1][1] += w1
            blocks[-1][3] = last
    return np.array([v for b in blocks for v in b[2:]]), np.repeat([b[0] / b[1] for b in blocks], 2)


class Rows:
    """Examples as flat arrays; iterates (id, toxic, terms, counts)."""

    def __init__(self, ids: pa.Array, labels: pa.Array, terms: pa.Array, counts: pa.Array) -> None:
        self.ids, self.labels = ids.to_numpy(), labels.to_numpy()
        self.first = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.terms, self.counts = (x.flatten().to_numpy() for x in (terms, counts))

    def __len__(self) -> int:
        return len(self.ids)

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for i, (doc, toxic) in enumerate(zip(self.ids.tolist(), self.labels.tolist())):
            part = slice(self.first[i], self.first[i + 1])
            yield doc, toxic, self.terms[part], self.counts[part]


class Model:
    def __init__(self, idf: np.ndarray, rows: Rows, class_weight: tuple[float, float]) -> None:
        """class_weight: training rows behind one example, by class."""
        self.idf = idf
        self.empty = self.prior = 0.0
        self.index, self.knots = None, (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        if not len(rows):
            return
        at: dict[tuple, int] = {}
        entries, weights, ids, bare = [], [], [], [0.0, 0.0]
        own: list[tuple[int, int]] = []
        for doc, toxic, terms, counts in rows:
            if not len(terms):
                bare[toxic] += class_weight[toxic]
                continue
            values = np.round(self.vector(terms, counts), 12)
            e = at.setdefault(terms.tobytes() + values.tobytes(), len(at))
            if e == len(entries):
                entries.append((terms, values))
                weights.append([0.0, 0.0, 0.0])
                ids.append([])
            weights[e][1 - toxic] += class_weight[toxic]
            weights[e][2] += 1
            if len(ids[e]) < 3:
                ids[e].append(doc)
            own.append((e, toxic))
        total = [sum(w[0] for w in weights) + bare[1], sum(w[1] for w in weights) + bare[0]]
        self.prior = total[0] / sum(total)
        self.empty = (bare[1] + self.prior) / (sum(bare) + 1)
        if not entries:
            return
        self.index = Index(entries, np.array(weights), ids, len(self.idf))
        votes: dict[tuple[int, int], float] = {}
        for e, toxic in set(own):
            near, sims = self.index.nearest(*entries[e], without=e)
            votes[e, toxic] = self.index.vote(near, sims, (e, 1 - toxic, class_weight[toxic]))
        x = np.array([votes[o] for o in own])
        y = np.array([t for _, t in own], float)
        w = np.array([class_weight[t] for _, t in own])
        fine = ~np.isnan(x)
        if fine.any():
            kx, ky = monotone(x[fine], y[fine], w[fine])
            # A share of 0 or 1 is only as sure as the examples are many.
            self.knots = np.concatenate([[0.0], kx, [1.0]]), np.clip(np.concatenate([[ky[0]], ky, [ky[-1]]]), 1e-4, 1 - 1e-4)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.idf[terms]
        return v / np.linalg.norm(v)

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[tuple[int, float]]]:
        """Calibrated score in [0, 1] and (example id, similarity) of up to three neighbours."""
        if not len(terms) or self.index is None:
            return self.empty, []
        near, sims = self.index.nearest(terms, self.vector(terms, counts))
        raw = self.index.vote(near, sims)
        if math.isnan(raw):
            return self.prior, []
        # The raw vote breaks ties of the calibrated steps without crossing them.
        step = float(np.interp(raw, *self.knots))
        evidence = [(d, float(s)) for e, s in zip(near, sims) for d in self.index.ids[e]][:3]
        return min(1.0, max(0.0, step + 1e-6 * (raw - 0.5))), evidence


class Judge:
    """Scores of texts; equal vectors are scored once as long as they are remembered."""

    def __init__(self, model: Model, vocabulary: Vocabulary) -> None:
        self.model, self.vocabulary, self.memo = model, vocabulary, {}

    def __call__(self, column: pa.Array) -> Iterator[tuple[float, list[tuple[int, float]]]]:
        for _, m, words, doc, h, _ in _terms(column):
            first, terms, counts = self.vocabulary.rows(m, words, doc, h)
            for a, b in zip(first.tolist(), first[1:].tolist()):
                key = hashlib.blake2b(terms[a:b].tobytes() + counts[a:b].tobytes(), digest_size=16).digest()
                if key not in self.memo:
                    if len(self.memo) > MEMO:
                        self.memo.clear()
                    self.memo[key] = self.model.score(terms[a:b], counts[a:b])
                yield self.memo[key]


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*shared.value)
        for batch in batches:
            out = list(judge(batch.column("text")))
            near = pa.array([[{"doc_id": d, "similarity": s} for d, s in e] for _, e in out],
                            pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64())])))
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_key"), pa.array([s for s, _ in out], pa.float64()), near],
                                  names=["doc_id", "text_key", "score", "evidence"])
    return run


def _label_terms(examples: DataFrame) -> list[int]:
    """Hashes of the terms that go with the label among ``examples`` (doc_id, toxic, text), surest first."""
    words = written(examples.mapInArrow(_example_terms, "h long, parent long, t long, n long").groupBy("h")
                    .agg(F.first("parent").alias("parent"), F.sum("t").cast("double").alias("t"), F.sum("n").cast("double").alias("n")).filter("n >= 3"), "words")
    used = {r[0]: r[1] for r in examples.groupBy("toxic").count().collect()}
    n0, n1 = used.get(0, 0), used.get(1, 0)
    if not n0 or not n1:
        return []
    n = float(n0 + n1)
    chi = F.expr(f"{n} * pow(t * ({n0} - (n - t)) - (n - t) * ({n1} - t), 2) / ({float(n0)} * {n1} * n * ({n} - n))")
    tested = max(1, words.count())
    odds = F.expr(f"(t + 0.5) * ({n0} - (n - t) + 0.5) / ((n - t + 0.5) * ({n1} - t + 0.5))")
    # Words of at most 2 * EXAMPLES texts that pass a test for all of them.
    rows = (words.filter(F.col("n") < n).withColumn("chi", chi).filter(F.col("chi") > 2 * math.log(tested / ALPHA))
            .filter((odds >= LIFT) | (odds <= 1 / LIFT)).collect())
    terms = {r.h: (r.parent, r.chi) for r in rows}
    return sorted(_outermost(terms), key=lambda h: (-terms[h][1], h))


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, indexed: int = INDEXED) -> tuple[Model, Vocabulary, DataFrame]:
    """(model, its vocabulary, doc_id, text_key and text of all documents)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_col()).alias("text_key"), text_col().alias("text"))
    train = (labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("doc_id is not null and toxic in (0, 1)")
             .filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    size = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}

    def of_each_label(rows: DataFrame, n: int) -> DataFrame:
        return hashed_sample(rows.filter("toxic = 0"), n, "doc_id").union(hashed_sample(rows.filter("toxic = 1"), n, "doc_id"))

    picked = F.broadcast(written(of_each_label(train, examples), "examples"))  # 2 * ``examples`` rows at most
    # A labelled id is one example, however often it is repeated: its text with the smallest hash.
    texts_of = written(texts.join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", "text_key").alias("text")), "examples-texts")
    kept = F.broadcast(_one_of_each(texts_of))  # 2 * ``examples`` rows at most, as all of these
    label_terms = _label_terms(texts_of.select("doc_id", "toxic", "text").join(kept, "doc_id"))
    # Near copies are no evidence of a word's label, but neighbours like any other example.
    entries = written(texts_of.join(F.broadcast(of_each_label(texts_of.select("doc_id", "toxic"), indexed)), ["doc_id", "toxic"])
                      .select("doc_id", "toxic", "text"), "indexed-texts")  # 2 * ``indexed`` rows at most
    known = entries.mapInArrow(_words, "h long").distinct().toArrow().column("h").to_numpy()
    chosen = np.array(label_terms, np.int64)
    vocabulary = Vocabulary(np.concatenate([chosen, np.setdiff1d(known, chosen)]).view(np.uint64), len(chosen))
    shared = spark.sparkContext.broadcast(vocabulary)
    counts = texts.select("text").mapInArrow(_frequencies(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = (counts.column(c).to_numpy() for c in ("term", "n"))
    df, total = np.zeros(len(vocabulary) + 1), n[term < 0].sum()
    df[term[term >= 0]] = n[term >= 0]
    weight = np.log((1 + total) / (1 + df)) + 1
    weight[len(chosen):] *= ORDINARY
    weight[-1] = 1.0  # every text has words
    vectors = entries.mapInArrow(_term_rows(shared), "doc_id long, toxic int, terms array<int>, counts array<int>").toArrow().sort_by("doc_id")
    rows = Rows(*(vectors[c].combine_chunks() for c in vectors.column_names))
    behind = tuple(size.get(c, 0) / max(1, int((rows.labels == c).sum())) for c in (0, 1))
    return Model(weight, rows, behind), vocabulary, texts


def score_toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, indexed: int = INDEXED) -> DataFrame:
    """One row per document: doc_id, text_key, score in [0, 1], evidence (nearest examples with similarity)."""
    model, vocabulary, texts = fit(docs, labels, examples, indexed)
    return texts.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast((model, vocabulary))),
                            "doc_id long, text_key long, score double, evidence array<struct<doc_id:bigint,similarity:double>>")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; texts are judged where they are, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels)[:2])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array([score < threshold for score, _ in judge(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

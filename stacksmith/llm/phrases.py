"""Operator 13: phrase collocations, counted by multikey quicksort of suffix pointers.

Each depth d = 1..4 is one pass.  Texts are cut into pieces and words in the
tasks; every word position is a pointer to the suffix that starts there, seen to
d words.  A pointer goes on only if the first and the last d - 1 of its words
are frequent phrases (looked up in a bit table of fixed size; a false hit costs
time, never a result).  A task merges equal pointers with a weight, deals them
by their leading d words, and the receiving tasks sort them with a three-way
multikey quicksort: all open partitions of a route are split at once by their
pivots' current word, the equal part moves one word deeper, the weight of an
equal part at depth d is the phrase's count, and a part lighter than
``min_count`` is abandoned.  Routes see each phrase whole, so that loses nothing.

Merging before the shuffle makes a hot phrase one row a task and slice, and a
route holds only distinct pointers, so no key is hot.  The number of routes
grows with the number of words.  Cuts, containment and ranking are DataFrame
joins; the ranking takes its top rows per hash part first.

A word is known by a 64-bit hash of its language and bytes, joined back to its
text from the word counts.

Defined results: a null or empty text has no words; a null language is ``und``;
equal rows count as often as they occur; an empty table gives no phrases; only
the text and language columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stacksmith.llm import text as T
from stacksmith.llm.jaccard import bit_table
from stacksmith.llm.shared import written

#: Bytes that end a piece, and bytes that part words inside one.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"

MAX_WORDS = 4
#: Bits of the table of frequent phrases of one depth: 8 MB, whatever the data.
FILTER_BITS = 1 << 26
#: Pointers that a task merges at a time, and words per route (at least ROUTES routes).
MERGE = 1 << 20
ROUTE_WORDS, ROUTES = 1 << 20, 1024
SLICE = 4 << 20
SALTS = 64

_ENDS = np.isin(np.arange(256), np.frombuffer(PIECE_ENDS, np.uint8))
_WORD = ~(_ENDS | np.isin(np.arange(256), np.frombuffer(BLANKS, np.uint8)))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of phrases given as one array of word hashes a place; a single word stands for itself."""
    h = words[0]
    for w in words[1:]:
        h = T.mix(h * _STEP + w + np.uint64(1))
    return h


def _read(batches: Iterator[pa.RecordBatch]):
    """Per slice of (text, lang): (bytes, starts, ends, word hashes, piece numbers, rows, languages)."""
    for batch in batches:
        langs = batch.column(1).to_pylist()
        seed = {x: np.frombuffer(f"|{x}".encode(), np.uint8) for x in set(langs)}
        salt = {x: T.word_hashes(b, np.array([0]), np.array([len(b)]), lower=False)[0] for x, b in seed.items()}
        salts = np.array([salt[x] for x in langs], np.uint64)
        for lo, hi, buf, offs in T.slices(batch.column(0), SLICE):
            starts, ends, row = T.words(buf, offs, _WORD)
            if not len(starts):
                continue
            h = T.mix(T.word_hashes(buf, starts, ends) ^ salts[row + lo])
            pieces = np.cumsum(_ENDS[buf])[starts] + row  # rises with every piece end and every row
            yield buf, starts, ends, h, pieces, row + lo, langs


def _merged(h: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes, index of one pointer each, weights)."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    n = np.diff(np.append(first, len(s))) if weights is None else np.add.reduceat(weights[order], first)
    return s[first], order[first], n


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of a slice with their counts; a null word carries the number of words of a language."""
    for buf, starts, ends, h, _, row, langs in _read(batches):
        hashes, at, n = _merged(h)
        low = T.LOWER[buf].tobytes()
        words = [low[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        total: dict[str | None, int] = {}
        for r, c in zip(*(x.tolist() for x in np.unique(row, return_counts=True))):
            total[langs[r]] = total.get(langs[r], 0) + c
        yield pa.record_batch(
            [pa.concat_arrays([pa.array(hashes.view(np.int64)), pa.nulls(len(total), pa.int64())]),
             pa.array([langs[i] for i in row[at].tolist()] + list(total), pa.string()),
             pa.concat_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.nulls(len(total), pa.string())]),
             pa.array(np.append(n, list(total.values())).astype(np.int64))], names=["h", "lang", "word", "n"])


def _known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & np.uint64(len(bits) * 8 - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _pointers(depth: int, screen, shift: int):
    """Pointers seen to ``depth`` words, merged with weights and packed by route."""
    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        words = np.concatenate(parts)
        h, at, n = _merged(phrase_hash([words[:, j] for j in range(depth)]))
        words = np.ascontiguousarray(words[at])
        route = (h >> np.uint64(shift)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1]]))
        edges = np.append(first, len(h))

        def blocks(a: np.ndarray) -> pa.Array:
            width = a.nbytes // len(h)
            return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((edges * width).astype(np.int32)), pa.py_buffer(a)])

        return pa.record_batch([pa.array(route[first]), blocks(words), blocks(n.astype(np.int64))], names=["route", "words", "weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(screen.value, np.uint8)
        held, size = [], 0
        for _, _, _, h, pieces, _, _ in _read(batches):
            n = len(h) - depth + 1
            if n <= 0:
                continue
            known = _known(bits, phrase_hash([h[j:len(h) - depth + 2 + j] for j in range(depth - 1)]))
            at = np.flatnonzero(known[:-1] & known[1:] & (pieces[:n] == pieces[depth - 1:]))
            held.append(np.stack([h[at + j] for j in range(depth)], axis=1))
            size += len(at)
            if size >= MERGE:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)
    return run


def multikey_quicksort(words: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(a pointer, weight) of every partition of equal pointers that weighs ``least`` or more.

    ``words`` has a row per pointer and a column per place.  The open partitions
    lie one behind another; a step splits each at the current word of its middle
    pointer into less, equal and greater.  Equal parts go one place deeper and
    close at the last one; parts lighter than ``least`` are dropped.
    """
    at, place = np.arange(len(words)), np.zeros(1, np.int64)
    sizes = np.array([len(words)])
    done_at, done_weight = [], []
    while len(at):
        part = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.cumsum(sizes) - sizes
        word = words[at, place[part]]
        pivot = word[starts + sizes // 2][part]
        side = part * 3 + 1 + (word > pivot) - (word < pivot)
        n = np.bincount(side, minlength=3 * len(sizes))
        heavy = np.bincount(side, weights[at], 3 * len(sizes)) >= least  # doubles are exact below 2^53
        order = np.argsort(side, kind="stable")
        order = order[heavy[side[order]]]
        at = at[order]
        live = np.flatnonzero(heavy & (n > 0))
        deeper = place[live // 3] + (live % 3 == 1)
        sizes, closed = n[live], deeper == words.shape[1]
        if closed.any():
            first = np.cumsum(sizes) - sizes
            inside = np.repeat(closed, sizes)
            sums = np.add.reduceat(weights[at], first)
            done_at.append(at[first[closed]])
            done_weight.append(sums[closed])
            at = at[~inside]
        sizes, place = sizes[~closed], deeper[~closed]
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *done_at]), np.concatenate([empty, *done_weight])


def _sort_routes(depth: int, least: int):
    """Counts of frequent phrases from blocks sorted by route; whole routes are sorted together, about MERGE pointers at a time."""
    def counted(words: list[bytes], weights: list[bytes]) -> pa.RecordBatch:
        w = np.frombuffer(b"".join(words), np.uint64).reshape(-1, depth)
        at, f = multikey_quicksort(w, np.frombuffer(b"".join(weights), np.int64), least)
        cols = [w[at, j] for j in range(depth)]
        return pa.record_batch([pa.array(phrase_hash(cols).view(np.int64)), *[pa.array(c.view(np.int64)) for c in cols], pa.array(f)],
                               names=["h", *[f"h{j + 1}" for j in range(depth)], "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights, size, last = [], [], 0, None
        for batch in batches:
            for route, w, n in zip(*(c.to_pylist() for c in batch.columns)):
                if route != last and size >= MERGE:
                    yield counted(words, weights)
                    words, weights, size = [], [], 0
                words.append(w)
                weights.append(n)
                size += len(n) // 8
                last = route
        if size:
            yield counted(words, weights)
    return run


def frequent_phrases(docs: DataFrame, min_count: int, max_words: int, text: str = "text",
                     lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, n) word totals, (lang, phrase, size, f) of all phrases of 1 to ``max_words`` words that occur ``min_count`` times)."""
    spark = docs.sparkSession
    source = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    counted = source.mapInArrow(_count_words, "h long, lang string, word string, n long").groupBy("h", "lang", "word").agg(F.sum("n").alias("f"))
    counted = written(counted.filter(f"word is null or f >= {int(min_count)}"), "words")
    totals = counted.filter("word is null").select("lang", F.col("f").alias("n"))
    words = counted.filter("word is not null")
    everything = totals.agg(F.sum("n")).first()[0] or 0
    bits = max(ROUTES, everything // ROUTE_WORDS).bit_length()
    level, levels = words, [words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f")]
    for depth in range(2, max_words + 1):
        screen = spark.sparkContext.broadcast(bit_table(level, "h", FILTER_BITS))
        blocks = source.mapInArrow(_pointers(depth, screen, 64 - bits), "route long, words binary, weights binary")
        places = [f"h{j + 1}" for j in range(depth)]
        schema = "h long, " + "".join(f"{p} long, " for p in places) + "f long"
        level = written(blocks.repartition("route").sortWithinPartitions("route").mapInArrow(_sort_routes(depth, min_count), schema), f"phrases-{depth}")
        named = level
        for p in places:
            w = words.select(F.col("h").alias(p), F.col("word").alias(f"w_{p}"), *(["lang"] if p == "h1" else []))
            named = named.join(w, p)
        levels.append(named.select("lang", F.concat_ws(" ", *[f"w_{p}" for p in places]).alias("phrase"), F.lit(depth).alias("size"), "f"))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return totals, written(out, "phrases")


def mine_phrases(docs: DataFrame, min_count: int = 30, max_words: int = MAX_WORDS, top: int = 2000, scale: int = 2_000_000,
                 covered: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``max_words`` words with a >= ``min_count`` occurrences is
    scored at its weakest cut: floor(scale * a / (l + r)) for the counts of both
    parts, least over the cuts, the earliest of equal ones.  A phrase inside a
    longer one of at least ``covered`` percent of its count is dropped.
    """
    totals, phrases = frequent_phrases(docs, min_count, max_words, text, lang)
    counts = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("g"))
    long = phrases.filter("size > 1").withColumn("w", F.split("phrase", " "))
    part = lambda lo, n: F.array_join(F.slice("w", lo, n), " ")
    cuts = long.select("lang", "phrase", "size", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = cuts.join(counts.select("lang", F.col("part").alias("left"), F.col("g").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("part").alias("right"), F.col("g").alias("r")), ["lang", "right"])
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"({wide('a')} * {wide(int(scale))}) div ({wide('l')} + {wide('r')})")
    scored = cuts.groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # every shorter run of at least two words inside a phrase
    runs = "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(w, i, m), ' '))))"
    inner = long.filter("size > 2").select("lang", "f", F.explode(F.expr(runs)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(
        F.expr(f"cover is null or {wide('cover')} * 100 < {wide('a')} * {int(covered)}"))
    kept = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

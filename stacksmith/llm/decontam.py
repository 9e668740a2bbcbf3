"""Benchmark decontamination: prefix-filtered containment join of documents and benchmark windows.

A window occurs in a document only if all its shingles do (containment 1), so
one shingle a window, the rarest over all documents, is a sufficient prefix.
Documents are scanned once: words whose shingle may be in the benchmark (a bit
table of fixed size, no false negatives) leave a row with the words around
them.  Counting those rows gives the rarity order; joining them with each
window's prefix shingle gives candidates; the window's offset and length bound
where it can start; comparing the words decides.

Nulls, empty texts: no words, no hits.  Equal rows get equal results.  A
benchmark row without words or text is no item; an item with a null id hits
words but is not listed.  Other columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacksmith.llm import text as T
from stacksmith.llm.shared import row_key, same, text_col, written

WINDOW = 10
SHINGLE = 4
#: Bits of the table that screens document shingles: 2 MB whatever the benchmark's size.
FILTER_BITS = 1 << 24

_WINDOW_SCHEMA = "item_id long, win string, len int, off int, h long"
_SCAN_SCHEMA = "doc_id long, text_key long, n_words long, h long, pos long, lead int, ctx string"


def _words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Lower-cased words of a slice, each followed by one blank."""
    return b" ".join(T.LOWER[buf[a:b]].tobytes() for a, b in zip(starts, ends))


def _windows(window: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for lo, hi, buf, offs in T.slices(batch.column(1)):
                starts, ends, doc = T.words(buf, offs, T.ALNUM)
                hashes = T.word_hashes(buf, starts, ends)
                low = T.LOWER[buf].tobytes()
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                for d in range(hi - lo):
                    a, b = int(first[d]), int(first[d + 1])
                    size = min(window, b - a)
                    if not size:
                        continue
                    k = min(shingle, size)
                    text = [low[s:e].decode("utf-8", "replace") for s, e in zip(starts[a:b], ends[a:b])]
                    sh, _ = T.shingle_hashes(hashes[a:b], doc[a:b], k)
                    sh = sh.view(np.int64).tolist()
                    for i in range(b - a - size + 1):
                        win = " ".join(text[i:i + size])
                        rows += [(ids[lo + d], win, size, o, sh[i + o]) for o in range(size - k + 1)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64()))],
                                  names=["item_id", "win", "len", "off", "h"])
    return run


def _scan(window: int, sizes: list[int], screen):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(screen.value, np.uint8)
        mask = np.uint64(len(bits) * 8 - 1)
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for lo, hi, buf, offs in T.slices(batch.column(2)):
                starts, ends, doc = T.words(buf, offs, T.ALNUM)
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                hashes = T.word_hashes(buf, starts, ends)
                found_h, found_at = [], []
                for k in sizes:
                    sh, at = T.shingle_hashes(hashes, doc, k)
                    slot = sh & mask
                    hit = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
                    hit = np.flatnonzero(hit)
                    found_h.append(sh[hit])
                    found_at.append(at[hit])
                h, at = np.concatenate(found_h), np.concatenate(found_at)
                row = doc[at]
                left = np.maximum(at - window, first[row])
                right = np.minimum(at + window, first[row + 1])
                ctx = []
                if len(at):
                    low = T.LOWER[buf].tobytes()
                    ctx = [b" ".join(low[s:e] for s, e in zip(starts[a:b], ends[a:b])) for a, b in zip(left.tolist(), right.tolist())]
                n = hi - lo
                take = np.concatenate([np.arange(n), row]) + lo
                pad = lambda x, t: pa.concat_arrays([pa.nulls(n, t), pa.array(x, t)])
                yield pa.record_batch(
                    [ids.take(pa.array(take)), keys.take(pa.array(take)), pa.array(np.diff(first)[take - lo], pa.int64()),
                     pad(h.view(np.int64), pa.int64()), pad(at - first[row], pa.int64()), pad((at - left).astype(np.int32), pa.int32()),
                     pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(ctx, pa.binary()).cast(pa.string())])],
                    names=["doc_id", "text_key", "n_words", "h", "pos", "lead", "ctx"])
    return run


def _screen(windows: DataFrame) -> bytes:
    """Bit table of all benchmark shingles; at most FILTER_BITS / 32 rows reach the driver."""
    slot = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = windows.select(F.shiftright(slot, 5).alias("w"), F.expr(f"shiftleft(1L, cast((h & {FILTER_BITS - 1}) & 31 as int))").alias("b"))
    found = words.groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[found["w"].to_numpy()] = found["b"].to_numpy() & 0xFFFFFFFF
    return bits.tobytes()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, items (sorted ids as strings), spans of hit words.

    ``spans`` holds (start, end) word ranges of the occurring windows, sorted.
    """
    spark = docs.sparkSession
    windows = written(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
                      .mapInArrow(_windows(window, shingle), _WINDOW_SCHEMA), "bench-windows")
    sizes = sorted(min(shingle, r[0]) for r in windows.select(F.least(F.col("len"), F.lit(shingle))).distinct().collect()) or [shingle]
    screen = spark.sparkContext.broadcast(_screen(windows))
    scan = written(docs.select(*row_key(), text_col().alias("text"))
                   .mapInArrow(_scan(window, sorted(set(sizes)), screen), _SCAN_SCHEMA), "bench-scan")
    hits = scan.filter("h is not null")
    counts = hits.groupBy("h").agg(F.count("*").alias("n"))
    # Rarest shingle of each distinct window; one that no document has cannot occur.
    prefix = (windows.select("win", "len", "off", "h").distinct().join(counts, "h", "left")
              .groupBy("win", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "off")).alias("p"))
              .filter("p.n > 0").select("win", "len", "p.h", "p.off"))
    found = (hits.join(prefix, "h")
             .filter("pos >= off and pos - off + len <= n_words and lead >= off")
             .filter(F.expr("array_join(slice(split(ctx, ' '), lead - off + 1, len), ' ') = win"))
             .select("doc_id", "text_key", "win", (F.col("pos") - F.col("off")).alias("s"), (F.col("pos") - F.col("off") + F.col("len")).alias("e"))
             .distinct())
    found = written(found, "bench-found")
    spans = (found.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"))
             .withColumn("n_hit", F.expr(
                 "aggregate(spans, struct(0L as n, 0L as r), (a, x) -> struct(a.n + greatest(0L, x.e - greatest(x.s, a.r)) as n,"
                 " greatest(a.r, x.e) as r), a -> a.n)")))
    items = (found.select("doc_id", "text_key", "win").distinct()
             .join(windows.select("win", "item_id").distinct(), "win")
             .filter("item_id is not null")
             .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    out = same(scan.filter("h is null").select("doc_id", "text_key", "n_words"), spans, ["doc_id", "text_key"])
    out = same(out, items, ["doc_id", "text_key"])
    return out.select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      F.coalesce("spans", F.array().cast("array<struct<s:bigint,e:bigint>>")).alias("spans"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window."""
    hit = written(decontaminate(docs, benchmark).filter("n_hit > 0").select("doc_id", F.col("text_key").alias("__text_key")).distinct(), "contaminated")
    keyed = docs.withColumn("__text_key", F.xxhash64(text_col()))
    return same(keyed, hit, ["doc_id", "__text_key"], "left_anti").drop("__text_key")

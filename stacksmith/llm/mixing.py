"""Operator 12: mix sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source is a queue of its documents in a shuffled order (md5 of a seed and
the document), ``most`` times over.  A document's virtual finish time is the
number of words its source has served with it, divided by the source's target;
at virtual time 1 the total budget is spent.  Documents are range-sorted by
that time over all sources and the mix is cut where it ends.  What a source
cannot fill because its next document is too long is offered to the later,
shorter ones in the same way, in a few more rounds on the rest of each target.

Targets: ``share`` of all words is dealt by weight; no source gets more than
``most`` times its words, and what is left is dealt again among the others until
none is above.  Each repetition is one aggregate over the sources.

Equal rows (source, id and size) are one queue entry with a count, so copies
and hot ids cost one row, and running totals come from ranges of the sorted
order with one offset a range, so a hot source is split among tasks.

Defined results: a null or empty text has size 0 and is never taken; a null
source is a source of its own, the last; a null id is an id; equal rows share
what is taken of them as evenly as whole documents allow; an empty table gives
no rows; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacksmith.llm.shared import written

#: What counts as a word, and the weights of the sources in order.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)

SEED = "mix"
#: Rows of an entry that one task unfolds at a time.
UNFOLD = 1024


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def running_total(df: DataFrame, order: Sequence[Column], value: str, out: str) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` up to and with this row in ``order`` (a total order).

    The order is cut into ranges, written once; a range's offset is the sum of
    the ranges before it, one row a range.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("range_no").agg(F.sum(value).alias("range_sum")).select(
        F.col("range_no"), F.coalesce(F.sum("range_sum").over(before), F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn(out, F.sum(value).over(inside))
    return summed.join(offsets, "range_no").withColumn(out, F.col(out) + F.col("range_start")).drop("range_no", "range_start")


def source_targets(groups: DataFrame, weights: Sequence[float], share: float, most: int) -> tuple[DataFrame, float]:
    """((source, source_no, source_size, target) per source, total budget)."""
    sizes = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.lit(1).cast("long").alias("one"))
    ordered = running_total(sizes, [F.col("source").isNull(), F.col("source")], "one", "source_no").drop("one")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    sources = written(ordered.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double")), "sources")
    total, open_weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, capped = share * (total or 0), 0
    level = budget / open_weight if open_weight else 0.0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        n, spent, rest = sources.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not rest:
            break
        capped, level = n, (budget - spent) / rest
    full = F.col("cap") <= F.lit(level) * F.col("weight")
    return written(sources.select("source", "source_no", "source_size", F.when(full, F.col("cap")).otherwise(F.lit(level) * F.col("weight")).alias("target")),
                   "targets"), budget


def _serve(queue: DataFrame, wants: DataFrame) -> DataFrame:
    """``queue`` with copies (whole documents of the entry that the source's ``want`` words still cover) and their virtual finish time."""
    order = [F.col(c) for c in ("source_no", "lap", "key", "doc_id", "size")]
    fits = queue.join(wants, "source_no").filter(F.col("size") <= F.col("want")).withColumn("words", F.col("n") * F.col("size"))
    run = written(running_total(fits, order, "words", "served"), "served")
    starts = run.groupBy("source_no").agg(F.min(F.col("served") - F.col("words")).alias("first"))
    run = run.join(starts, "source_no").withColumn("before", F.col("served") - F.col("words") - F.col("first"))
    room = F.floor((F.col("want") - F.col("before")) / F.col("size"))
    run = run.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("n"), room)).cast("long"))
    return run.withColumn("finish", (F.col("before") + F.col("copies") * F.col("size")) / F.col("want"))


def fair_queue(groups: DataFrame, targets: DataFrame, budget: float, most: int, rounds: int, seed: str = SEED) -> DataFrame:
    """The mix in its order: source_no, doc_id, size, lap, copies, round, finish, start (words of the mix before the entry)."""
    shuffled = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    queue = groups.filter("size > 0").select(
        "source_no", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("lap"), shuffled.alias("key"), "doc_id", "size", "n")
    wants = targets.select("source_no", F.col("target").alias("want"))
    served = None
    for number in range(1, rounds + 1):
        turn = written(_serve(queue, wants).select(*queue.columns, "copies", "finish"), "turn")
        taken = turn.filter("copies > 0").withColumn("round", F.lit(number))
        served = taken if served is None else served.unionByName(taken)
        queue = turn.withColumn("n", F.col("n") - F.col("copies")).filter("n > 0").select(queue.columns)
        got = taken.groupBy("source_no").agg(F.sum(F.col("copies") * F.col("size")).alias("got"))
        wants = written(wants.join(got, "source_no", "left").select("source_no", (F.col("want") - F.coalesce("got", F.lit(0))).alias("want")), "wants")
    order = [F.col(c) for c in ("round", "finish", "source_no", "lap", "key", "doc_id", "size")]
    mix = running_total(served.withColumn("words", F.col("copies") * F.col("size")), order, "words", "stop")
    mix = mix.withColumn("start", F.col("stop") - F.col("words"))
    room = F.floor((F.lit(float(budget)) - F.col("start")) / F.col("size")).cast("long")
    return mix.withColumn("copies", F.least("copies", room)).filter("copies > 0").select(
        "source_no", "doc_id", "size", "lap", "copies", "round", "finish", "start")


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: int = 2, rounds: int = 3,
                doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted)."""
    sized = docs.select(F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), word_count(text).alias("size"))
    counted = written(sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    targets, budget = source_targets(counted, weights, share, most)
    named = counted.join(targets.select(F.col("source").alias("name"), "source_no"), F.col("source").eqNullSafe(F.col("name")))
    groups = written(named.select("source_no", "doc_id", "size", "n"), "groups")
    mix = fair_queue(groups, targets, budget, most, rounds)
    both = groups.withColumn("copies", F.lit(0).cast("long")).unionByName(
        mix.select("source_no", "doc_id", "size", F.lit(0).cast("long").alias("n"), "copies"))
    per_entry = written(both.groupBy("source_no", "doc_id", "size").agg(F.sum("n").alias("n"), F.sum("copies").alias("copies")), "entries")
    # equal rows: each takes copies div n, the first copies mod n one more
    cold = per_entry.filter(F.col("n") <= UNFOLD).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    hot = per_entry.filter(F.col("n") > UNFOLD).withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {UNFOLD})")))
    hot = hot.repartition("source_no", "doc_id", "size", "part").withColumn(
        "i", F.explode(F.expr(f"sequence(part * {UNFOLD} + 1, least(n, (part + 1) * {UNFOLD}))"))).drop("part")
    rows = cold.unionByName(hot).withColumn("taken", F.expr("size * (copies div n + if(i <= copies % n, 1, 0))"))
    return rows.join(targets, "source_no").select("doc_id", "source", "size", "source_size", "target", "taken")

"""Interval-overlap counts without a range join.

For row i with interval [s_i, e_i] (reversed intervals swapped first), the
number of reference intervals j overlapping it is

  closed:  #{s_j <= e_i} - #{e_j <  s_i}
  open:    #{s_j <  e_i} - #{e_j <= s_i}

because every interval ending before i starts also starts before i ends.
Both counts are running sums over the distinct endpoint values, computed
with the bucketed prefix sum; each row then needs two equi-joins on the
exact value.  Work is O(n log n) and no stage holds more than one bucket.

Open mode: a zero-length interval overlaps nothing -- it gets 0 and is not
counted for others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacksmith.operators.rank import cut, fixed_bucket, log_bucket, prefix_sum


def _normalised(df: DataFrame, start: str, end: str) -> DataFrame:
    return (df.withColumn("_s", F.least(F.col(start), F.col(end)))
              .withColumn("_e", F.greatest(F.col(start), F.col(end))))


#: An endpoint value of more rows than this is hot: its counts are copied SALTS times, so that several tasks meet its rows.
HOT_ROWS, SALTS = 1_000_000, 8


def _endpoint_table(pts: DataFrame, bucket_width: float | None) -> DataFrame:
    """Per distinct endpoint value v: starts_le(v), ends_le(v), starts_at(v), ends_at(v), rows; written once, used for both ends."""
    per_v = pts.groupBy("v").agg(F.sum("ns").cast("long").alias("ns"), F.sum("ne").cast("long").alias("ne"), F.count("*").alias("n_rows"))
    bucket = fixed_bucket("v", bucket_width) if bucket_width else log_bucket("v")
    return cut(prefix_sum(per_v, ["v"], ["ns", "ne"], bucket), "endpoints")


def _attach(rows: DataFrame, table: DataFrame, at: str, tag: str, hot: DataFrame | None) -> DataFrame:
    """Running counts at the exact value ``at`` (every probe value is in the table); only the values of ``hot`` are salted."""
    found = table.select(F.col("v").alias(at), "n_rows", F.col("ns_cum").alias(f"{tag}_ns_le"), F.col("ne_cum").alias(f"{tag}_ne_le"),
                         F.col("ns").alias(f"{tag}_ns_at"), F.col("ne").alias(f"{tag}_ne_at"))
    if hot is None:
        return rows.join(found.drop("n_rows"), at, "left")
    marked = rows.join(hot.select(F.col("v").alias(at), F.lit(True).alias("_hot")), at, "left")
    salted = marked.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    copies = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n_rows") > HOT_ROWS, SALTS - 1).otherwise(0))))
    return salted.join(copies.drop("n_rows"), [at, "_salt"], "left").drop("_salt", "_hot")


def _counts(rows: DataFrame, table: DataFrame, closed: bool) -> DataFrame:
    # Running counts at each row's own end and start (exact value joins).
    hot = table.filter(F.col("n_rows") > HOT_ROWS)
    hot = cut(hot.select("v"), "hot-endpoints") if hot.limit(1).count() else None
    r = _attach(_attach(rows, table, "_e", "se", hot), table, "_s", "ss", hot)
    if closed:
        # #{s_j <= e_i} - #{e_j < s_i}
        starts = F.col("se_ns_le")
        ends_before = F.col("ss_ne_le") - F.col("ss_ne_at")
    else:
        # #{s_j < e_i} - #{e_j <= s_i}
        starts = F.col("se_ns_le") - F.col("se_ns_at")
        ends_before = F.col("ss_ne_le")
    return r.withColumn("_cnt", starts - ends_before)


def _endpoints(rows: DataFrame, weight: int) -> DataFrame:
    """Both ends of every interval in one pass; weight 0 for values that are only looked up."""
    ends = F.array(F.struct(F.col("_s").alias("v"), F.lit(weight).alias("ns"), F.lit(0).alias("ne")),
                   F.struct(F.col("_e").alias("v"), F.lit(0).alias("ns"), F.lit(weight).alias("ne")))
    return rows.select(F.explode(ends).alias("p")).select("p.v", "p.ns", "p.ne")


def overlap_count(df: DataFrame, start: str, end: str, out: str = "n_overlap",
                  closed: bool = True, reference: DataFrame | None = None,
                  bucket_width: float | None = None) -> DataFrame:
    """Count, for each row of ``df``, the intervals overlapping it.

    ``reference=None``: against the other rows of ``df`` (self excluded, jn03).
    Otherwise: against the rows of ``reference`` (jn04); ``df``'s own rows do
    not count.  ``start``/``end`` name the columns in both frames.
    ``bucket_width`` (e.g. 86400 for epoch seconds) gives fixed-width
    running-sum buckets; otherwise log-scale buckets are used.  Neither needs
    a min/max pass.
    """
    # Written once: the endpoint pass and the final joins read this table, not the plan behind ``df``.
    rows = cut(_normalised(df, start, end), "intervals")
    self_mode = reference is None
    ref = rows if self_mode else _normalised(reference, start, end)
    if not closed:
        ref = ref.filter(F.col("_s") < F.col("_e"))
    pts = _endpoints(ref.select("_s", "_e"), 1)
    if not self_mode or not closed:
        # Probe values that are not endpoints of the reference set get a
        # zero-weight point so that the exact-value join always finds them.
        pts = pts.unionByName(_endpoints(rows.select("_s", "_e"), 0))
    table = _endpoint_table(pts, bucket_width)
    counted = _counts(rows, table, closed)
    cnt = F.col("_cnt")
    if self_mode:
        if closed:
            cnt = cnt - 1
        else:
            cnt = F.when(F.col("_s") < F.col("_e"), cnt - 1).otherwise(F.lit(0))
    elif not closed:
        cnt = F.when(F.col("_s") < F.col("_e"), cnt).otherwise(F.lit(0))
    return counted.select(*df.columns, cnt.cast("long").alias(out))

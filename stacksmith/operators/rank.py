"""Bucketed prefix sums and ranks.

A global running sum or rank written as ``Window.orderBy(v)`` moves every row
into one task.  Here the ordered domain is cut into buckets; bucket totals
(one row per bucket, so their count is fixed by the bucketing, not by the
data) give each bucket's offset, and the running sum inside a bucket is an
ordinary windowed sum partitioned by bucket.  Two shuffles of the data, no
single-task stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in names]


#: Buckets that share a bucket of the second level.
UPPER = 1024


def _bucket_offsets(totals: DataFrame, group_cols: Sequence[str], cols: Sequence[str], how) -> DataFrame:
    """For every bucket of ``totals`` (group, _bkt, _tot_<c>), ``_off_<c>`` over the buckets before it.

    Two levels: a window inside runs of buckets and one over the runs, so the
    bucket table may grow with the data and still meets no single task whole.
    ``how`` is the running aggregate (F.sum or F.max).
    """
    from pyspark.sql.types import StringType
    g = list(group_cols)
    text = isinstance(totals.schema["_bkt"].dataType, StringType)
    # Both are monotone in the bucket: a shorter prefix, or a wider range.
    upper = F.substring(F.col("_bkt"), 1, 2) if text else F.floor(F.col("_bkt") / UPPER)
    t = totals.withColumn("_up", upper)
    runs = t.groupBy(*g, "_up").agg(*[how(f"_tot_{c}").alias(f"_run_{c}") for c in cols])
    earlier = Window.partitionBy(*g).orderBy("_up").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*g, "_up", *[how(f"_run_{c}").over(earlier).alias(f"_upper_{c}") for c in cols])
    before = Window.partitionBy(*g, "_up").orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    inside = t.select(*g, "_up", "_bkt", *[how(f"_tot_{c}").over(before).alias(f"_lower_{c}") for c in cols])
    on = [F.col(f"i.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*g, "_up"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    both = inside.alias("i").join(runs.alias("r"), cond)
    merged = []
    for c in cols:
        lower, up = F.col(f"i._lower_{c}"), F.col(f"r._upper_{c}")
        merged.append((F.coalesce(lower, F.lit(0)) + F.coalesce(up, F.lit(0)) if how is F.sum else F.greatest(lower, up)).alias(f"_off_{c}"))
    return both.select(*[F.col(f"i.{c}").alias(c) for c in [*g, "_bkt"]], *merged)


def prefix_sum(df: DataFrame, order_cols: Sequence[str], sum_cols: Sequence[str],
               bucket: Column, group_cols: Sequence[str] = (),
               suffix: str = "_cum") -> DataFrame:
    """Add ``<c><suffix>`` = sum of ``c`` over rows of the same group whose
    ``order_cols`` tuple is <= this row's (inclusive running sum).

    ``bucket`` must be monotone in the order (a coarser key); rows are
    ordered by ``order_cols`` inside a bucket, so ``order_cols`` must be
    unique per group for a well-defined result (add a tie column).
    """
    group_cols = list(group_cols)
    b = df.withColumn("_bkt", bucket)
    # 1) running sum inside each bucket: the only shuffle of the full data
    within = Window.partitionBy(*group_cols, "_bkt").orderBy(*_cols(order_cols)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # written once: the result and both levels of the offsets read it, so the input is scanned and shuffled once
    w = cut(b.select("*", *[F.sum(c).over(within).alias(f"_in_{c}") for c in sum_cols]), "prefix")
    # 2) bucket totals, then offsets over the bucket table in two levels
    totals = w.groupBy(*group_cols, "_bkt").agg(*[F.sum(c).alias(f"_tot_{c}") for c in sum_cols])
    offsets = _bucket_offsets(totals, group_cols, sum_cols, F.sum)
    # 3) add the offsets back (the big side keeps its partitioning)
    out = w.join(offsets, [*group_cols, "_bkt"], "inner")
    return out.select(*df.columns,
                      *[(F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(f"{c}{suffix}") for c in sum_cols])


def hex_bucket(col: str, digits: int) -> Column:
    """Leading hex digits of an md5 string: monotone in its sort order."""
    return F.substring(F.col(col), 1, digits)


def unit_bucket(col: str, n: int = 4096) -> Column:
    """Bucket for values in [0, 1] (probabilities)."""
    return F.least(F.greatest(F.floor(F.col(col) * n), F.lit(0)), F.lit(n))


def rank_within(df: DataFrame, order_col: str, tie_col: str, group_cols: Sequence[str] = (),
                bucket: Column | None = None, hex_digits: int = 4,
                out: str = "rank") -> DataFrame:
    """1-based rank of each row inside ``group_cols`` by (order, tie).

    ``order_col`` defaults to being an md5 hex string, bucketed by its first
    ``hex_digits`` digits (16**digits buckets per group).
    """
    bkt = bucket if bucket is not None else hex_bucket(order_col, hex_digits)
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    ranked = prefix_sum(ones, [order_col, tie_col], ["_one"], bkt, group_cols)
    return ranked.withColumnRenamed("_one_cum", out).drop("_one")


def log_bucket(col: str, per_octave: int = 1024) -> Column:
    """Monotone bucket for any double without a min/max pass:
    sign(x) * (C + floor(per_octave * log2|x|)), 0 for x == 0.

    log is semi-monotonic in Java, so the bucket never decreases as x grows;
    each bucket spans a relative width of about 1/per_octave of an octave,
    whatever the data's range or tail.
    """
    x = F.col(col).cast("double")
    c = 1100 * per_octave                      # > per_octave * |log2(min subnormal)|
    top = 3 * c
    mag = F.floor(F.log2(F.abs(x)) * F.lit(float(per_octave))).cast("long") + F.lit(c)
    return (F.when(x == float("inf"), F.lit(top)).when(x == float("-inf"), F.lit(-top))
             .when(x > 0, mag).when(x < 0, -mag).otherwise(F.lit(0)).cast("long"))


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Table written to the shared ``spark.checkpoint.dir`` (survives executor
    loss) and read back with its statistics, so later passes still prune
    columns.  Used where one table feeds several passes."""
    from stacksmith.session import scratch_dir
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fixed_bucket(col: str, width: float) -> Column:
    """Fixed-width bucket (e.g. one day of epoch seconds): monotone, needs no
    min/max pass, and an integer domain bounds the rows per bucket."""
    return F.floor(F.col(col) / F.lit(width)).cast("long")


def min_max(df: DataFrame, col: str) -> tuple[float, float]:
    """Two scalars to the driver (size independent of the data)."""
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    return (r["lo"], r["hi"])


def rank_lookup(values: DataFrame, probes: DataFrame, col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """wn01: for each probe row, ``count_le`` = #values <= probe and
    ``count_lt`` = #values < probe (searchsorted right / left), per group.

    Probe values are unioned in with weight 0, the per-value table is
    aggregated (a hot value collapses to one row) and running-summed with
    buckets; each probe then joins on its exact value.
    """
    g = list(group_cols)
    pts = (values.select(*g, F.col(col).alias("v"), F.lit(1).alias("w"))
           .unionByName(probes.select(*g, F.col(col).alias("v"), F.lit(0).alias("w"))))
    per_v = pts.groupBy(*g, "v").agg(F.sum("w").cast("long").alias("w"))
    table = prefix_sum(per_v, ["v"], ["w"], log_bucket("v"), g)
    table = table.select(*g, F.col("v").alias(col), F.col("w_cum").alias("count_le"),
                         (F.col("w_cum") - F.col("w")).alias("count_lt"))
    return probes.join(table, [*g, col], "left")


def rank_by_value(df: DataFrame, order_col: str, tie_col: str, group_cols: Sequence[str] = (),
                  order_bucket: Column | None = None, tie_width: int = 1 << 16,
                  out: str = "rank") -> DataFrame:
    """1-based rank by (order, tie) that stays split when one order value is hot.

    rank = #{order < v} + rank of the tie key among rows with order == v.
    The first term comes from the (order value, count) table, where a hot
    value is a single row; the second is a running count per order value,
    bucketed on the (integer) tie key in fixed-width ranges, so even a value
    holding a third of all rows is spread over many window partitions.
    """
    g = list(group_cols)
    per_v = df.groupBy(*g, order_col).agg(F.count(F.lit(1)).cast("long").alias("_n"))
    ob = order_bucket if order_bucket is not None else unit_bucket(order_col)
    lt = prefix_sum(per_v, [order_col], ["_n"], ob, g).select(
        *g, order_col, (F.col("_n_cum") - F.col("_n")).alias("_lt"))
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    from pyspark.sql.types import StringType
    tie_bucket = (F.substring(F.col(tie_col), 1, 3) if isinstance(df.schema[tie_col].dataType, StringType)
                  else fixed_bucket(tie_col, tie_width))     # both monotone in the tie order
    within = prefix_sum(ones, [tie_col], ["_one"], tie_bucket, [*g, order_col])
    return (within.join(lt, [*g, order_col])
                  .withColumn(out, F.col("_lt") + F.col("_one_cum"))
                  .drop("_one", "_one_cum", "_lt"))


def prefix_max(df: DataFrame, order_cols: Sequence[str], col: str, bucket: Column,
               group_cols: Sequence[str] = (), out: str = "_pmax") -> DataFrame:
    """Running maximum of ``col`` in (group, order) order, bucketed like
    ``prefix_sum`` (NULLs ignored).  For a column that grows with the order
    this is an as-of lookup: the value of the last non-NULL row so far."""
    g = list(group_cols)
    b = df.withColumn("_bkt", bucket)
    within = Window.partitionBy(*g, "_bkt").orderBy(*_cols(order_cols)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    w = cut(b.withColumn("_in", F.max(col).over(within)), "prefix-max")
    totals = w.groupBy(*g, "_bkt").agg(F.max(col).alias("_tot_v"))
    offsets = _bucket_offsets(totals, g, ["v"], F.max)
    return (w.join(offsets, [*g, "_bkt"], "inner")
             .withColumn(out, F.greatest("_in", "_off_v")).drop("_bkt", "_in", "_off_v"))

"""Table profiling: counts, pivots, rates with standard errors, bins,
histograms, quantiles, describe, correlations (ag01-ag10, ag17, ag18)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacksmith.operators.rank import fixed_bucket, log_bucket, min_max, prefix_max, prefix_sum


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def pivot_count(df: DataFrame, key: str | Sequence[str], label: str, values=(0, 1)) -> DataFrame:
    """Category x label counts; explicit pivot values avoid a distinct job."""
    keys = [key] if isinstance(key, str) else list(key)
    out = df.groupBy(*keys).pivot(label, list(values)).agg(F.count(F.lit(1)))
    out = out.na.fill(0, [str(v) for v in values])
    return out.select(*keys, *[F.col(str(v)).cast("long").alias(f"n_{v}") for v in values])


def rate_table(df: DataFrame, key: str | Sequence[str], label: str, digits: int = 6) -> DataFrame:
    """Success rate and binomial SE sqrt(p(1-p)/n) per group (ag03)."""
    keys = [key] if isinstance(key, str) else list(key)
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                              F.sum(F.col(label).cast("long")).alias("n_pos"))
    p = F.col("n_pos") / F.col("n")
    return g.select(*keys, "n", "n_pos", F.round(p, digits).alias("rate"),
                    F.round(F.sqrt(p * (1 - p) / F.col("n")), digits).alias("se"))


def right_closed_unit_bin(x: str | Column, lo: int = 0, hi: int = 20) -> Column:
    """Bin of (a, a+1] for integer edges lo..hi; outside -> null (ag05)."""
    c = F.col(x) if isinstance(x, str) else x
    b = F.ceil(c).cast("int")
    return F.when((c > lo) & (c <= hi), b)


def equal_width_bin(x: str | Column, lo: float, hi: float, n: int) -> Column:
    """0-based bin of n equal-width bins over [lo, hi]; the last bin is closed."""
    c = F.col(x) if isinstance(x, str) else x
    if hi <= lo:
        return F.lit(0)
    return F.least(F.floor((c - F.lit(lo)) / F.lit(hi - lo) * F.lit(n)), F.lit(n - 1)).cast("int")


def histogram(df: DataFrame, x: str, n_bins: int, log1p: bool = False, digits: int = 6) -> DataFrame:
    """ag06: bin, edges and count.  min/max are two scalars from one agg job."""
    src = df.select(F.log1p(F.col(x)).alias("_x") if log1p else F.col(x).cast("double").alias("_x"))
    src = src.filter(F.col("_x").isNotNull())
    lo, hi = min_max(src, "_x")
    if lo is None:
        return src.select(F.lit(0).alias("bin"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"),
                          F.lit(0).cast("long").alias("n")).limit(0)
    w = (hi - lo) / n_bins if hi > lo else 0.0
    b = equal_width_bin("_x", lo, hi, n_bins)
    return (src.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
               .select("bin", F.round(F.lit(lo) + F.col("bin") * F.lit(w), digits).alias("lo"),
                       F.round(F.lit(lo) + (F.col("bin") + 1) * F.lit(w), digits).alias("hi"), "n"))


def exact_quantiles(df: DataFrame, x: str, group_cols: Sequence[str] = (),
                    probs: Sequence[float] | None = None, digits: int = 6) -> DataFrame:
    """Exact linear-interpolated quantiles (numpy 'linear' / SQL quantile_cont).

    Scales without gathering a group's values in one task: rows collapse to
    (group, value, count); a running count over log-scale buckets (no
    min/max pass, any range or tail) gives each distinct value its first
    rank; the values at the needed ranks floor/ceil((n-1)p) are found by a
    bucketed running max over the rank domain (values grow with rank), then
    interpolated.  No per-row lambdas, no one-task stage.
    Output: (*group_cols, q_idx, q, value).
    """
    g = list(group_cols)
    drop_g = not g
    if drop_g:   # one constant group: every step stays a keyed join / window
        df, g = df.withColumn("_g", F.lit(0)), ["_g"]
    probs = list(probs) if probs is not None else [i / 100 for i in range(1, 100)]
    xv = F.col(x).cast("double")
    vals = (df.select(*g, xv.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
              .groupBy(*g, "_x").agg(F.count(F.lit(1)).alias("_c")))
    cum = prefix_sum(vals, ["_x"], ["_c"], log_bucket("_x"), g)
    sizes = vals.groupBy(*g).agg(F.sum("_c").alias("_n"))
    # needed ranks: floor and ceil of (n-1)p for each probability (a few rows per group)
    targets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    t = sizes.select(*g, F.explode(targets).alias("_t")).select(
        *g, F.col("_t.i").alias("q_idx"), F.col("_t.p").alias("q"))
    t = t.join(sizes, g).withColumn("_pos", (F.col("_n") - 1).cast("double") * F.col("q"))
    probes = t.select(*g, "q_idx", "q", "_pos", F.explode(F.array(
        F.struct(F.lit(0).alias("hi"), F.floor("_pos").alias("r")),
        F.struct(F.lit(1).alias("hi"), F.ceil("_pos").alias("r")))).alias("_w")).select(
        *g, "q_idx", "q", "_pos", F.col("_w.hi").alias("_hi"), F.col("_w.r").cast("long").alias("_r"),
        F.lit(None).cast("double").alias("_x"), F.lit(1).alias("_kind"))
    # each distinct value sits at its first 0-based rank; values grow with rank,
    # so the value at rank r is the running max over rows at ranks <= r
    points = cum.select(*g, F.lit(None).cast("int").alias("q_idx"), F.lit(None).cast("double").alias("q"),
                        F.lit(None).cast("double").alias("_pos"), F.lit(None).cast("int").alias("_hi"),
                        (F.col("_c_cum") - F.col("_c")).cast("long").alias("_r"), "_x", F.lit(0).alias("_kind"))
    both = points.unionByName(probes)
    looked = prefix_max(both, ["_r", "_kind"], "_x", fixed_bucket("_r", 4096), g, out="_v")
    picked = looked.filter(F.col("_kind") == 1)
    agg = picked.groupBy(*g, "q_idx", "q").agg(
        F.first("_pos").alias("_pos"), F.max(F.when(F.col("_hi") == 0, F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("_hi") == 1, F.col("_v"))).alias("_hi"))
    lower, higher = F.floor("_pos"), F.ceil("_pos")
    val = F.when(lower == higher, F.col("_lo")).otherwise(
        (higher - F.col("_pos")) * F.col("_lo") + (F.col("_pos") - lower) * F.col("_hi"))
    out = agg.select(*g, "q_idx", F.round("q", 6).alias("q"), F.round(val, digits).alias("value"))
    return out.drop("_g") if drop_g else out


def quantile_pairs(df: DataFrame, x: str, by: str, probs: Sequence[float] | None = None,
                   digits: int = 6) -> DataFrame:
    """ag07: quantiles of ``x`` per group ``by`` in long form (QQ pairs are
    two groups at equal q)."""
    return exact_quantiles(df, x, [by], probs, digits).drop("q_idx")


def describe(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """ag08: count, mean, sample std, min, exact quartiles, max per column."""
    melted = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("m")
    ).select("m.column", "m.v")
    moments = melted.groupBy("column").agg(
        F.count("v").alias("count"), F.round(F.avg("v"), digits).alias("mean"),
        F.round(F.stddev_samp("v"), digits).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    qs = exact_quantiles(melted, "v", ["column"], [0.25, 0.5, 0.75], digits)
    wide = qs.groupBy("column").pivot("q_idx", [0, 1, 2]).agg(F.first("value"))
    wide = wide.select("column", F.col("0").alias("p25"), F.col("1").alias("p50"), F.col("2").alias("p75"))
    return moments.join(wide, "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def correlation_long(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """ag09: Pearson correlation for every ordered pair, one aggregation pass."""
    pairs = [(a, b) for a in cols for b in cols]
    aggs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                     F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), digits).alias("corr"))
            for a, b in pairs]
    return df.agg(F.array(*aggs).alias("_c")).select(F.explode("_c").alias("c")).select("c.*")


def strictly_positive_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """ag10: columns whose minimum is > 0 (one aggregation, k scalars back)."""
    if not cols:
        return []
    r = df.agg(*[F.min(F.col(c)).alias(c) for c in cols]).first()
    return [c for c in cols if r[c] is not None and r[c] > 0]


def token_vocabulary(df: DataFrame, text: str, sep: str = "-") -> DataFrame:
    """ag17: distinct tokens of a delimited string column."""
    return (df.select(F.explode(F.split(F.col(text), sep)).alias("token"))
              .filter(F.col("token") != "").distinct())


def class_balance(df: DataFrame, label: str, digits: int = 6) -> DataFrame:
    """ag13: per class count, share, balanced weight n/(k*count), and neg/pos.
    The window runs over the class table (one row per class)."""
    from pyspark.sql import Window
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    allw = Window.partitionBy()
    total = F.sum("n").over(allw)
    k = F.count(F.lit(1)).over(allw)
    neg = F.sum(F.when(F.col(label) == 0, F.col("n")).otherwise(0)).over(allw)
    pos = F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)).over(allw)
    return per.select(label, "n", F.round(F.col("n") / total, digits).alias("ratio"),
                      F.round(total / (k * F.col("n")), digits).alias("balanced_weight"),
                      F.round(neg / pos, digits).alias("neg_pos_ratio"))

"""Fit-on-train feature transforms (fe01-fe05, fe07-fe09, fe16, fe17, pf03).

Every transform is split into ``fit`` (aggregations on the training rows;
what comes back to the driver is a vocabulary or a handful of statistics,
bounded by the number of columns/categories, never by rows) and
``transform`` (pure column expressions, so the output schema is fixed by
the fit and any frame -- train, test, a stream -- can be transformed).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacksmith.functions import scalars as S
from stacksmith.operators.overlap import overlap_count
from stacksmith.operators.profile import exact_quantiles, strictly_positive_columns
from stacksmith.operators.rank import cut, rank_within

#: Columns that the wide one-hot form may make; ``IndexedOneHot`` has no limit.
WIDE_COLUMNS = 10_000


def align_columns(df: DataFrame, columns: Sequence[str], fill=0) -> DataFrame:
    """pf03: the fitted column list, in order; missing -> ``fill``, extra dropped."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in have else F.lit(fill).alias(c) for c in columns])


@dataclass
class OneHot:
    """fe01/fe02, wide form: one 0/1 column per training value; unseen/NULL ->
    all zeros.  Its vocabulary becomes columns, so it is refused above
    WIDE_COLUMNS; ``IndexedOneHot`` is the form for large vocabularies."""
    col: str
    prefix: str
    vocab: list[str] = field(default_factory=list)

    @classmethod
    def fit(cls, train: DataFrame, col: str, prefix: str = "f03") -> "OneHot":
        vals = (train.select(F.col(col).cast("string").alias("v")).filter(F.col("v").isNotNull())
                .distinct().limit(WIDE_COLUMNS + 1).collect())
        if len(vals) > WIDE_COLUMNS:
            raise ValueError(f"{col}: more than {WIDE_COLUMNS} categories; use IndexedOneHot")
        return cls(col, prefix, sorted(r["v"] for r in vals))

    @classmethod
    def fit_many(cls, train: DataFrame, specs: Sequence[tuple[str, Column, str]]) -> list["OneHot"]:
        """Fit several vocabularies in one job: (name, value, prefix) pairs are
        unioned and de-duplicated on the cluster; only the vocabularies return."""
        pairs = None
        for name, value, _ in specs:
            part = train.select(F.lit(name).alias("c"), value.cast("string").alias("v"))
            pairs = part if pairs is None else pairs.unionByName(part)
        rows = pairs.filter(F.col("v").isNotNull()).distinct().limit(WIDE_COLUMNS * len(specs) + 1).collect()
        out = []
        for name, _, prefix in specs:
            vocab = sorted(r["v"] for r in rows if r["c"] == name)
            if len(vocab) > WIDE_COLUMNS:
                raise ValueError(f"{name}: more than {WIDE_COLUMNS} categories; use IndexedOneHot")
            out.append(cls(name, prefix, vocab))
        return out

    def names(self) -> list[str]:
        return [f"{self.prefix}__{self.col}__{v}" for v in self.vocab]

    def columns(self, value: Column | None = None) -> list[Column]:
        x = (value if value is not None else F.col(self.col)).cast("string")
        return [F.when(x == F.lit(v), 1).otherwise(0).alias(n) for v, n in zip(self.vocab, self.names())]


class IndexedOneHot:
    """fe01/fe02 for any number of categories: the fitted vocabulary is a table
    (value, idx), and a row's one-hot vector is its index (long form; no row for
    unseen values or NULL).  Nothing reaches the driver."""

    def __init__(self, col: str, index: DataFrame) -> None:
        self.col, self.index = col, index

    @classmethod
    def fit(cls, train: DataFrame, col: str) -> "IndexedOneHot":
        values = train.select(F.col(col).cast("string").alias("value")).filter("value is not null").distinct()
        ranked = rank_within(values.withColumn("_md5", F.md5("value")), "_md5", "value", out="idx")
        return cls(col, cut(ranked.select("value", (F.col("idx") - 1).alias("idx")), "one-hot-index"))

    def transform(self, df: DataFrame, key: str) -> DataFrame:
        """(key, idx) of the rows whose value was seen."""
        return (df.select(key, F.col(self.col).cast("string").alias("value")).join(self.index, "value").select(key, "idx"))


def inverse_one_hot(dummy_cols: Sequence[str], values: Sequence[str]) -> Column:
    """fe03: the value of the first dummy equal to 1; NULL when none is."""
    arr = F.array(*[F.col(f"`{c}`").cast("int") for c in dummy_cols])
    names = F.array(*[F.lit(v) for v in values])
    pos = F.array_position(arr, 1)
    return F.when(pos > 0, F.element_at(names, pos.cast("int")))


def label_encoder(train: DataFrame, col: str, out: str):
    """fe04: sorted distinct training values -> 0..n-1; unseen -> n."""
    from pyspark.ml.feature import StringIndexer
    return StringIndexer(inputCol=col, outputCol=out, stringOrderType="alphabetAsc",
                         handleInvalid="keep").fit(train)


@dataclass
class Standardizer:
    """fe07: (x - mean) / population std, fitted on train; zero variance -> 0."""
    stats: dict[str, tuple[float, float]] = field(default_factory=dict)

    @classmethod
    def fit(cls, train: DataFrame, cols: Sequence[str]) -> "Standardizer":
        aggs = []
        for c in cols:
            aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{c}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}")]
        r = train.agg(*aggs).first()
        return cls({c: (r[f"m_{c}"], r[f"s_{c}"]) for c in cols})

    def column(self, c: str, out: str | None = None) -> Column:
        m, s = self.stats[c]
        x = F.col(c).cast("double")
        e = F.lit(0.0) if not s else (x - F.lit(m)) / F.lit(s)
        return e.alias(out or c)

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c not in self.stats]
        return df.select(*keep, *[self.column(c) for c in self.stats])


@dataclass
class GroupScaler:
    """fe08: named scaler per column group: 'standard', 'robust' (median/IQR,
    exact quantiles) or 'minmax'.  Zero spread -> 0."""
    params: dict[str, tuple[str, float, float]] = field(default_factory=dict)

    @classmethod
    def fit(cls, train: DataFrame, groups: dict[str, Sequence[str]]) -> "GroupScaler":
        params = {}
        std_cols = list(groups.get("standard", []))
        if std_cols:
            st = Standardizer.fit(train, std_cols)
            params.update({c: ("standard", m, s) for c, (m, s) in st.stats.items()})
        mm = list(groups.get("minmax", []))
        if mm:
            r = train.agg(*[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in mm],
                          *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in mm]).first()
            params.update({c: ("minmax", r[f"lo_{c}"], r[f"hi_{c}"] - r[f"lo_{c}"]) for c in mm})
        rb = list(groups.get("robust", []))
        if rb:
            melted = train.select(F.explode(F.array(*[
                F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in rb])).alias("m")
            ).select("m.column", "m.v")
            qs = {(r["column"], r["q_idx"]): r["value"]
                  for r in exact_quantiles(melted, "v", ["column"], [0.25, 0.5, 0.75], digits=12).collect()}
            params.update({c: ("robust", qs[(c, 1)], qs[(c, 2)] - qs[(c, 0)]) for c in rb})
        return cls(params)

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c not in self.params]
        cols = []
        for c, (_, center, spread) in self.params.items():
            x = F.col(c).cast("double")
            cols.append((F.lit(0.0) if not spread else (x - F.lit(center)) / F.lit(spread)).alias(c))
        return df.select(*keep, *cols)


@dataclass
class LogPositive:
    """fe09: log of the columns that are strictly positive on train (chosen at
    fit, not from the batch being transformed), except ``exclude``."""
    cols: list[str] = field(default_factory=list)

    @classmethod
    def fit(cls, train: DataFrame, candidates: Sequence[str], exclude: Sequence[str] = ()) -> "LogPositive":
        cands = [c for c in candidates if c not in set(exclude)]
        return cls(strictly_positive_columns(train, cands))

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c not in self.cols]
        return df.select(*keep, *[S.safe_ln(c).alias(c) for c in self.cols])


# ---------------------------------------------------------------- fe17

TIME_COLS = ["created_at", "launched_at", "deadline", "state_changed_at"]


def time_pairs(cols=TIME_COLS):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


@dataclass
class ProjectFeatures:
    """fe17: the full project feature build, fitted on the training rows.

    Order: concurrency -> currency -> datetime -> differences/products ->
    one-hot -> flag.  The fitted state is the training interval set (kept as
    a lazy DataFrame for test concurrency), vocabularies, and the rate map.
    """
    train_intervals: DataFrame
    rates: DataFrame
    year_quarter: OneHot
    country: OneHot
    currency: OneHot
    after_date: str = "1998-07-01"

    @classmethod
    def fit(cls, train: DataFrame, rates: DataFrame, after_date: str = "1998-07-01") -> "ProjectFeatures":
        yq, country, currency = OneHot.fit_many(train, [
            ("year_quarter", S.year_quarter(S.ntz_from_epoch("created_at")), "f04"),
            ("country", F.col("country"), "f03"), ("currency", F.col("currency"), "f03")])
        return cls(train.select("launched_at", "deadline"), rates, yq, country, currency, after_date)

    def feature_names(self) -> list[str]:
        diffs = [f"f02__diff__{a}__and__{b}" for a, b in time_pairs()]
        short = [d.replace("f02__diff__", "") for d in diffs] + ["datetime"]
        prods = [f"f02__product__{short[i]}_X_{short[j]}" for i in range(7) for j in range(i + 1, 7)]
        prods += [f"f02__product__goal_X_{s}" for s in short]
        return (["f07__concurrent_projects", "f01__goal", "f01__ADratio"] + diffs + prods
                + self.country.names() + self.currency.names()
                + ["f04__after_date", "f04__datetime"] + self.year_quarter.names()
                + ["f05__disable_communication"])

    def transform(self, df: DataFrame, is_train: bool | Column, keep: Sequence[str] = ()) -> DataFrame:
        """The features, and the columns ``keep`` of ``df``.  ``is_train``: bool for the whole frame, or a boolean column when train
        and test rows are transformed together (one concurrency pass: every
        row is counted against the training intervals; a training row's own
        interval is then taken off)."""
        own = F.lit(bool(is_train)) if isinstance(is_train, bool) else is_train
        base = overlap_count(df, "launched_at", "deadline", "_conc", reference=self.train_intervals,
                             bucket_width=86400)
        base = base.withColumn("f07__concurrent_projects",
                               F.col("_conc") - F.when(own, 1).otherwise(0).cast("long")).drop("_conc")
        base = (base.join(F.broadcast(self.rates), "currency", "left")
                    .withColumn("f01__goal", F.log1p(F.col("goal") * F.coalesce(F.col("usd_rate"), F.lit(1.0)))))
        launched = S.ntz_from_epoch("launched_at")
        diffs = [(F.col(a) - F.col(b)).alias(f"f02__diff__{a}__and__{b}") for a, b in time_pairs()]
        dbl = [(F.col(a) - F.col(b)).cast("double") for a, b in time_pairs()] + [F.col("launched_at").cast("double")]
        short = [f"{a}__and__{b}" for a, b in time_pairs()] + ["datetime"]
        prods = [(dbl[i] * dbl[j]).alias(f"f02__product__{short[i]}_X_{short[j]}")
                 for i in range(7) for j in range(i + 1, 7)]
        prods += [(F.col("goal").cast("double") * dbl[i]).alias(f"f02__product__goal_X_{short[i]}") for i in range(7)]
        return base.select(
            "row_id", "final_status", *keep,
            F.col("f07__concurrent_projects"), F.round("f01__goal", 6).alias("f01__goal"),
            S.ratio(F.col("launched_at") - F.col("created_at"), F.col("deadline") - F.col("created_at")).alias("f01__ADratio"),
            *diffs, *prods,
            *self.country.columns(), *self.currency.columns(),
            S.after_date(launched, self.after_date).alias("f04__after_date"),
            F.col("launched_at").alias("f04__datetime"),
            *self.year_quarter.columns(S.year_quarter(S.ntz_from_epoch("created_at"))),
            F.col("disable_communication").alias("f05__disable_communication"))


def standardised_arrays(fit: DataFrame, col: str, *frames: DataFrame) -> list[DataFrame]:
    """fe07 on array columns: each frame with ``col`` standardised by the means and population deviations of ``fit``.

    The statistics are one row a dimension; a dimension without variance is centred only.
    """
    stats = (fit.select(F.posexplode(col).alias("i", "x")).groupBy("i")
             .agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s")).orderBy("i").collect())
    table = F.array(*[F.struct(F.lit(r["m"]).alias("m"), F.lit(r["s"] or 1.0).alias("s")) for r in stats])
    scaled = F.zip_with(F.col(col), table, lambda x, t: (x.cast("double") - t["m"]) / t["s"])
    return [f.withColumn(col, scaled) for f in frames]

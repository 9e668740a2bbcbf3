"""Scalar column functions (sc01-sc18), all built-in JVM expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ntz_from_epoch(seconds: str | Column) -> Column:
    """Epoch seconds -> TIMESTAMP_NTZ, independent of the session time zone."""
    return F.timestamp_add("SECOND", _c(seconds), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def year_month(ts: str | Column) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


def year_quarter(ts: str | Column) -> Column:
    t = _c(ts)
    return F.concat(F.year(t).cast("string"), F.lit("Q"), F.quarter(t).cast("string"))


def after_date(ts: str | Column, date: str) -> Column:
    return (_c(ts) >= F.lit(date).cast("timestamp_ntz")).cast("int")


def safe_ln(x: str | Column) -> Column:
    """ln for x > 0, NULL otherwise (NumPy would give -inf / NaN)."""
    c = _c(x)
    return F.when(c > 0, F.log(c))


def safe_log10(x: str | Column) -> Column:
    c = _c(x)
    return F.when(c > 0, F.log10(c))


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; zero denominator -> NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def time_diffs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """sc03: a - b for every ordered pair (i < j) of time columns."""
    exprs = [(F.col(a) - F.col(b)).alias(f"f02__diff__{a}__and__{b}")
             for i, a in enumerate(cols) for b in cols[i + 1:]]
    return df.select("*", *exprs)


def pairwise_products(df: DataFrame, cols: Sequence[str], scale_col: str | None = None) -> DataFrame:
    """sc04: products of every pair of ``cols`` (in double: int64 would
    overflow) and of each with ``scale_col``."""
    short = [c.replace("f02__diff__", "") for c in cols]
    d = [F.col(c).cast("double") for c in cols]
    exprs = [(d[i] * d[j]).alias(f"f02__product__{short[i]}_X_{short[j]}")
             for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if scale_col:
        exprs += [(F.col(scale_col).cast("double") * d[i]).alias(f"f02__product__{scale_col}_X_{short[i]}")
                  for i in range(len(cols))]
    return df.select("*", *exprs)


def strip_quotes(x: str | Column) -> Column:
    """sc11: NULL -> 'nan' (as a stringified float would read), drop double quotes."""
    return F.regexp_replace(F.coalesce(_c(x), F.lit("nan")), '"', "")


def lenient_double(x: str | Column) -> Column:
    """sc13: numeric parse; unparsable -> NULL."""
    return _c(x).try_cast("double")


def min_max_scale(x: str | Column, lo: float, hi: float) -> Column:
    if hi is None or lo is None or hi == lo:
        return F.lit(0.0)
    return (_c(x) - F.lit(lo)) / F.lit(hi - lo)


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def binary_mask(i: str | Column, width: int) -> Column:
    """sc16: zero-padded binary string of an integer."""
    return F.lpad(F.bin(_c(i)), width, "0")


def columns_like(df: DataFrame, prefix: str | None = None, contains: str | None = None) -> list[str]:
    """pf01: schema-only column selection (no job)."""
    return [c for c in df.columns
            if (prefix is None or c.startswith(prefix)) and (contains is None or contains in c)]


def columns_of_type(df: DataFrame, kind: str) -> list[str]:
    """pf04: columns of a simple type ('double' excludes ints and booleans)."""
    kinds = {"double": (T.DoubleType, T.FloatType), "integer": (T.IntegerType, T.LongType, T.ShortType),
             "string": (T.StringType,), "boolean": (T.BooleanType,)}[kind]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]

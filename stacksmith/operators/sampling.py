"""Seeded folds, hold-outs and undersampling (wn02-wn05, fe10).

All are ranks of ``md5(seed:row_id)`` inside the class (or globally), taken
with the bucketed rank, so no stage gathers a whole class into one task and
the assignment is independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacksmith.functions.seeded import seeded_key
from stacksmith.operators.rank import rank_within


def _ranked(df: DataFrame, seed, key: str, group_cols, out: str = "_rk") -> DataFrame:
    keyed = df.withColumn("_sk", seeded_key(seed, key))
    return rank_within(keyed, "_sk", key, group_cols, out=out).drop("_sk")


def stratified_kfold(df: DataFrame, k: int = 5, seed=42, label: str = "label",
                     key: str = "row_id", out: str = "fold") -> DataFrame:
    """wn02: fold = (rank within class - 1) mod k; class sizes per fold differ by <= 1."""
    r = _ranked(df, seed, key, [label])
    return r.withColumn(out, ((F.col("_rk") - 1) % k).cast("int")).drop("_rk")


def kfold(df: DataFrame, k: int = 5, seed=42, key: str = "row_id", out: str = "fold") -> DataFrame:
    """wn03: unstratified: global seeded rank mod k."""
    r = _ranked(df, seed, key, [])
    return r.withColumn(out, ((F.col("_rk") - 1) % k).cast("int")).drop("_rk")


def _class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("_cn"))


def stratified_holdout(df: DataFrame, test_size: float = 0.2, seed=42, label: str = "label",
                       key: str = "row_id", out: str = "is_holdout") -> DataFrame:
    """wn04: per class, the first round(test_size * n_class) rows in seeded
    order are held out.  The class-size table has one row per class."""
    r = _ranked(df, seed, key, [label]).join(F.broadcast(_class_sizes(df, label)), label)
    cut = F.round(F.col("_cn") * F.lit(float(test_size)))
    return r.withColumn(out, F.col("_rk") <= cut).drop("_rk", "_cn")


def three_way_split(df: DataFrame, valid_size: float, test_size: float, seed=42, label: str = "label",
                    key: str = "row_id", out: str = "part") -> DataFrame:
    """wn04: train / valid / test by seeded rank within class."""
    r = _ranked(df, seed, key, [label]).join(F.broadcast(_class_sizes(df, label)), label)
    n_test = F.round(F.col("_cn") * F.lit(float(test_size)))
    n_valid = F.round(F.col("_cn") * F.lit(float(valid_size)))
    part = (F.when(F.col("_rk") <= n_test, "test")
             .when(F.col("_rk") <= n_test + n_valid, "valid").otherwise("train"))
    return r.withColumn(out, part).drop("_rk", "_cn")


def undersample(df: DataFrame, seed=42, label: str = "label", key: str = "row_id") -> DataFrame:
    """fe10: keep every row of the smallest class and as many rows of each
    other class, first in seeded order (without replacement)."""
    r = _ranked(df, seed, key, [label]).join(F.broadcast(_minority_cap(df, label)), label)
    return r.filter(F.col("_rk") <= F.col("_cap")).drop("_rk", "_cap")


def _minority_cap(df: DataFrame, label: str) -> DataFrame:
    """One row per class with the smallest class size as its cap."""
    from pyspark.sql import Window
    sizes = _class_sizes(df, label)
    return sizes.select(label, F.min("_cn").over(Window.partitionBy()).alias("_cap"))

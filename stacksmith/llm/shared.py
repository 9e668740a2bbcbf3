"""Helpers that several operators share: tables, written intermediates, row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stacksmith.session import scratch_dir
from stacksmith.sources.tables import load

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_col(name: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def row_key() -> list[Column]:
    """Key under which equal rows share one result: the id and a 64-bit hash of the text."""
    return [F.col("doc_id"), F.xxhash64(text_col()).alias("text_key")]


def same(left: DataFrame, right: DataFrame, cols: list[str], how: str = "left") -> DataFrame:
    """Null-safe equi-join on ``cols``; the right side's copies of them are dropped."""
    r = right
    for c in cols:
        r = r.withColumnRenamed(c, f"__r_{c}")
    on = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in cols]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    out = left.join(r, cond, how)
    return out.drop(*[f"__r_{c}" for c in cols])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load(spark, sf_dir, name)


def joined_sha256(items: Column) -> Column:
    """Lower-case hex SHA-256 of an array of strings joined by commas."""
    return F.sha2(F.concat_ws(",", items).cast("binary"), 256)


def hashed_sample(df: DataFrame, n: int, *cols: str) -> DataFrame:
    """At most ``n`` rows of ``df``, those with the smallest hashes of ``cols``; all rows if there are no more.

    The cut comes from counts of hash ranges (4096 at a time reach the driver),
    so no task or driver ever sorts or holds more than the sample.
    """
    h = F.shiftrightunsigned(F.xxhash64(*cols), 1)
    bound = 1 << 63
    while True:
        step = max(1, bound >> 12)
        part = df if bound == 1 << 63 else df.filter(h < bound)
        counts = dict(tuple(r) for r in part.groupBy(F.expr(f"shiftrightunsigned(xxhash64({', '.join(cols)}), 1) div {step}").alias("b")).count().collect())
        if sum(counts.values()) <= n:
            return part
        kept, total = 0, 0
        for b in range(4096):
            total += counts.get(b, 0)
            if total > n:
                break
            kept = b + 1
        if any(counts.get(b) for b in range(kept)) or step == 1:
            return df.filter(h < kept * step)
        bound = (kept + 1) * step

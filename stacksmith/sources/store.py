"""Sinks and scans on the shared folder (io01, io03-io13).

Everything is written below the session's ``spark.checkpoint.dir`` (see
``stacksmith.session.scratch_dir``): a cluster's shared folder, never a
machine-local path.  Written tables double as lineage cuts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacksmith.session import scratch_dir


def write_csv(df: DataFrame, path: str, header: bool = True) -> str:
    """io06/io07/io08: CSV sink (header optional)."""
    df.write.mode("overwrite").option("header", str(header).lower()).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True,
             nrows: int | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """io01/io03: CSV scan; explicit schema (no inference pass) when given.
    ``nrows`` keeps the first rows in ``order_by`` order (smoke runs); a cap
    without an order would keep arbitrary rows and is refused."""
    if nrows is not None and not order_by:
        raise ValueError("nrows needs order_by")
    r = spark.read.option("header", str(header).lower())
    r = r.schema(schema) if schema else r.option("inferSchema", "true")
    df = r.csv(path)
    if nrows is not None:
        df = df.orderBy(*order_by).limit(nrows)
    return df


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_json_lookup(spark: SparkSession, mapping: dict, path: str) -> str:
    """io05: a small lookup map as one multi-line JSON document."""
    text = json.dumps(mapping, indent=2, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def read_json_lookup(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """io05: multi-line JSON object -> (key, value) rows."""
    obj = spark.read.option("multiLine", "true").json(path)
    return obj.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in obj.columns]),
                                                  F.array(*[F.col(f"`{c}`").cast("double") for c in obj.columns])))
                      .alias(key, value))


class MetaStore:
    """io12/io13: long meta-feature store ``(row_id, split, model_id, proba)``
    partitioned by ``model_id``.  Writing a model replaces only its own
    partition (dynamic overwrite): new columns replace same-named old ones,
    other old ones stay."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, scores: DataFrame) -> None:
        (scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
               .partitionBy("model_id").parquet(self.path))

    def models(self) -> list[str]:
        """Stored models; an empty store only where the path does not exist, any other failure is raised."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        return [r[0] for r in self.spark.read.parquet(self.path).select("model_id").distinct().collect()]

    def read(self, model_ids: Sequence[str] | None = None) -> DataFrame:
        df = self.spark.read.parquet(self.path)
        return df.filter(F.col("model_id").isin(list(model_ids))) if model_ids else df

    def wide(self, model_ids: Sequence[str], suffix: str = "") -> DataFrame:
        long = self.read(model_ids)
        w = long.groupBy("row_id", "split").pivot("model_id", list(model_ids)).agg(F.first("proba"))
        return w.select("row_id", "split", *[F.col(m).alias(f"{m}{suffix}") for m in model_ids])

    def get_or_compute(self, model_id: str, compute: Callable[[], DataFrame]) -> DataFrame:
        """io13: reuse the stored partition when present, else compute and store it."""
        if model_id not in self.models():
            self.write(compute().withColumn("model_id", F.lit(model_id)))
        return self.read([model_id])


class RunLog:
    """io10/io11: run table ``(run_id, model_id, params map, metrics map)``,
    appended per run and partitioned by run; read back with the file path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, runs: DataFrame) -> None:
        runs.write.mode("append").partitionBy("run_id").json(self.path)

    def read(self) -> DataFrame:
        df = self.spark.read.json(self.path)
        return df.withColumn("source_file", F.col("_metadata.file_path"))


def memo_upsert_latest(memos: DataFrame, key: str, value: str, written_at: Sequence[str]) -> DataFrame:
    """io09: last write wins per key -- ``max_by`` on the write time (ties broken
    by the following columns), a single partial aggregation."""
    order = F.struct(*[F.col(c) for c in written_at])
    return memos.groupBy(key).agg(F.max_by(F.col(value), order).alias(value), F.max(order).alias("_w")) \
                .select(key, value, F.col(f"_w.{written_at[0]}").alias(written_at[0]))


def fresh_path(spark: SparkSession, name: str) -> str:
    return scratch_dir(spark, name)

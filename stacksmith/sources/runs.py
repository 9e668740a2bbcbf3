"""Run records and reuse of finished results (io10, io13).

A run is one nested row of ``RUN_SCHEMA``.  Records are keyed by ``run_id``:
writing a run again replaces its record, so a retried step logs nothing twice.
Results are kept below a fingerprint of the input rows and the parameters;
only a finished write counts, so a job that died half-way is computed anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = ("run_id string, model_id string, flags map<string,boolean>, params map<string,string>, metrics map<string,double>, "
              "importances array<struct<feature:string,importance:double>>, weights array<struct<member:string,weight:double>>")


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a finished write left a table at ``path``."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


class RunStore:
    """io10: nested run records, one partition a run."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def put(self, runs: DataFrame) -> None:
        """Adds the runs; a run that is there is replaced.  Columns that ``runs`` lacks are null; null ids are refused by the partition."""
        schema = self.spark.createDataFrame([], RUN_SCHEMA).schema
        have = set(runs.columns)
        rows = runs.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(self.path)

    def read(self) -> DataFrame:
        schema = self.spark.createDataFrame([], RUN_SCHEMA).schema
        return self.spark.read.schema(schema).parquet(self.path).select(*schema.names)

    def facts(self) -> DataFrame:
        """(run_id, section, name, value) of every flag, metric, importance and weight of every run."""
        def of(section: str, items: Column, name: str, value: str) -> Column:
            return F.transform(items, lambda x: F.struct(F.lit(section).alias("section"), x[name].alias("name"), x[value].cast("double").alias("value")))
        parts = [of("flag", F.map_entries("flags"), "key", "value"), of("metric", F.map_entries("metrics"), "key", "value"),
                 of("importance", F.col("importances"), "feature", "importance"), of("weight", F.col("weights"), "member", "weight")]
        empty = F.array().cast("array<struct<section:string,name:string,value:double>>")
        return self.read().select("run_id", F.explode(F.concat(*[F.coalesce(p, empty) for p in parts])).alias("f")).select("run_id", "f.*")


def fingerprint(inputs: DataFrame, params: dict) -> str:
    """Hex digest of the rows, whatever their order, the columns and the parameters; one aggregation of the input.

    The rows enter as their number and the exact sums of two 64-bit hashes, so repeated rows count.
    """
    cols = sorted(inputs.columns)
    # Spark's hash passes over nulls, so their places enter as well.
    nulls = F.concat_ws("", *[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in cols])
    hashes = [F.xxhash64(F.lit(salt), nulls, *[F.col(f"`{c}`") for c in cols]).cast("decimal(38,0)") for salt in ("a", "b")]
    total = inputs.agg(F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(f"h{i}") for i, h in enumerate(hashes)]).first()
    types = dict(inputs.dtypes)
    text = json.dumps([[str(x) for x in total], [[c, types[c]] for c in cols], params], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


class ResultStore:
    """io13: results by (name, fingerprint of inputs and parameters)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def get_or_compute(self, name: str, inputs: DataFrame, params: dict, compute: Callable[[DataFrame, dict], DataFrame]) -> DataFrame:
        """The stored result of the same name, rows and parameters, else ``compute(inputs, params)``, written first."""
        at = f"{self.path}/{name}/{fingerprint(inputs, params)}"
        if not finished(self.spark, at):
            compute(inputs, params).write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

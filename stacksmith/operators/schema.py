"""The columns of a fitted frame as a stored table (so05)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COLUMNS = "name string, nth int, position int, type string"


def columns_table(df: DataFrame) -> DataFrame:
    """(name, nth, position, type) of the columns; ``nth`` tells columns of one name apart."""
    seen: dict[str, int] = {}
    rows = []
    for i, f in enumerate(df.schema.fields):
        seen[f.name] = seen.get(f.name, 0) + 1
        rows.append((f.name, seen[f.name], i, f.dataType.simpleString()))
    return df.sparkSession.createDataFrame(rows, _COLUMNS)


class FittedSchema:
    """so05: written when a transform is fitted, compared with any later frame."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def fit(cls, df: DataFrame, path: str) -> "FittedSchema":
        columns_table(df).coalesce(1).write.mode("overwrite").parquet(path)
        return cls(df.sparkSession, path)

    def columns(self) -> DataFrame:
        return self.spark.read.schema(_COLUMNS).parquet(self.path)

    def differences(self, df: DataFrame) -> DataFrame:
        """(name, difference, fitted_type, found_type): columns that are missing from ``df``, extra in it or retyped.

        No row where the frames agree; the order of the columns does not matter.
        """
        own = self.columns().select("name", "nth", F.col("type").alias("fitted_type"))
        found = columns_table(df).select("name", "nth", F.col("type").alias("found_type"))
        kind = (F.when(F.col("found_type").isNull(), "missing").when(F.col("fitted_type").isNull(), "extra")
                .when(F.col("fitted_type") != F.col("found_type"), "retyped"))
        return (own.join(found, ["name", "nth"], "full").withColumn("difference", kind).filter("difference is not null")
                .select("name", "difference", "fitted_type", "found_type"))

    def check(self, df: DataFrame) -> None:
        """Raises with the differences, twenty at most, where there are any."""
        rows = self.differences(df).orderBy("difference", "name").limit(20).collect()
        if rows:
            raise ValueError("; ".join(f"{r['difference']}: {r['name']} ({r['fitted_type']} -> {r['found_type']})" for r in rows))

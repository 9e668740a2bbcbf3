"""One-hot features of any number of categories as one sparse vector (fe01, fe02, fe17).

A vocabulary stays a table (value, idx) and never becomes columns: rows meet it in a join, which the
planner broadcasts where its size allows, and ``OneHotEncoder`` and ``VectorAssembler`` make the vector.
"""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacksmith.operators.features import IndexedOneHot

_JSON = "struct<v:struct<type:int,size:int,indices:array<int>,values:array<double>>>"


class SparseFeatures:
    """Fitted on training rows: numeric columns first, then the dummies of each category column.

    Unseen and null categories give no dummy; null numbers give NaN.  A category
    column without any value in training takes no place in the vector.
    """

    def __init__(self, numeric: Sequence[str], categories: dict[str, Column], index: dict[str, IndexedOneHot], sizes: dict[str, int]) -> None:
        self.numeric, self.categories, self.index, self.sizes = list(numeric), categories, index, sizes

    @classmethod
    def fit(cls, train: DataFrame, numeric: Sequence[str], categories: dict[str, Column]) -> "SparseFeatures":
        """``categories``: name -> value; only the sizes of the vocabularies reach the driver."""
        index = {c: IndexedOneHot.fit(train.select(v.cast("string").alias(c)), c) for c, v in categories.items()}
        return cls(numeric, categories, index, {c: i.index.count() for c, i in index.items()})

    @property
    def size(self) -> int:
        return len(self.numeric) + sum(self.sizes.values())

    def names(self) -> DataFrame:
        """(position, name) of every entry of the vector."""
        spark = next(iter(self.index.values())).index.sparkSession if self.index else None
        out, at = None, len(self.numeric)
        if spark and self.numeric:
            out = spark.createDataFrame(list(enumerate(self.numeric)), "position long, name string")
        for c, one in self.index.items():
            part = one.index.select((F.col("idx") + at).cast("long").alias("position"), F.concat(F.lit(f"{c}__"), "value").alias("name"))
            out, at = part if out is None else out.unionByName(part), at + self.sizes[c]
        return out

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        """``df`` with the vector ``out``; helper columns have unused names."""
        tag = f"_{uuid4().hex[:8]}_"
        names = df.columns
        used = [c for c in self.categories if self.sizes[c]]
        rows = df.select("*", *[self.categories[c].cast("string").alias(f"{tag}v{i}") for i, c in enumerate(used)],
                         *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(f"{tag}n{i}") for i, c in enumerate(self.numeric)])
        for i, c in enumerate(used):
            own = self.index[c].index.select(F.col("value").alias(f"{tag}v{i}"), F.col("idx").cast("double").alias(f"{tag}i{i}"))
            n = self.sizes[c]
            # The place after the last is that of unseen values; it is dropped from the vector.
            encoder = OneHotEncoder(inputCol=f"{tag}i{i}", outputCol=f"{tag}o{i}", handleInvalid="keep", dropLast=True).fit(own)
            rows = rows.join(own, f"{tag}v{i}", "left").withColumn(f"{tag}i{i}", F.coalesce(F.col(f"{tag}i{i}"), F.lit(float(n))))
            rows = encoder.transform(rows)
        parts = [f"{tag}n{i}" for i in range(len(self.numeric))] + [f"{tag}o{i}" for i in range(len(used))]
        rows = VectorAssembler(inputCols=parts, outputCol=f"{tag}x", handleInvalid="keep").transform(rows)
        return rows.select(*[F.col(f"`{c}`") for c in names if c != out], F.col(f"{tag}x").alias(out))


def entries(col: str) -> Column:
    """(position, value) of the entries of a vector that are not 0, without making it dense."""
    v = F.from_json(F.to_json(F.struct(F.col(col).alias("v")), {"ignoreNullFields": "true"}), _JSON)["v"]
    at = F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1))
    pairs = F.zip_with(at, v["values"], lambda i, x: F.struct(i.alias("position"), x.alias("value")))
    return F.filter(pairs, lambda x: x["value"] != 0)

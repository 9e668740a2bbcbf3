"""Row-identity joins: positional merge, id attachment, prediction-file merge
(jn02, jn05-jn08)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LengthMismatch(ValueError):
    pass


def unmatched(left: DataFrame, right: DataFrame, key: str) -> list:
    """Up to five keys that are not once on each side, with both counts: one shuffle of keys."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return sides.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r")).filter("l <> 1 or r <> 1").limit(5).collect()


def merge_on_key(left: DataFrame, right: DataFrame, key: str = "row_id", check: bool = True) -> DataFrame:
    """jn02: 1:1 horizontal merge on the row key (never on position); raises
    when a key is missing or repeated on a side.  ``check=False`` is for sides
    that are known to match (one built from the other)."""
    if check and (bad := unmatched(left, right, key)):
        raise LengthMismatch(f"keys that are not once on each side: {[tuple(r) for r in bad]}")
    return left.join(right, key, "inner")


def attach_ids(pred: DataFrame, ids: DataFrame, key: str = "row_id", id_col: str = "id",
               label: str = "state") -> DataFrame:
    """jn07: submission rows (id, state); stops unless both sides hold the same keys."""
    if bad := unmatched(ids, pred, key):
        raise LengthMismatch(f"keys that are not once on each side: {[tuple(r) for r in bad]}")
    return ids.join(pred, key, "inner").select(F.col(id_col), F.col(label).cast("int").alias(label))


def merge_prediction_sets(long: DataFrame, key: str, run_col: str, value_col: str,
                          runs: Sequence[str], prefix: str = "") -> DataFrame:
    """jn08: union of runs in long form, pivoted to one column per run.
    Listing ``runs`` avoids the extra distinct job of an open pivot."""
    wide = long.groupBy(key).pivot(run_col, list(runs)).agg(F.first(value_col))
    return wide.select(key, *[F.col(r).alias(f"{prefix}{r}") for r in runs])


def anti_taken(candidates: DataFrame, taken: DataFrame, key: str = "row_id") -> DataFrame:
    """jn05: rows not yet taken."""
    return candidates.join(taken.select(key), key, "left_anti")


def semi_select(rows: DataFrame, chosen: DataFrame, key: str = "row_id") -> DataFrame:
    """jn06: rows whose key is in ``chosen`` (keeps the row's own columns)."""
    return rows.join(chosen.select(key).distinct(), key, "left_semi")

"""Pseudo-label selection (pl01, pl03, pl04, pl06): pure DataFrame steps.
The iterative loops (pl02, pl05) live in ``stacksmith.operators.stacking``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacksmith.operators.rank import rank_by_value


def one_shot(train: DataFrame, test_scores: DataFrame, lo: float = 0.08, hi: float = 0.80,
             label: str = "final_status", key: str = "row_id", proba: str = "p") -> DataFrame:
    """pl01: keep test rows with p < lo or p > hi, label p > 0.5, append to
    train (by name) with an ``origin`` column."""
    picked = (test_scores.filter((F.col(proba) < lo) | (F.col(proba) > hi))
              .select(key, (F.col(proba) > 0.5).cast("int").alias(label), F.lit("pseudo").alias("origin")))
    base = train.select(key, F.col(label).cast("int").alias(label), F.lit("train").alias("origin"))
    return base.unionByName(picked)


def select_step(scores: DataFrame, taken: DataFrame | None, pos_threshold: float, neg_threshold: float,
                ratio: float, key: str = "row_id", proba: str = "p",
                negatives_without_positives: str = "none") -> DataFrame:
    """pl03: one selection step.

    Positives: p > pos_threshold; negatives: p < neg_threshold, at most
    ``ratio`` x #positives, lowest p first (ties by key).  Rows already in
    ``taken`` are skipped.  With no positive, negatives are added only when
    ``negatives_without_positives == 'all'``.  The cap is a rank filter
    (a rank that splits tied values), never a one-task top-k: it grows with the data.
    """
    cand = scores if taken is None else scores.join(taken.select(key), key, "left_anti")
    pos = cand.filter(F.col(proba) > pos_threshold).select(key, proba, F.lit(1).alias("pseudo_label"))
    # #positives as a one-row table joined on a constant key: no driver
    # round trip, the whole step stays one lazy plan.
    n_pos = pos.agg(F.count(F.lit(1)).alias("_npos")).withColumn("_k", F.lit(1))
    neg = cand.filter(F.col(proba) < neg_threshold)
    # ranks by (p, key): tied probabilities (common with tree models) are
    # ranked by key inside their value, never gathered in one task
    ranked = rank_by_value(neg, proba, key, out="_rk")
    ranked = ranked.withColumn("_k", F.lit(1)).join(F.broadcast(n_pos), "_k")
    keep = (F.col("_npos") > 0) & (F.col("_rk") <= F.floor(F.lit(float(ratio)) * F.col("_npos")))
    if negatives_without_positives == "all":
        keep = keep | (F.col("_npos") == 0)
    neg = ranked.filter(keep).select(key, proba, F.lit(0).alias("pseudo_label"))
    return pos.unionByName(neg)


@dataclass
class StopState:
    best_f1: float = float("-inf")
    no_gain: int = 0
    empty_steps: int = 0


def should_stop(state: StopState, f1: float, n_added: int, patience: int = 1, max_empty: int = 2) -> bool:
    """pl04: stop after ``patience`` steps without F1 gain, or ``max_empty``
    consecutive steps that add no row.  Mutates ``state``."""
    if f1 > state.best_f1:
        state.best_f1, state.no_gain = f1, 0
    else:
        state.no_gain += 1
    state.empty_steps = state.empty_steps + 1 if n_added == 0 else 0
    return state.no_gain >= patience or state.empty_steps >= max_empty

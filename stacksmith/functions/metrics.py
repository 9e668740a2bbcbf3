"""Classification metrics as aggregate expressions (one pass, any grouping)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def predicted(proba: str | Column, threshold: float = 0.5, inclusive: bool = False) -> Column:
    """Label from a probability; ``inclusive`` picks ``>=`` over ``>`` (pf11)."""
    p = F.col(proba) if isinstance(proba, str) else proba
    return ((p >= threshold) if inclusive else (p > threshold)).cast("int")


def confusion_aggs(label: str | Column, pred: str | Column) -> list[Column]:
    y = F.col(label) if isinstance(label, str) else label
    yh = F.col(pred) if isinstance(pred, str) else pred
    return [
        F.sum(((y == 1) & (yh == 1)).cast("long")).alias("tp"),
        F.sum(((y == 0) & (yh == 1)).cast("long")).alias("fp"),
        F.sum(((y == 1) & (yh == 0)).cast("long")).alias("fn"),
        F.sum(((y == 0) & (yh == 0)).cast("long")).alias("tn"),
    ]


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def f1_from_counts(tp="tp", fp="fp", fn="fn") -> Column:
    tp, fp, fn = F.col(tp), F.col(fp), F.col(fn)
    return _safe_div(2 * tp, 2 * tp + fp + fn)


def with_metrics(df: DataFrame) -> DataFrame:
    """Precision, recall, F1, accuracy from tp/fp/fn/tn; 0 where undefined.

    Not rounded: ranks, maxima and weights are taken on these.  ``rounded``
    is for a plan's last projection.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (df.withColumn("precision", _safe_div(tp, tp + fp))
              .withColumn("recall", _safe_div(tp, tp + fn))
              .withColumn("f1", f1_from_counts())
              .withColumn("accuracy", _safe_div(tp + tn, tp + fp + fn + tn)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded: the last step of a plan."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def binary_report(df: DataFrame, label: str, proba: str, group_cols=(), threshold: float = 0.5,
                  inclusive: bool = False) -> DataFrame:
    """ag11: confusion counts and metrics per group in one aggregation."""
    g = df.groupBy(*group_cols) if group_cols else df.groupBy()
    return with_metrics(g.agg(*confusion_aggs(label, predicted(proba, threshold, inclusive))))


def f1_sql(tp="tp", fp="fp", fn="fn") -> str:
    return f"CASE WHEN 2*{tp}+{fp}+{fn} = 0 THEN 0.0 ELSE 2.0*{tp} / (2*{tp}+{fp}+{fn}) END"


def confusion_sql(label: str, pred: str) -> str:
    return (f"CAST(sum(CASE WHEN {label}=1 AND {pred}=1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, "
            f"CAST(sum(CASE WHEN {label}=0 AND {pred}=1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
            f"CAST(sum(CASE WHEN {label}=1 AND {pred}=0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
            f"CAST(sum(CASE WHEN {label}=0 AND {pred}=0 THEN 1 ELSE 0 END) AS BIGINT) AS tn")


def metrics_sql(digits: int = 6) -> str:
    return (f"round(CASE WHEN tp+fp=0 THEN 0.0 ELSE tp*1.0/(tp+fp) END, {digits}) AS precision, "
            f"round(CASE WHEN tp+fn=0 THEN 0.0 ELSE tp*1.0/(tp+fn) END, {digits}) AS recall, "
            f"round({f1_sql()}, {digits}) AS f1, "
            f"round(CASE WHEN tp+fp+fn+tn=0 THEN 0.0 ELSE (tp+tn)*1.0/(tp+fp+fn+tn) END, {digits}) AS accuracy")

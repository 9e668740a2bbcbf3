"""Pseudo-label queries (pl01, pl03, pl06, pl07, wn06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stacksmith.functions.metrics import binary_report, confusion_sql, metrics_sql, rounded
from stacksmith.operators import scores as SC
from stacksmith.operators import selftrain as ST
from stacksmith.operators.rank import cut
from stacksmith.plans.inputs import projects, scores, with_ctes
from stacksmith.plans.registry import query

LO, HI = 0.30, 0.70
ROW_MEAN_SQL = "(SELECT row_id, final_status, avg(proba) AS p FROM scores WHERE split = 'test' GROUP BY 1, 2)"


def row_mean(spark, sf):
    s = scores(spark, sf).filter(F.col("split") == "test")
    return SC.mean_score(s, ["row_id", "final_status"])


def _train(spark, sf):
    return projects(spark, sf).filter(F.col("split") == "train").select("row_id", "final_status")


PL01_SQL = f"""(SELECT row_id, final_status, 'train' AS origin FROM projects WHERE split = 'train'
UNION ALL SELECT row_id, CAST(p > 0.5 AS INTEGER), 'pseudo' FROM {ROW_MEAN_SQL} m WHERE p < 0.30 OR p > 0.70)"""


@query("pl01_one_shot_pseudo_labels", with_ctes(f"SELECT * FROM {PL01_SQL} u", "scores"))
def pl01(spark, sf):
    return ST.one_shot(_train(spark, sf), row_mean(spark, sf).select("row_id", "p"), LO, HI)


@query("pl06_pseudo_label_audit", with_ctes(f"""
SELECT tp, fp, fn, tn, {metrics_sql()} FROM (
  SELECT {confusion_sql('m.final_status', 'CAST(m.p > 0.5 AS INTEGER)')} FROM {ROW_MEAN_SQL} m
  WHERE m.p < 0.30 OR m.p > 0.70) c""", "scores"))
def pl06(spark, sf):
    picked = ST.one_shot(_train(spark, sf), row_mean(spark, sf).select("row_id", "p"), LO, HI).filter(F.col("origin") == "pseudo")
    truth = projects(spark, sf).select("row_id", F.col("final_status").alias("truth"))
    j = picked.join(truth, "row_id")
    return rounded(binary_report(j, "truth", "final_status", threshold=0.5))


POS_T, NEG_T, RATIO, TAKEN_T = 0.7 * 1.01, 0.3, 4, 0.74


@query("pl03_selection_step", with_ctes(f"""
, cand AS (SELECT row_id, p FROM {ROW_MEAN_SQL} m WHERE p <= {TAKEN_T}),
 pos AS (SELECT row_id, p FROM cand WHERE p > {POS_T}),
 neg AS (SELECT row_id, p, row_number() OVER (ORDER BY p, row_id) AS rk FROM cand WHERE p < {NEG_T})
SELECT row_id, p, 1 AS pseudo_label FROM pos
UNION ALL
SELECT row_id, p, 0 FROM neg WHERE rk <= {RATIO} * (SELECT count(*) FROM pos)""", "scores").replace(")\n, cand", "),\n cand"))
def pl03(spark, sf):
    # the per-row mean feeds three branches (taken, positives, negatives):
    # written once to the shared folder
    m = cut(row_mean(spark, sf).select("row_id", "p"))
    taken = m.filter(F.col("p") > TAKEN_T).select("row_id")
    out = ST.select_step(m, taken, POS_T, NEG_T, RATIO)
    return out.select("row_id", "p", F.col("pseudo_label").cast("int").alias("pseudo_label"))


@query("wn06_capped_lowest_negatives", with_ctes(f"""
SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY p, row_id) AS rk FROM {ROW_MEAN_SQL} m WHERE p < 0.35) r
WHERE rk <= 2 * (SELECT count(*) FROM {ROW_MEAN_SQL} m2 WHERE p > 0.68)""", "scores"))
def wn06(spark, sf):
    m = cut(row_mean(spark, sf).select("row_id", "p"))
    out = ST.select_step(m, None, 0.68, 0.35, 2)
    return out.filter(F.col("pseudo_label") == 0).select("row_id")


@query("pl07_before_after", with_ctes(f"""
SELECT which, precision, recall, f1, auc FROM (
  SELECT which, {confusion_sql('y', 'CAST(p > 0.5 AS INTEGER)')},
         round((sum(CASE WHEN y = 1 THEN ar ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc
  FROM (SELECT *, rank() OVER (PARTITION BY which ORDER BY p) + (count(*) OVER (PARTITION BY which, p) - 1) / 2.0 AS ar
        FROM (SELECT 'm1' AS which, final_status AS y, proba AS p FROM scores WHERE split = 'train' AND model_id = 'm1'
              UNION ALL
              SELECT 'mean', final_status, avg(proba) FROM scores WHERE split = 'train' GROUP BY row_id, final_status) u) r
  GROUP BY which) c, LATERAL (SELECT {metrics_sql()}) y""", "scores"))
def pl07(spark, sf):
    """One scorer against the blend that replaces it: precision, recall, F1 and AUC of both."""
    s = scores(spark, sf).filter(F.col("split") == "train")
    one = s.filter(F.col("model_id") == "m1").select(F.lit("m1").alias("which"), "final_status", F.col("proba").alias("p"))
    both = one.unionByName(SC.mean_score(s, ["row_id", "final_status"]).select(F.lit("mean").alias("which"), "final_status", "p"))
    report = binary_report(both, "final_status", "p", ["which"]).select("which", "precision", "recall", "f1")
    return rounded(report.join(SC.auc(both, "final_status", "p", ["which"]), "which"))


@query("so01_row_append_by_name", with_ctes(f"""
SELECT row_id, goal, final_status, 'train' AS origin FROM projects WHERE split = 'train'
UNION ALL
SELECT row_id, NULL AS goal, CAST(p > 0.5 AS INTEGER) AS final_status, 'pseudo' AS origin FROM {ROW_MEAN_SQL} m
WHERE p < 0.30 OR p > 0.70""", "scores"))
def so01(spark, sf):
    base = projects(spark, sf).filter(F.col("split") == "train").select(
        "row_id", "goal", "final_status", F.lit("train").alias("origin"))
    pseudo = (row_mean(spark, sf).filter((F.col("p") < LO) | (F.col("p") > HI))
              .select("row_id", (F.col("p") > 0.5).cast("int").alias("final_status"), F.lit("pseudo").alias("origin")))
    return base.unionByName(pseudo, allowMissingColumns=True)


@query("ud01_row_lambda_as_expression", with_ctes("""
SELECT row_id, coalesce(CASE currency """ + " ".join(
    f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in __import__('stacksmith.plans.inputs', fromlist=['USD_RATES']).USD_RATES.items())
    + """ END, 1.0) * goal AS goal_usd FROM projects""", "projects"))
def ud01(spark, sf):
    """A per-row lookup lambda written as a native CASE expression (no Python UDF)."""
    from stacksmith.plans.inputs import USD_RATES
    rate = None
    for k, v in USD_RATES.items():
        rate = F.when(F.col("currency") == k, F.lit(v)) if rate is None else rate.when(F.col("currency") == k, F.lit(v))
    p = projects(spark, sf)
    return p.select("row_id", (F.coalesce(rate, F.lit(1.0)) * F.col("goal")).alias("goal_usd"))

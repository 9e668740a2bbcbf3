"""Queries on the long score table: metrics, blends, weights, sweeps,
subset search (ag11, ag12, ag14-ag16, ag20, ev02, ev03, ev07, ev10-ev14,
ev19, pf06-pf09, pf11, sc16, sc17, wn09)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stacksmith.functions.metrics import confusion_sql, f1_sql, metrics_sql, rounded
from stacksmith.functions.scalars import binary_mask
from stacksmith.functions.seeded import seeded_key_sql
from stacksmith.operators import scores as SC
from stacksmith.operators.joins import merge_prediction_sets
from stacksmith.operators.sampling import kfold
from stacksmith.plans.inputs import MODEL_STRENGTH, SEED, scores, with_ctes
from stacksmith.plans.registry import query

MODELS = list(MODEL_STRENGTH)
WEIGHT_METHODS = ["naive", "power", "softmax", "minmax", "rank"]


def _s(body: str) -> str:
    return with_ctes(body, "scores")


def oof(spark, sf):
    return scores(spark, sf).filter(F.col("split") == "train")


def test_fold_means(spark, sf):
    return SC.mean_score(scores(spark, sf).filter(F.col("split") == "test"), ["row_id", "model_id"])


def model_f1(spark, sf):
    return SC.f1_table(oof(spark, sf), "final_status", "proba", ["model_id"])


OOF_SQL = "(SELECT * FROM scores WHERE split = 'train')"
F1_SQL = f"""(SELECT model_id, tp, fp, fn, tn, {metrics_sql()} FROM (
  SELECT model_id, {confusion_sql('final_status', 'CAST(proba > 0.5 AS INTEGER)')} FROM {OOF_SQL} o GROUP BY model_id) c)"""
F1_RAW_SQL = f"""(SELECT model_id, {f1_sql()} AS f1 FROM (
  SELECT model_id, {confusion_sql('final_status', 'CAST(proba > 0.5 AS INTEGER)')} FROM {OOF_SQL} o GROUP BY model_id) c)"""
TEST_MEANS_SQL = "(SELECT row_id, model_id, avg(proba) AS p FROM scores WHERE split = 'test' GROUP BY 1, 2)"


@query("ev14_model_f1", _s(f"SELECT * FROM {F1_SQL} t"))
def ev14(spark, sf):
    return rounded(model_f1(spark, sf))


@query("ag11_per_class_report", _s(f"""
SELECT model_id, 1 AS class, precision, recall, f1, CAST(tp + fn AS BIGINT) AS support FROM {F1_SQL} a
UNION ALL
SELECT model_id, 0 AS class,
  round(CASE WHEN tn + fn = 0 THEN 0.0 ELSE tn * 1.0 / (tn + fn) END, 6),
  round(CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn * 1.0 / (tn + fp) END, 6),
  round(CASE WHEN 2 * tn + fn + fp = 0 THEN 0.0 ELSE 2.0 * tn / (2 * tn + fn + fp) END, 6),
  CAST(tn + fp AS BIGINT) FROM {F1_SQL} b"""))
def ag11(spark, sf):
    t = model_f1(spark, sf)
    pos = t.select("model_id", F.lit(1).alias("class"), "precision", "recall", "f1",
                   (F.col("tp") + F.col("fn")).alias("support"))
    swapped = t.select("model_id", F.col("tn").alias("tp"), F.col("fn").alias("fp"), F.col("fp").alias("fn"),
                       F.col("tp").alias("tn"))
    from stacksmith.functions.metrics import with_metrics
    neg = with_metrics(swapped).select("model_id", F.lit(0).alias("class"), "precision", "recall", "f1",
                                       (F.col("tp") + F.col("fn")).alias("support"))
    return rounded(pos.unionByName(neg))


@query("ag12_auc_with_ties", _s(f"""
SELECT model_id, round((sum(CASE WHEN final_status = 1 THEN ar ELSE 0 END)
        - P * (P + 1) / 2.0) / (P * N), 6) AS auc
FROM (SELECT model_id, final_status,
             rank() OVER (PARTITION BY model_id ORDER BY proba)
               + (count(*) OVER (PARTITION BY model_id, proba) - 1) / 2.0 AS ar,
             sum(final_status) OVER (PARTITION BY model_id) AS P,
             sum(1 - final_status) OVER (PARTITION BY model_id) AS N
      FROM {OOF_SQL} o) r
GROUP BY model_id, P, N"""))
def ag12(spark, sf):
    return rounded(SC.auc(oof(spark, sf), "final_status", "proba", ["model_id"]))


@query("ev02_test_fold_mean", _s(f"SELECT row_id, model_id, round(p, 6) AS p FROM {TEST_MEANS_SQL} t"))
def ev02(spark, sf):
    return test_fold_means(spark, sf).select("row_id", "model_id", F.round("p", 6).alias("p"))


@query("ag15_row_mean_all_models", _s("""
SELECT row_id, round(avg(proba), 6) AS p FROM scores WHERE split = 'test' GROUP BY row_id"""))
def ag15(spark, sf):
    s = scores(spark, sf).filter(F.col("split") == "test")
    return SC.mean_score(s, ["row_id"]).select("row_id", F.round("p", 6).alias("p"))


FOLD_F1_SQL = f"""(SELECT model_id, fold, {f1_sql()} AS f1 FROM (
  SELECT model_id, fold, {confusion_sql('final_status', 'CAST(proba > 0.5 AS INTEGER)')} FROM {OOF_SQL} o GROUP BY 1, 2) c)"""


def fold_f1(spark, sf):
    return SC.f1_table(oof(spark, sf), "final_status", "proba", ["model_id", "fold"]).select("model_id", "fold", "f1")


@query("ev03_fold_f1_weighted_test", _s(f"""
SELECT s.row_id, s.model_id, round(sum(f.f1 * s.proba) / sum(f.f1), 6) AS p
FROM scores s JOIN {FOLD_F1_SQL} f ON s.model_id = f.model_id AND s.fold = f.fold
WHERE s.split = 'test' GROUP BY 1, 2"""))
def ev03(spark, sf):
    s = scores(spark, sf).filter(F.col("split") == "test")
    w = fold_f1(spark, sf).withColumnRenamed("f1", "weight")
    out = SC.weighted_mean(s, w, ["row_id", "model_id"], ["model_id", "fold"])
    return out.select("row_id", "model_id", F.round("p", 6).alias("p"))


@query("ag16_fold_f1_mean_std", _s(f"""
SELECT model_id, round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS std_f1 FROM {FOLD_F1_SQL} f GROUP BY 1"""))
def ag16(spark, sf):
    f = fold_f1(spark, sf)
    return f.groupBy("model_id").agg(F.round(F.avg("f1"), 6).alias("mean_f1"),
                                     F.round(F.stddev_pop("f1"), 6).alias("std_f1"))


def _weights_sql() -> str:
    base = F1_RAW_SQL
    raw = {
        "naive": "f1",
        "power": "pow(f1, 4)",
        "softmax": "exp(f1 / 1.0)",
        "minmax": "pow(CASE WHEN max(f1) OVER () > min(f1) OVER () THEN (f1 - min(f1) OVER ()) / (max(f1) OVER () - min(f1) OVER ()) ELSE 0.0 END + 1e-8, 4)",
        "rank": "CAST(row_number() OVER (ORDER BY f1, model_id) AS DOUBLE)",
    }
    parts = [f"""SELECT '{m}' AS method, model_id, round(CASE WHEN sum(r) OVER () > 0 THEN r / sum(r) OVER ()
  ELSE 1.0 / count(*) OVER () END, 6) AS weight FROM (SELECT model_id, {e} AS r FROM {base} b) x""" for m, e in raw.items()]
    return "\nUNION ALL\n".join(parts)


@query("ev07_weight_methods", _s(_weights_sql()))
def ev07(spark, sf):
    f1 = model_f1(spark, sf)
    out = None
    for m in WEIGHT_METHODS:
        w = SC.model_weights(f1, m).select(F.lit(m).alias("method"), "model_id", "weight")
        out = w if out is None else out.unionByName(w)
    return rounded(out)


@query("ag14_weighted_row_mean", _s(f"""
SELECT t.row_id, round(sum(w.weight * t.p) / sum(w.weight), 6) AS p
FROM {TEST_MEANS_SQL} t JOIN (SELECT model_id, f1 / sum(f1) OVER () AS weight FROM {F1_RAW_SQL} f) w
ON t.model_id = w.model_id GROUP BY t.row_id"""))
def ag14(spark, sf):
    w = SC.model_weights(model_f1(spark, sf), "naive")
    out = SC.weighted_mean(test_fold_means(spark, sf), w, ["row_id"], ["model_id"], proba="p")
    return out.select("row_id", F.round("p", 6).alias("p"))


SWEEP_SQL = f"""
SELECT model_id, CAST(j AS DOUBLE) / 200 AS threshold, tp, fp, fn, {f1_sql()} AS f1
FROM (SELECT model_id, j,
        CAST(sum(CASE WHEN final_status = 1 AND proba > CAST(j AS DOUBLE) / 200 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
        CAST(sum(CASE WHEN final_status = 0 AND proba > CAST(j AS DOUBLE) / 200 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
        CAST(sum(CASE WHEN final_status = 1 AND NOT proba > CAST(j AS DOUBLE) / 200 THEN 1 ELSE 0 END) AS BIGINT) AS fn
      FROM {OOF_SQL} o, (SELECT range AS j FROM range(0, 201)) t GROUP BY 1, 2) c"""


def sweep(spark, sf):
    return SC.threshold_sweep(oof(spark, sf), "final_status", "proba", ["model_id"])


@query("ev10_threshold_sweep", _s(f"SELECT model_id, round(threshold, 6) AS threshold, tp, fp, fn, round(f1, 6) AS f1 FROM ({SWEEP_SQL}) s"))
def ev10(spark, sf):
    return rounded(sweep(spark, sf))


@query("ev10_best_threshold", _s(f"""
SELECT model_id, round(threshold, 6) AS best_threshold, round(f1, 6) AS best_f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY f1 DESC, threshold) AS r FROM ({SWEEP_SQL}) s) x
WHERE r = 1"""))
def ev10b(spark, sf):
    return rounded(SC.best_threshold(sweep(spark, sf), ["model_id"]))


def oof_wide(spark, sf):
    return (oof(spark, sf).groupBy("row_id", "final_status", "fold").pivot("model_id", MODELS)
            .agg(F.first("proba")))


OOF_WIDE_SQL = f"""(SELECT row_id, final_status, fold, """ + ", ".join(
    f"max(CASE WHEN model_id = '{m}' THEN proba END) AS {m}" for m in MODELS) + f" FROM {OOF_SQL} o GROUP BY 1, 2, 3)"


def _subset_sql() -> str:
    total = "CAST(0.0 AS DOUBLE)" + "".join(
        f" + CASE WHEN (m >> {i}) & 1 = 1 THEN {mm} ELSE CAST(0.0 AS DOUBLE) END" for i, mm in enumerate(MODELS))
    names = ", ".join(f"CASE WHEN (m >> {i}) & 1 = 1 THEN '{mm}' END" for i, mm in enumerate(MODELS))
    return f"""
SELECT CAST(m AS INTEGER) AS mask, concat_ws('+', {names}) AS members, CAST(bit_count(CAST(m AS INTEGER)) AS INTEGER) AS n_members,
       tp, fp, fn, {f1_sql()} AS f1
FROM (SELECT m, {confusion_sql('final_status', 'pred')} FROM (
  SELECT m, final_status, CAST(({total}) / bit_count(CAST(m AS INTEGER)) > 0.5 AS INTEGER) AS pred
  FROM {OOF_WIDE_SQL} w, (SELECT range AS m FROM range(1, {1 << len(MODELS)})) k) x GROUP BY m) c"""


SUBSET_SQL = _subset_sql()


def subsets(spark, sf):
    return SC.subset_search(oof_wide(spark, sf), "final_status", MODELS)


@query("ev11_subset_search", _s(f"SELECT mask, members, n_members, tp, fp, fn, round(f1, 6) AS f1 FROM ({SUBSET_SQL}) s"))
def ev11(spark, sf):
    return rounded(subsets(spark, sf))


TOP_K = 3
MEMBERSHIP_SQL = f"""(SELECT model_id, n_in_top, CAST(n_in_top AS DOUBLE) / sum(n_in_top) OVER () AS weight FROM (
  SELECT model_id, count(*) AS n_in_top FROM (
    SELECT unnest(string_split(members, '+')) AS model_id FROM (
      SELECT members, row_number() OVER (ORDER BY f1 DESC, mask) AS r FROM ({SUBSET_SQL}) s) t WHERE r <= {TOP_K}) u
  GROUP BY model_id) c)"""


@query("ag20_membership_weights", _s(f"SELECT model_id, n_in_top, round(weight, 6) AS weight FROM {MEMBERSHIP_SQL} mw"))
def ag20(spark, sf):
    return rounded(SC.membership_weights(subsets(spark, sf), MODELS, TOP_K))


@query("ev12_membership_blend_3fold_f1", _s(f"""
SELECT fold3, round(CASE WHEN 2*tp+fp+fn = 0 THEN 0.0 ELSE 2.0*tp / (2*tp+fp+fn) END, 6) AS f1 FROM (
  SELECT fold3, {confusion_sql('final_status', 'CAST(p > 0.5 AS INTEGER)')} FROM (
    SELECT o.row_id, o.final_status, sum(w.weight * o.proba) / sum(w.weight) AS p,
           CAST((row_number() OVER (ORDER BY {seeded_key_sql(SEED, 'o.row_id')}, o.row_id) - 1) % 3 AS INTEGER) AS fold3
    FROM {OOF_SQL} o JOIN {MEMBERSHIP_SQL} w ON o.model_id = w.model_id
    GROUP BY o.row_id, o.final_status) b GROUP BY fold3) c"""))
def ev12(spark, sf):
    w = SC.membership_weights(subsets(spark, sf), MODELS, TOP_K)
    blend = SC.weighted_mean(oof(spark, sf), w.select("model_id", "weight"), ["row_id", "final_status"], ["model_id"])
    blend = kfold(blend, 3, SEED, out="fold3")
    return rounded(SC.f1_table(blend, "final_status", "p", ["fold3"]).select("fold3", "f1"))


@query("ev13_submission_blend", _s(f"""
SELECT t.row_id, CAST(round_even(sum(f.f1 * t.lab) / sum(f.f1), 0) AS INTEGER) AS state
FROM (SELECT row_id, model_id, CAST(p > 0.5 AS INTEGER) AS lab FROM {TEST_MEANS_SQL} m) t
JOIN {F1_RAW_SQL} f ON t.model_id = f.model_id GROUP BY t.row_id"""))
def ev13(spark, sf):
    labs = test_fold_means(spark, sf).select("row_id", "model_id", (F.col("p") > 0.5).cast("int").alias("lab"))
    w = model_f1(spark, sf).select("model_id", F.col("f1").alias("weight"))
    out = SC.weighted_mean(labs, w, ["row_id"], ["model_id"], proba="lab")
    return out.select("row_id", F.bround("p", 0).cast("int").alias("state"))


@query("ev19_compare_prediction_sets", _s("""
SELECT a.model_id AS a, b.model_id AS b, round(corr(a.p, b.p), 6) AS corr,
       round(avg(CASE WHEN (a.p > 0.5) = (b.p > 0.5) THEN 1.0 ELSE 0.0 END), 6) AS agreement
FROM """ + TEST_MEANS_SQL + " a JOIN " + TEST_MEANS_SQL + """ b ON a.row_id = b.row_id AND a.model_id < b.model_id
GROUP BY 1, 2"""))
def ev19(spark, sf):
    wide = merge_prediction_sets(test_fold_means(spark, sf), "row_id", "model_id", "p", MODELS)
    aggs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 6).alias("corr"),
                     F.round(F.avg(((F.col(a) > 0.5) == (F.col(b) > 0.5)).cast("double")), 6).alias("agreement"))
            for i, a in enumerate(MODELS) for b in MODELS[i + 1:]]
    return wide.agg(F.array(*aggs).alias("_c")).select(F.explode("_c").alias("c")).select("c.*")


@query("wn09_rank_models_by_f1", _s(f"""
SELECT model_id, round(f1, 6) AS f1, CAST(row_number() OVER (ORDER BY f1 DESC, model_id) AS INTEGER) AS rank FROM {F1_RAW_SQL} t"""))
def wn09(spark, sf):
    t = model_f1(spark, sf)
    return rounded(t.select("model_id", "f1", F.row_number().over(Window.orderBy(F.desc("f1"), "model_id")).alias("rank")))


@query("sc16_subset_masks", _s(f"""
SELECT CAST(range AS INTEGER) AS mask, lpad(bin(range), n, '0') AS bits
FROM (SELECT CAST(count(DISTINCT model_id) AS INTEGER) AS n FROM scores) c, range(1, 1 << (SELECT count(DISTINCT model_id) FROM scores))"""))
def sc16(spark, sf):
    n = scores(spark, sf).select("model_id").distinct().count()
    m = spark.range(1, 1 << n).select(F.col("id").cast("int").alias("mask"))
    return m.select("mask", binary_mask("mask", n).alias("bits"))


@query("sc16_row_vote_masks", _s("""
SELECT row_id, CAST(sum(CASE WHEN proba > 0.5 THEN 1 << (CAST(substr(model_id, 2) AS INTEGER) - 1) ELSE 0 END) AS INTEGER) AS mask,
       lpad(bin(CAST(sum(CASE WHEN proba > 0.5 THEN 1 << (CAST(substr(model_id, 2) AS INTEGER) - 1) ELSE 0 END) AS INTEGER)),
            CAST((SELECT count(DISTINCT model_id) FROM scores) AS INTEGER), '0') AS bits
FROM scores WHERE split = 'train' GROUP BY row_id"""))
def sc16_rows(spark, sf):
    """Which models vote for each row, as a mask with one digit a model."""
    place = F.create_map(*[F.lit(x) for i, m in enumerate(MODELS) for x in (m, 1 << i)])
    votes = oof(spark, sf).groupBy("row_id").agg(F.sum(F.when(F.col("proba") > 0.5, F.element_at(place, F.col("model_id"))).otherwise(0))
                                                 .cast("int").alias("mask"))
    return votes.select("row_id", "mask", binary_mask("mask", len(MODELS)).alias("bits"))


@query("sc17_minmax_per_model", _s(f"""
SELECT row_id, model_id, round(CASE WHEN hi > lo THEN (p - lo) / (hi - lo) ELSE 0.0 END, 6) AS p_scaled
FROM (SELECT *, min(p) OVER (PARTITION BY model_id) AS lo, max(p) OVER (PARTITION BY model_id) AS hi FROM {TEST_MEANS_SQL} t) x"""))
def sc17(spark, sf):
    out = SC.min_max_per_group(test_fold_means(spark, sf), "p", ["model_id"], "p_scaled")
    return out.select("row_id", "model_id", F.round("p_scaled", 6).alias("p_scaled"))


ROW_MEAN_SQL = "(SELECT row_id, avg(proba) AS p FROM scores WHERE split = 'test' GROUP BY row_id)"


def row_mean(spark, sf):
    return SC.mean_score(scores(spark, sf).filter(F.col("split") == "test"), ["row_id"])


@query("pf06_two_sided_confidence", _s(f"SELECT row_id FROM {ROW_MEAN_SQL} m WHERE p < 0.30 OR p > 0.70"))
def pf06(spark, sf):
    return row_mean(spark, sf).filter("p < 0.30 or p > 0.70").select("row_id")


@query("pf07_confident_not_taken", _s(f"""
SELECT row_id FROM {ROW_MEAN_SQL} m WHERE p > 0.7 AND row_id NOT IN (SELECT row_id FROM {ROW_MEAN_SQL} t WHERE p > 0.75)"""))
def pf07(spark, sf):
    m = row_mean(spark, sf)
    return m.filter(F.col("p") > 0.7).join(m.filter(F.col("p") > 0.75).select("row_id"), "row_id", "left_anti").select("row_id")


@query("pf08_fold_rows", _s("SELECT row_id, fold FROM scores WHERE split = 'train' AND model_id = 'm1' AND fold <> 2"))
def pf08(spark, sf):
    return oof(spark, sf).filter((F.col("model_id") == "m1") & (F.col("fold") != 2)).select("row_id", "fold")


@query("pf09_templated_names", _s("SELECT row_id, " + ", ".join(
    f"round(max(CASE WHEN model_id = '{m}' THEN p END), 6) AS {m}__proba_pos" for m in MODELS) + f" FROM {TEST_MEANS_SQL} t GROUP BY row_id"))
def pf09(spark, sf):
    wide = merge_prediction_sets(test_fold_means(spark, sf), "row_id", "model_id", "p", MODELS)
    return wide.select("row_id", *[F.round(m, 6).alias(f"{m}__proba_pos") for m in MODELS])


@query("pf11_binarise", _s("""
SELECT row_id, model_id, CAST(proba > 0.5 AS INTEGER) AS label_gt, CAST(proba >= 0.5 AS INTEGER) AS label_ge
FROM scores WHERE split = 'train'"""))
def pf11(spark, sf):
    from stacksmith.functions.metrics import predicted
    o = oof(spark, sf)
    return o.select("row_id", "model_id", predicted("proba").alias("label_gt"),
                    predicted("proba", inclusive=True).alias("label_ge"))

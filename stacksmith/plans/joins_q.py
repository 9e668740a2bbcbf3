"""Join, interval-overlap, rank, fold and sampling queries (jn02-jn08,
wn01-wn05, wn07, wn11, fe10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stacksmith.operators import joins as J
from stacksmith.operators import sampling as SMP
from stacksmith.operators.overlap import overlap_count
from stacksmith.operators.rank import rank_lookup
from stacksmith.plans.inputs import SEED, folds_sql, intervals, projects, scores, with_ctes
from stacksmith.plans.registry import query
from stacksmith.sources.tables import load
from stacksmith.functions.seeded import seeded_key_sql

_NORM = """n AS (SELECT row_number() OVER () AS uid, row_id, l_linenumber, start_ts, end_ts, split,
                   least(start_ts, end_ts) AS s, greatest(start_ts, end_ts) AS e FROM intervals)"""


def _ov_sql(cond: str, minus_self: str, extra_where: str = "", probe: str = "n", ref: str = "n") -> str:
    return with_ctes(f""", {_NORM}
SELECT a.row_id, a.l_linenumber, a.start_ts, a.end_ts, CAST(count(b.uid) {minus_self} AS BIGINT) AS n_overlap
FROM {probe} a LEFT JOIN {ref} b ON {cond} {extra_where}
GROUP BY a.uid, a.row_id, a.l_linenumber, a.start_ts, a.end_ts""", "intervals").replace(")\n, n AS", "),\n n AS")


@query("jn03_overlap_self_closed", _ov_sql("b.s <= a.e AND b.e >= a.s", "- 1"))
def jn03(spark, sf):
    iv = intervals(spark, sf).select("row_id", "l_linenumber", "start_ts", "end_ts")
    return overlap_count(iv, "start_ts", "end_ts", closed=True, bucket_width=86400)


@query("jn03_overlap_self_open", with_ctes(f""", {_NORM}
SELECT a.row_id, a.l_linenumber, a.start_ts, a.end_ts,
       CAST(CASE WHEN a.s < a.e THEN count(b.uid) - 1 ELSE 0 END AS BIGINT) AS n_overlap
FROM n a LEFT JOIN n b ON b.s < a.e AND b.e > a.s AND b.s < b.e
GROUP BY a.uid, a.row_id, a.l_linenumber, a.start_ts, a.end_ts, a.s, a.e""", "intervals").replace(")\n, n AS", "),\n n AS"))
def jn03_open(spark, sf):
    iv = intervals(spark, sf).select("row_id", "l_linenumber", "start_ts", "end_ts")
    return overlap_count(iv, "start_ts", "end_ts", closed=False, bucket_width=86400)


@query("jn04_overlap_test_vs_train", with_ctes(f""", {_NORM}
SELECT a.row_id, a.l_linenumber, a.start_ts, a.end_ts, CAST(count(b.uid) AS BIGINT) AS n_overlap
FROM (SELECT * FROM n WHERE split = 'test') a
LEFT JOIN (SELECT * FROM n WHERE split = 'train') b ON b.s <= a.e AND b.e >= a.s
GROUP BY a.uid, a.row_id, a.l_linenumber, a.start_ts, a.end_ts""", "intervals").replace(")\n, n AS", "),\n n AS"))
def jn04(spark, sf):
    iv = intervals(spark, sf)
    test = iv.filter(F.col("split") == "test").select("row_id", "l_linenumber", "start_ts", "end_ts")
    train = iv.filter(F.col("split") == "train").select("start_ts", "end_ts")
    return overlap_count(test, "start_ts", "end_ts", closed=True, reference=train, bucket_width=86400)


@query("wn01_sorted_rank_lookup", with_ctes("""
SELECT t.row_id, t.goal,
       CAST((SELECT count(*) FROM projects r WHERE r.split = 'train' AND r.goal <= t.goal) AS BIGINT) AS count_le,
       CAST((SELECT count(*) FROM projects r WHERE r.split = 'train' AND r.goal < t.goal) AS BIGINT) AS count_lt
FROM projects t WHERE t.split = 'test'""", "projects"))
def wn01(spark, sf):
    p = projects(spark, sf)
    train = p.filter(F.col("split") == "train").select("goal")
    test = p.filter(F.col("split") == "test").select("row_id", "goal")
    return rank_lookup(train, test, "goal")


@query("jn02_merge_on_key", with_ctes("""
SELECT p.row_id, p.goal, l.n_lines, l.sum_qty FROM projects p
JOIN (SELECT l_orderkey AS row_id, count(*) AS n_lines, sum(l_quantity) AS sum_qty FROM lineitem GROUP BY 1) l
ON p.row_id = l.row_id""", "projects"))
def jn02(spark, sf):
    p = projects(spark, sf).select("row_id", "goal")
    li = (load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("row_id"))
          .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("sum_qty")))
    return J.merge_on_key(p, li)


TEST_MEAN_SQL = """test_mean AS (SELECT row_id, final_status, avg(proba) AS p FROM scores WHERE split = 'test' GROUP BY 1, 2)"""


def test_mean(spark, sf):
    """ag15 on test rows: mean over fold models and models."""
    s = scores(spark, sf).filter(F.col("split") == "test")
    return s.groupBy("row_id", "final_status").agg(F.avg("proba").alias("p"))


@query("jn05_anti_taken", with_ctes(f", {TEST_MEAN_SQL}" + """
SELECT row_id FROM test_mean WHERE p > 0.5 AND row_id NOT IN (SELECT row_id FROM test_mean WHERE p > 0.6)""",
                                    "scores").replace(")\n, test_mean", "),\n test_mean"))
def jn05(spark, sf):
    m = test_mean(spark, sf)
    taken = m.filter(F.col("p") > 0.6)
    return J.anti_taken(m.filter(F.col("p") > 0.5), taken).select("row_id")


@query("jn06_semi_by_score", with_ctes(f", {TEST_MEAN_SQL}" + """
SELECT p.row_id, p.goal, p.final_status FROM projects p
WHERE p.row_id IN (SELECT row_id FROM test_mean WHERE p < 0.2 OR p > 0.6)""",
                                       "scores").replace(")\n, test_mean", "),\n test_mean"))
def jn06(spark, sf):
    m = test_mean(spark, sf).filter((F.col("p") < 0.2) | (F.col("p") > 0.6))
    p = projects(spark, sf).filter(F.col("split") == "test").select("row_id", "goal", "final_status")
    return J.semi_select(p, m)


@query("jn07_attach_ids", with_ctes(f", {TEST_MEAN_SQL}" + """
SELECT p.row_id AS id, CAST(m.p > 0.5 AS INTEGER) AS state FROM test_mean m JOIN projects p ON m.row_id = p.row_id""",
                                    "scores").replace(")\n, test_mean", "),\n test_mean"))
def jn07(spark, sf):
    pred = test_mean(spark, sf).select("row_id", (F.col("p") > 0.5).cast("int").alias("state"))
    ids = projects(spark, sf).filter(F.col("split") == "test").select("row_id", F.col("row_id").alias("id"))
    return J.attach_ids(pred, ids)


MODELS = ["m1", "m2", "m3", "m4", "m5"]


@query("jn08_merge_prediction_sets", with_ctes("""
SELECT row_id, """ + ", ".join(
    f"max(CASE WHEN model_id = '{m}' THEN lab END) AS pred_{m}" for m in MODELS) + """
FROM (SELECT row_id, model_id, CAST(avg(proba) > 0.5 AS INTEGER) AS lab FROM scores WHERE split = 'test' GROUP BY 1, 2) t
GROUP BY row_id""", "scores"))
def jn08(spark, sf):
    s = scores(spark, sf).filter(F.col("split") == "test")
    runs = s.groupBy("row_id", "model_id").agg((F.avg("proba") > 0.5).cast("int").alias("lab"))
    return J.merge_prediction_sets(runs, "row_id", "model_id", "lab", MODELS, prefix="pred_")


# ---------------------------------------------------------------- folds and samples

TRAIN_SQL = "(SELECT row_id, final_status FROM projects WHERE split = 'train')"


def _train(spark, sf):
    return projects(spark, sf).filter(F.col("split") == "train").select("row_id", "final_status")


@query("wn02_stratified_kfold", with_ctes(f"SELECT row_id, final_status, fold FROM ({folds_sql(TRAIN_SQL)}) f", "projects"))
def wn02(spark, sf):
    return SMP.stratified_kfold(_train(spark, sf), 5, SEED, "final_status")


@query("wn02_fold_sizes", with_ctes(f"""
SELECT fold, final_status, count(*) AS n FROM ({folds_sql(TRAIN_SQL)}) f GROUP BY 1, 2""", "projects"))
def wn02_sizes(spark, sf):
    f = SMP.stratified_kfold(_train(spark, sf), 5, SEED, "final_status")
    return f.groupBy("fold", "final_status").agg(F.count(F.lit(1)).alias("n"))


@query("wn03_kfold", with_ctes(f"""
SELECT row_id, CAST((row_number() OVER (ORDER BY {seeded_key_sql(SEED, 'row_id')}, row_id) - 1) % 5 AS INTEGER) AS fold
FROM {TRAIN_SQL} t""", "projects"))
def wn03(spark, sf):
    return SMP.kfold(_train(spark, sf), 5, SEED).select("row_id", "fold")


def _holdout_sql(frac: float) -> str:
    return f"""
SELECT row_id, final_status,
       row_number() OVER (PARTITION BY final_status ORDER BY {seeded_key_sql(SEED, 'row_id')}, row_id)
         <= round(count(*) OVER (PARTITION BY final_status) * {frac}) AS is_holdout
FROM {TRAIN_SQL} t"""


@query("wn04_stratified_holdout", with_ctes(_holdout_sql(0.2), "projects"))
def wn04(spark, sf):
    return SMP.stratified_holdout(_train(spark, sf), 0.2, SEED, "final_status")


@query("wn04_three_way_split", with_ctes(f"""
SELECT row_id, final_status, CASE WHEN rk <= round(cn * 0.2) THEN 'test'
  WHEN rk <= round(cn * 0.2) + round(cn * 0.25) THEN 'valid' ELSE 'train' END AS part
FROM (SELECT row_id, final_status,
       row_number() OVER (PARTITION BY final_status ORDER BY {seeded_key_sql(SEED, 'row_id')}, row_id) AS rk,
       count(*) OVER (PARTITION BY final_status) AS cn FROM {TRAIN_SQL} t) r""", "projects"))
def wn04b(spark, sf):
    return SMP.three_way_split(_train(spark, sf), 0.25, 0.2, SEED, "final_status")


@query("wn05_first_fold_validation", with_ctes(f"""
SELECT row_id, final_status FROM ({folds_sql(TRAIN_SQL)}) f WHERE fold = 0""", "projects"))
def wn05(spark, sf):
    f = SMP.stratified_kfold(_train(spark, sf), 5, SEED, "final_status")
    return f.filter(F.col("fold") == 0).select("row_id", "final_status")


@query("fe10_undersample", with_ctes(f"""
SELECT row_id, final_status FROM (
  SELECT row_id, final_status,
         row_number() OVER (PARTITION BY final_status ORDER BY {seeded_key_sql(SEED, 'row_id')}, row_id) AS rk
  FROM {TRAIN_SQL} t) r
WHERE rk <= (SELECT min(c) FROM (SELECT count(*) AS c FROM {TRAIN_SQL} t2 GROUP BY final_status) m)""", "projects"))
def fe10(spark, sf):
    return SMP.undersample(_train(spark, sf), SEED, "final_status")


@query("wn07_row_argmax", with_ctes("""
SELECT row_id, 'm' || CAST(list_position(ps, list_max(ps)) AS VARCHAR) AS best_model FROM (
  SELECT row_id, [""" + ", ".join(f"max(CASE WHEN model_id = '{m}' THEN p END)" for m in MODELS) + """] AS ps
  FROM (SELECT row_id, model_id, avg(proba) AS p FROM scores WHERE split = 'test' GROUP BY 1, 2) t GROUP BY row_id) w""",
                                  "scores"))
def wn07(spark, sf):
    s = scores(spark, sf).filter(F.col("split") == "test").groupBy("row_id", "model_id").agg(F.avg("proba").alias("p"))
    wide = J.merge_prediction_sets(s, "row_id", "model_id", "p", MODELS)
    arr = F.array(*[F.col(m) for m in MODELS])
    names = F.array(*[F.lit(m) for m in MODELS])
    return wide.select("row_id", F.element_at(names, F.array_position(arr, F.array_max(arr)).cast("int")).alias("best_model"))


@query("wn11_sort_head", with_ctes("SELECT row_id, goal FROM projects ORDER BY goal DESC, row_id LIMIT 10", "projects"))
def wn11(spark, sf):
    return projects(spark, sf).select("row_id", "goal").orderBy(F.desc("goal"), "row_id").limit(10)

"""Source and sink queries (io01, io03-io13, io04 wide vector names / sc19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stacksmith.operators.features import OneHot, align_columns
from stacksmith.plans.eda import goal_usd, GOAL_USD_SQL
from stacksmith.plans.inputs import USD_RATES, projects, scores, with_ctes
from stacksmith.plans.registry import query
from stacksmith.sources import runs as RU
from stacksmith.sources import store as ST
from stacksmith.sources.tables import load

ORDERS_SCHEMA = ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                 "o_orderdate timestamp_ntz, o_orderpriority string")


@query("io01_csv_scan", "SELECT * FROM orders")
def io01(spark, sf):
    path = ST.write_csv(load(spark, sf, "orders"), ST.fresh_path(spark, "orders-csv"))
    return ST.read_csv(spark, path, ORDERS_SCHEMA)


TEST_MEAN_SQL = "(SELECT row_id, avg(proba) AS p FROM scores WHERE split = 'test' GROUP BY row_id)"


def _predictions(spark, sf):
    s = scores(spark, sf).filter(F.col("split") == "test")
    return s.groupBy("row_id").agg((F.avg("proba") > 0.5).cast("int").alias("state"))


@query("io03_headerless_id_scan", with_ctes(
    f"SELECT row_id AS id, CAST(p > 0.5 AS INTEGER) AS state FROM {TEST_MEAN_SQL} m", "scores"))
def io03(spark, sf):
    pred = _predictions(spark, sf).select(F.col("row_id").alias("id"), "state")
    path = ST.write_csv(pred, ST.fresh_path(spark, "submission"), header=False)
    return ST.read_csv(spark, path, "id long, state int", header=False)


@query("io08_headerless_prediction_sink", with_ctes(
    f"SELECT CAST(row_id AS VARCHAR) || ',' || CAST(CAST(p > 0.5 AS INTEGER) AS VARCHAR) AS value FROM {TEST_MEAN_SQL} m",
    "scores"))
def io08(spark, sf):
    pred = _predictions(spark, sf).select(F.col("row_id").alias("id"), "state")
    path = ST.write_csv(pred, ST.fresh_path(spark, "submission"), header=False)
    return spark.read.text(path)


DIMS = 64


@query("io04_vector_scan_long", """
SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS value
FROM embeddings""")
def io04(spark, sf):
    e = load(spark, sf, "embeddings")
    return e.select("vec_id", F.posexplode("embedding").alias("dim", "value")).select(
        "vec_id", "dim", F.col("value").cast("double").alias("value"))


@query("io04_vector_wide_names", "SELECT vec_id, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS f06__{i + 1:03d}__SentenceVec" for i in range(DIMS)) + " FROM embeddings")
def io04w(spark, sf):
    e = load(spark, sf, "embeddings")
    return e.select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(f"f06__{i + 1:03d}__SentenceVec")
                                for i in range(DIMS)])


@query("io05_json_lookup_scan", with_ctes(f"""
SELECT row_id, currency, usd_rate_c AS usd_rate FROM ({GOAL_USD_SQL}) g""", "projects", "rates"))
def io05(spark, sf):
    path = ST.write_json_lookup(spark, USD_RATES, ST.fresh_path(spark, "rates-json"))
    rates = ST.read_json_lookup(spark, path, "currency", "usd_rate")
    p = projects(spark, sf).select("row_id", "currency")
    return (p.join(rates, "currency", "left")
             .select("row_id", "currency", F.coalesce("usd_rate", F.lit(1.0)).alias("usd_rate")))


CUR = ["AUD", "CAD", "DKK", "EUR", "GBP", "MXN", "NOK", "NZD", "SEK", "USD"]


@query("io06_feature_table_sink", with_ctes("SELECT row_id, round(f01__goal, 6) AS f01__goal, " + ", ".join(
    f"CASE WHEN currency = '{c}' THEN 1 ELSE 0 END AS f03__currency__{c}" for c in CUR) + f" FROM ({GOAL_USD_SQL}) g",
    "projects", "rates"))
def io06(spark, sf):
    g = goal_usd(spark, sf)
    oh = OneHot.fit(g.filter(F.col("split") == "train"), "currency")
    cols = ["row_id", "f01__goal"] + oh.names()
    wide = g.select("row_id", F.round("f01__goal", 6).alias("f01__goal"), *oh.columns())
    path = ST.write_parquet(align_columns(wide, cols), ST.fresh_path(spark, "features"))
    return spark.read.parquet(path)


@query("io07_sample_extract", with_ctes(
    "SELECT row_id, goal, currency, final_status FROM projects ORDER BY row_id LIMIT 100", "projects"))
def io07(spark, sf):
    p = projects(spark, sf).select("row_id", "goal", "currency", "final_status")
    path = ST.write_csv(p.orderBy("row_id").limit(100), ST.fresh_path(spark, "sample"))
    return ST.read_csv(spark, path, "row_id long, goal double, currency string, final_status int")


@query("io09_memo_latest_per_key", """
SELECT user_id, event_type, ts FROM (
  SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
  FROM events) t WHERE r = 1""")
def io09(spark, sf):
    e = load(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    path = ST.fresh_path(spark, "memos")
    mid = "2024-01-15"
    # two appends: later writes must win over earlier ones
    e.filter(F.col("ts") < F.lit(mid).cast("timestamp_ntz")).write.mode("append").parquet(path)
    e.filter(F.col("ts") >= F.lit(mid).cast("timestamp_ntz")).write.mode("append").parquet(path)
    return ST.memo_upsert_latest(spark.read.parquet(path), "user_id", "event_type", ["ts", "event_id"])


def _model_f1(spark, sf):
    from stacksmith.plans.scoring_q import model_f1
    return model_f1(spark, sf)


@query("io10_run_log_sink")
def io10(spark, sf):
    f1 = _model_f1(spark, sf)
    runs = f1.select(F.concat(F.lit("run-"), F.col("model_id")).alias("run_id"), "model_id",
                     F.create_map(F.lit("threshold"), F.lit("0.5")).alias("params"),
                     F.create_map(F.lit("f1"), F.col("f1"), F.lit("precision"), F.col("precision")).alias("metrics"))
    log = ST.RunLog(spark, ST.fresh_path(spark, "runs"))
    log.append(runs)
    return log.read().drop("source_file")


@query("io11_run_log_scan_filter", with_ctes("""
SELECT model_id, f1 FROM (SELECT model_id, round(CASE WHEN 2*tp+fp+fn = 0 THEN 0.0 ELSE 2.0*tp/(2*tp+fp+fn) END, 6) AS f1 FROM (
  SELECT model_id, CAST(sum(CASE WHEN final_status=1 AND proba > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN final_status=0 AND proba > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN final_status=1 AND NOT proba > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM scores WHERE split = 'train' GROUP BY model_id) c) t WHERE f1 < 0.7""", "scores"))
def io11(spark, sf):
    f1 = _model_f1(spark, sf)
    log = ST.RunLog(spark, ST.fresh_path(spark, "runs"))
    log.append(f1.select(F.concat(F.lit("run-"), F.col("model_id")).alias("run_id"), "model_id", "f1"))
    runs = log.read()
    return (runs.filter(F.col("f1") < 0.7).orderBy(F.desc("f1"))
                .select("model_id", F.col("f1").cast("double").alias("f1")))


@query("io12_meta_store_merge", with_ctes("""
SELECT row_id, split,
  max(CASE WHEN model_id = 'm1' THEN round(proba, 2) END) AS m1,
  max(CASE WHEN model_id = 'm2' THEN proba END) AS m2,
  max(CASE WHEN model_id = 'm3' THEN proba END) AS m3
FROM scores WHERE split = 'train' GROUP BY row_id, split""", "scores"))
def io12(spark, sf):
    s = scores(spark, sf).filter(F.col("split") == "train").select("row_id", "split", "model_id", "proba")
    store = ST.MetaStore(spark, ST.fresh_path(spark, "meta"))
    old = s.filter(F.col("model_id").isin("m1", "m2")).withColumn("proba", F.round("proba", 2))
    store.write(old)
    store.write(s.filter(F.col("model_id").isin("m2", "m3")))
    return store.wide(["m1", "m2", "m3"])


def _blend_runs(spark, sf):
    """One run per weight method: a blend of all base models, with its members' weights and importances."""
    from stacksmith.operators import scores as SC
    from stacksmith.operators.rank import cut
    from stacksmith.plans.scoring_q import WEIGHT_METHODS, oof
    rows = cut(oof(spark, sf).select("row_id", "model_id", "proba", "final_status"), "blend-input")
    f1 = cut(SC.f1_table(rows, "final_status", "proba", ["model_id"]).select("model_id", "f1"), "blend-f1")
    weights = None
    for m in WEIGHT_METHODS:
        w = SC.model_weights(f1, m).select(F.lit(m).alias("method"), "model_id", "weight")
        weights = w if weights is None else weights.unionByName(w)
    weights = cut(weights, "blend-weights")
    pick = F.array(*[F.struct(F.lit(m).alias("method")) for m in WEIGHT_METHODS])
    blend = (rows.withColumn("m", F.explode(pick)).select("row_id", "model_id", "proba", "final_status", "m.method").join(weights, ["method", "model_id"])
             .groupBy("method", "row_id").agg((F.sum(F.col("weight") * F.col("proba")) / F.sum("weight")).alias("p"), F.max("final_status").alias("y")))
    report = SC.f1_table(blend, "y", "p", ["method"]).select("method", "f1", "precision", "recall")
    strength = rows.groupBy("model_id").agg(F.abs(F.corr("proba", F.col("final_status").cast("double"))).alias("importance"))
    members = weights.join(strength, "model_id").groupBy("method").agg(
        F.sort_array(F.collect_list(F.struct(F.col("model_id").alias("feature"), "importance"))).alias("importances"),
        F.sort_array(F.collect_list(F.struct(F.col("model_id").alias("member"), "weight"))).alias("weights"))
    return report.join(members, "method").select(
        F.concat(F.lit("run-"), "method").alias("run_id"), F.lit("blend").alias("model_id"),
        F.create_map(F.lit("use_rank"), F.col("method") == "rank", F.lit("blend_all"), F.lit(True)).alias("flags"),
        F.create_map(F.lit("method"), F.col("method"), F.lit("threshold"), F.lit("0.5")).alias("params"),
        F.create_map(F.lit("f1"), F.col("f1"), F.lit("precision"), F.col("precision"), F.lit("recall"), F.col("recall")).alias("metrics"),
        "importances", "weights")


def _run_facts_sql() -> str:
    from stacksmith.functions.metrics import confusion_sql, f1_sql
    raw = {"naive": "f1", "power": "pow(f1, 4)", "softmax": "exp(f1)",
           "minmax": "pow(CASE WHEN max(f1) OVER () > min(f1) OVER () THEN (f1 - min(f1) OVER ()) / (max(f1) OVER () - min(f1) OVER ()) ELSE 0.0 END + 1e-8, 4)",
           "rank": "CAST(row_number() OVER (ORDER BY f1, model_id) AS DOUBLE)"}
    weights = " UNION ALL ".join(f"SELECT '{m}' AS method, model_id, CASE WHEN sum(r) OVER () > 0 THEN r / sum(r) OVER () ELSE 1.0 / count(*) OVER () END AS weight "
                                 f"FROM (SELECT model_id, {e} AS r FROM f) x" for m, e in raw.items())
    return with_ctes(f"""
, o AS (SELECT row_id, model_id, proba, final_status FROM scores WHERE split = 'train'),
 f AS (SELECT model_id, {f1_sql()} AS f1 FROM (SELECT model_id, {confusion_sql("final_status", "CAST(proba > 0.5 AS INTEGER)")} FROM o GROUP BY model_id) c),
 w AS ({weights}),
 b AS (SELECT method, row_id, sum(weight * proba) / sum(weight) AS p, max(final_status) AS y FROM o JOIN w USING (model_id) GROUP BY 1, 2),
 c AS (SELECT method, {confusion_sql("y", "CAST(p > 0.5 AS INTEGER)")} FROM b GROUP BY 1),
 s AS (SELECT model_id, abs(corr(proba, CAST(final_status AS DOUBLE))) AS importance FROM o GROUP BY 1),
 m AS (SELECT DISTINCT method FROM w)
SELECT 'run-' || method AS run_id, section, name, round(value, 6) AS value FROM (
  SELECT method, 'flag' AS section, 'use_rank' AS name, CASE WHEN method = 'rank' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM m
  UNION ALL SELECT method, 'flag', 'blend_all', 1.0 FROM m
  UNION ALL SELECT method, 'metric', 'f1', {f1_sql()} FROM c
  UNION ALL SELECT method, 'metric', 'precision', CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fp) END FROM c
  UNION ALL SELECT method, 'metric', 'recall', CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fn) END FROM c
  UNION ALL SELECT method, 'importance', model_id, importance FROM m, s
  UNION ALL SELECT method, 'weight', model_id, weight FROM w) t""", "scores")


@query("io10_run_records", _run_facts_sql())
def io10_records(spark, sf):
    """All runs are written, then one is written again: its record is replaced, not doubled."""
    from stacksmith.operators.rank import cut
    runs = cut(_blend_runs(spark, sf), "runs")
    store = RU.RunStore(spark, ST.fresh_path(spark, "run-store"))
    store.put(runs)
    store.put(runs.filter("run_id = 'run-power'"))
    return store.facts().select("run_id", "section", "name", F.round("value", 6).alias("value"))


@query("io13_fingerprint_reuse", with_ctes("""
SELECT row_id, 0.5::DOUBLE AS threshold, CAST(proba > 0.5 AS INTEGER) AS vote, 2 AS fits FROM scores WHERE split = 'train' AND model_id = 'm4'
UNION ALL
SELECT row_id, 0.6::DOUBLE, CAST(proba > 0.6 AS INTEGER), 2 FROM scores WHERE split = 'train' AND model_id = 'm4'""", "scores"))
def io13_reuse(spark, sf):
    """The same rows and parameters are computed once, in whatever order the rows come; another parameter is computed anew."""
    from stacksmith.operators.rank import cut
    rows = cut(scores(spark, sf).filter((F.col("split") == "train") & (F.col("model_id") == "m4")).select("row_id", "proba"), "reuse-input")
    store = RU.ResultStore(spark, ST.fresh_path(spark, "results"))
    fits = []

    def votes(df, params):
        fits.append(params)
        return df.select("row_id", F.lit(params["threshold"]).alias("threshold"), (F.col("proba") > params["threshold"]).cast("int").alias("vote"))
    store.get_or_compute("votes", rows, {"threshold": 0.5}, votes)
    again = store.get_or_compute("votes", rows.repartition("row_id"), {"threshold": 0.5}, votes)
    other = store.get_or_compute("votes", rows, {"threshold": 0.6}, votes)
    return again.unionByName(other).withColumn("fits", F.lit(len(fits)))


@query("io13_meta_store_reuse", with_ctes("SELECT row_id, split, proba, model_id FROM scores WHERE split = 'train' AND model_id = 'm4'", "scores"))
def io13(spark, sf):
    s = scores(spark, sf).filter(F.col("split") == "train").select("row_id", "split", "model_id", "proba")
    store = ST.MetaStore(spark, ST.fresh_path(spark, "meta"))
    calls = []

    def compute():
        calls.append(1)
        return s.filter(F.col("model_id") == "m4").drop("model_id")
    store.get_or_compute("m4", compute)
    again = store.get_or_compute("m4", compute)   # second call reads the stored partition
    assert len(calls) == 1
    return again


@query("sc19_zero_padded_names", """
SELECT CAST(i AS INTEGER) AS dim, 'f06__' || lpad(CAST(i AS VARCHAR), 3, '0') || '__SentenceVec' AS name
FROM range(1, (SELECT max(len(embedding)) FROM embeddings) + 1) t(i)""")
def sc19(spark, sf):
    e = load(spark, sf, "embeddings")
    dims = e.agg(F.max(F.size("embedding")).alias("n")).select(F.explode(F.sequence(F.lit(1), F.col("n"))).alias("dim"))
    return dims.select(F.col("dim").cast("int").alias("dim"),
                       F.concat(F.lit("f06__"), F.lpad(F.col("dim").cast("string"), 3, "0"), F.lit("__SentenceVec")).alias("name"))

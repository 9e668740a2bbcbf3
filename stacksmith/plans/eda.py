"""Profiling, scalar-function, projection and set-operation queries
(ag01-ag10, ag13, ag15-ag17, sc*, pf*, so*, jn01)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacksmith.functions import scalars as S
from stacksmith.operators import profile as P
from stacksmith.plans.inputs import (
    RATES_SQL, projects, rates_frame, with_ctes,
)
from stacksmith.plans.registry import query
from stacksmith.sources.tables import load

TIME_COLS = ["created_at", "launched_at", "deadline", "state_changed_at"]


def goal_usd(spark: SparkSession, sf: str) -> DataFrame:
    """jn01: goal x rate[currency], unknown currency -> 1.0.  The rate table
    is a fixed 9-row literal, so broadcasting it is bounded."""
    p = projects(spark, sf)
    r = F.broadcast(rates_frame(spark))
    return (p.join(r, "currency", "left")
             .withColumn("usd_rate", F.coalesce(F.col("usd_rate"), F.lit(1.0)))
             .withColumn("goal_usd", F.col("goal") * F.col("usd_rate"))
             .withColumn("f01__goal", F.log1p("goal_usd")))


GOAL_USD_SQL = """
SELECT p.*, coalesce(r.usd_rate, 1.0) AS usd_rate_c, p.goal * coalesce(r.usd_rate, 1.0) AS goal_usd,
       ln(1 + p.goal * coalesce(r.usd_rate, 1.0)) AS f01__goal
FROM projects p LEFT JOIN rates r ON p.currency = r.currency
"""


def _g(body: str) -> str:
    return with_ctes(body.replace("FROM goal", f"FROM ({GOAL_USD_SQL}) goal"), "projects", "rates")


# ---------------------------------------------------------------- jn01 / ag03

@query("jn01_currency_lookup", _g(
    "SELECT row_id, currency, usd_rate_c AS usd_rate, round(f01__goal, 6) AS f01__goal FROM goal"))
def jn01(spark, sf):
    return goal_usd(spark, sf).select("row_id", "currency", "usd_rate", F.round("f01__goal", 6).alias("f01__goal"))


def rate_by_currency(spark, sf):
    g = goal_usd(spark, sf)
    # one aggregation: counts, rate, SE and the mean log goal together
    agg = g.groupBy("currency").agg(F.count(F.lit(1)).alias("n"),
                                    F.sum(F.col("final_status").cast("long")).alias("n_pos"),
                                    F.avg("f01__goal").alias("_mg"))
    p = F.col("n_pos") / F.col("n")
    out = agg.select("currency", "n", "n_pos", F.round(p, 6).alias("rate"),
                     F.round(F.sqrt(p * (1 - p) / F.col("n")), 6).alias("se"),
                     F.round("_mg", 6).alias("mean_log_goal"))
    return out.orderBy(F.desc("rate"), "currency")


@query("ag03_rate_se_by_currency", _g("""
SELECT currency, count(*) AS n, CAST(sum(final_status) AS BIGINT) AS n_pos,
       round(avg(final_status), 6) AS rate,
       round(sqrt(avg(final_status) * (1 - avg(final_status)) / count(*)), 6) AS se,
       round(avg(f01__goal), 6) AS mean_log_goal
FROM goal GROUP BY currency"""))
def ag03(spark, sf):
    return rate_by_currency(spark, sf)


# ---------------------------------------------------------------- ag01 / ag02

@query("ag01_value_counts_country", with_ctes(
    "SELECT country, count(*) AS n FROM projects GROUP BY country", "projects"))
def ag01(spark, sf):
    return P.value_counts(projects(spark, sf), "country")


@query("ag01_distinct_currency", with_ctes("SELECT DISTINCT currency FROM projects", "projects"))
def ag01b(spark, sf):
    return projects(spark, sf).select("currency").distinct()


@query("ag02_pivot_currency_label", with_ctes("""
SELECT currency, CAST(sum(CASE WHEN final_status = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_0,
       CAST(sum(CASE WHEN final_status = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_1
FROM projects GROUP BY currency""", "projects"))
def ag02(spark, sf):
    return P.pivot_count(projects(spark, sf), "currency", "final_status")


# ---------------------------------------------------------------- ag04 / ag05

@query("ag04_rate_by_year_month", with_ctes("""
SELECT strftime(make_timestamp(created_at * 1000000), '%Y-%m') AS ym, count(*) AS n,
       CAST(sum(final_status) AS BIGINT) AS n_pos, round(avg(final_status), 6) AS rate,
       round(sqrt(avg(final_status) * (1 - avg(final_status)) / count(*)), 6) AS se
FROM projects GROUP BY 1""", "projects"))
def ag04(spark, sf):
    p = projects(spark, sf).withColumn("ym", S.year_month(S.ntz_from_epoch("created_at")))
    return P.rate_table(p, "ym", "final_status")


@query("ag04_rate_by_year", with_ctes("""
SELECT CAST(year(make_timestamp(created_at * 1000000)) AS INTEGER) AS year, count(*) AS n,
       CAST(sum(final_status) AS BIGINT) AS n_pos, round(avg(final_status), 6) AS rate,
       round(sqrt(avg(final_status) * (1 - avg(final_status)) / count(*)), 6) AS se
FROM projects GROUP BY 1""", "projects"))
def ag04b(spark, sf):
    p = projects(spark, sf).withColumn("year", F.year(S.ntz_from_epoch("created_at")))
    return P.rate_table(p, "year", "final_status")


@query("ag05_rate_by_log_goal_bin", _g("""
SELECT CAST(ceil(f01__goal) AS INTEGER) AS bin, count(*) AS n, CAST(sum(final_status) AS BIGINT) AS n_pos,
       round(avg(final_status), 6) AS rate,
       round(sqrt(avg(final_status) * (1 - avg(final_status)) / count(*)), 6) AS se
FROM goal WHERE f01__goal > 0 AND f01__goal <= 20 GROUP BY 1"""))
def ag05(spark, sf):
    g = goal_usd(spark, sf).withColumn("bin", P.right_closed_unit_bin("f01__goal", 0, 20))
    return P.rate_table(g.filter(F.col("bin").isNotNull()), "bin", "final_status")


# ---------------------------------------------------------------- ag06 histograms

def _hist_sql(expr: str, n: int) -> str:
    return with_ctes(f"""
SELECT CAST(bin AS INTEGER) AS bin, round(lo + bin * ((hi - lo) / {n}), 6) AS lo,
       round(lo + (bin + 1) * ((hi - lo) / {n}), 6) AS hi, count(*) AS n
FROM (SELECT x, lo, hi, least(floor((x - lo) / (hi - lo) * {n}), {n - 1}) AS bin
      FROM (SELECT {expr} AS x FROM projects) v,
           (SELECT min({expr}) AS lo, max({expr}) AS hi FROM projects) m) b
GROUP BY bin, lo, hi""", "projects")


@query("ag06_histogram_goal_50", _hist_sql("CAST(goal AS DOUBLE)", 50))
def ag06(spark, sf):
    return P.histogram(projects(spark, sf), "goal", 50)


@query("ag06_histogram_log_goal_30", _hist_sql("ln(1 + goal)", 30))
def ag06b(spark, sf):
    return P.histogram(projects(spark, sf), "goal", 30, log1p=True)


# ---------------------------------------------------------------- ag07 / ag08

QS = ", ".join(str(i / 100) for i in range(1, 100))


@query("ag07_quantiles_log_goal_by_label", with_ctes(f"""
SELECT final_status, round(q, 6) AS q, round(value, 6) AS value FROM (
  SELECT final_status, unnest(CAST([{QS}] AS DOUBLE[])) AS q, unnest(quantile_cont(x, [{QS}])) AS value
  FROM (SELECT final_status, ln(1 + goal) AS x FROM projects) v GROUP BY final_status) t""", "projects"))
def ag07(spark, sf):
    p = projects(spark, sf).withColumn("x", F.log1p("goal"))
    return P.quantile_pairs(p, "x", "final_status")


@query("ag07_quantiles_train_vs_test", with_ctes(f"""
SELECT split, round(q, 6) AS q, round(value, 6) AS value FROM (
  SELECT split, unnest(CAST([{QS}] AS DOUBLE[])) AS q, unnest(quantile_cont(CAST(goal AS DOUBLE), [{QS}])) AS value
  FROM projects GROUP BY split) t""", "projects"))
def ag07b(spark, sf):
    return P.quantile_pairs(projects(spark, sf), "goal", "split")


def _describe_sql(cols):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS "column", count({x}) AS count, round(avg({x}), 6) AS mean,
  round(stddev_samp({x}), 6) AS std, min({x}) AS min, round(quantile_cont({x}, 0.25), 6) AS p25,
  round(quantile_cont({x}, 0.5), 6) AS p50, round(quantile_cont({x}, 0.75), 6) AS p75, max({x}) AS max
  FROM lineitem""")
    return "\nUNION ALL\n".join(parts)


DESCRIBE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("ag08_describe_lineitem", _describe_sql(DESCRIBE_COLS))
def ag08(spark, sf):
    return P.describe(load(spark, sf, "lineitem"), DESCRIBE_COLS)


@query("ag09_correlation_lineitem", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM lineitem"
    for a in DESCRIBE_COLS for b in DESCRIBE_COLS))
def ag09(spark, sf):
    return P.correlation_long(load(spark, sf, "lineitem"), DESCRIBE_COLS)


@query("ag10_positive_columns", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min_value, min({c}) > 0 AS strictly_positive FROM lineitem"
    for c in DESCRIBE_COLS))
def ag10(spark, sf):
    li = load(spark, sf, "lineitem")
    mins = li.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.min(F.col(c)).cast("double").alias("min_value"))
                            for c in DESCRIBE_COLS]).alias("m"))
    return (mins.select(F.explode("m").alias("m")).select("m.*")
                .withColumn("strictly_positive", F.col("min_value") > 0))


@query("ag13_class_balance", with_ctes("""
SELECT final_status, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS ratio,
       round(sum(count(*)) OVER () * 1.0 / (2 * count(*)), 6) AS balanced_weight,
       round(sum(CASE WHEN final_status = 0 THEN count(*) ELSE 0 END) OVER () * 1.0 /
             sum(CASE WHEN final_status = 1 THEN count(*) ELSE 0 END) OVER (), 6) AS neg_pos_ratio
FROM projects WHERE split = 'train' GROUP BY final_status""", "projects"))
def ag13(spark, sf):
    return P.class_balance(projects(spark, sf).filter(F.col("split") == "train"), "final_status")


@query("ag17_token_vocabulary", """
SELECT DISTINCT token FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS token FROM part) t WHERE token <> ''""")
def ag17(spark, sf):
    return P.token_vocabulary(load(spark, sf, "part").select(F.lower("p_name").alias("k")), "k", " ")


# ---------------------------------------------------------------- scalar functions

@query("sc01_log1p_goal", with_ctes("SELECT row_id, round(ln(1 + goal), 6) AS log1p_goal FROM projects", "projects"))
def sc01(spark, sf):
    return projects(spark, sf).select("row_id", F.round(F.log1p("goal"), 6).alias("log1p_goal"))


@query("sc02_ln_log10", """
SELECT l_orderkey, l_linenumber,
       round(CASE WHEN l_discount > 0 THEN ln(l_discount) END, 6) AS ln_discount,
       round(CASE WHEN l_extendedprice > 0 THEN log10(l_extendedprice) END, 6) AS log10_price
FROM lineitem""")
def sc02(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(S.safe_ln("l_discount"), 6).alias("ln_discount"),
                     F.round(S.safe_log10("l_extendedprice"), 6).alias("log10_price"))


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


DIFF_NAMES = [f"f02__diff__{a}__and__{b}" for a, b in _pairs(TIME_COLS)]


@query("sc03_time_diffs", with_ctes("SELECT row_id, " + ", ".join(
    f"{a} - {b} AS f02__diff__{a}__and__{b}" for a, b in _pairs(TIME_COLS)) + " FROM projects", "projects"))
def sc03(spark, sf):
    return S.time_diffs(projects(spark, sf), TIME_COLS).select("row_id", *DIFF_NAMES)


def _product_sql():
    base = [f"CAST({a} - {b} AS DOUBLE)" for a, b in _pairs(TIME_COLS)] + ["CAST(created_at AS DOUBLE)"]
    names = [n.replace("f02__diff__", "") for n in DIFF_NAMES] + ["datetime"]
    cols = [f"{base[i]} * {base[j]} AS \"f02__product__{names[i]}_X_{names[j]}\""
            for i in range(len(base)) for j in range(i + 1, len(base))]
    cols += [f"CAST(goal AS DOUBLE) * {base[i]} AS \"f02__product__goal_X_{names[i]}\"" for i in range(len(base))]
    return with_ctes("SELECT row_id, " + ", ".join(cols) + " FROM projects", "projects")


@query("sc04_time_products", _product_sql())
def sc04(spark, sf):
    p = S.time_diffs(projects(spark, sf), TIME_COLS).withColumn("datetime", F.col("created_at"))
    out = S.pairwise_products(p, DIFF_NAMES + ["datetime"], "goal")
    return out.select("row_id", *[c for c in out.columns if c.startswith("f02__product__")])


@query("sc05_ad_ratio", with_ctes("""
SELECT row_id, round(CASE WHEN deadline - created_at = 0 THEN NULL
       ELSE (launched_at - created_at) * 1.0 / (deadline - created_at) END, 6) AS f01__ADratio
FROM projects""", "projects"))
def sc05(spark, sf):
    p = projects(spark, sf)
    return p.select("row_id", F.round(S.ratio(F.col("launched_at") - F.col("created_at"),
                                              F.col("deadline") - F.col("created_at")), 6).alias("f01__ADratio"))


@query("sc06_epoch_roundtrip", with_ctes("""
SELECT row_id, make_timestamp(created_at * 1000000) AS created_ts,
       CAST(epoch(make_timestamp(created_at * 1000000)) AS BIGINT) AS created_back
FROM projects""", "projects"))
def sc06(spark, sf):
    p = projects(spark, sf).select("row_id", S.ntz_from_epoch("created_at").alias("created_ts"))
    return p.select("row_id", "created_ts",
                    F.unix_timestamp("created_ts").alias("created_back"))


@query("sc07_calendar_parts", with_ctes("""
SELECT row_id, CAST(year(t) AS INTEGER) AS year, CAST(quarter(t) AS INTEGER) AS quarter,
       CAST(year(t) AS VARCHAR) || 'Q' || CAST(quarter(t) AS VARCHAR) AS year_quarter,
       strftime(t, '%Y-%m') AS year_month
FROM (SELECT row_id, make_timestamp(created_at * 1000000) AS t FROM projects) p""", "projects"))
def sc07(spark, sf):
    t = S.ntz_from_epoch("created_at")
    return projects(spark, sf).select("row_id", F.year(t).alias("year"), F.quarter(t).alias("quarter"),
                                      S.year_quarter(t).alias("year_quarter"), S.year_month(t).alias("year_month"))


@query("sc08_after_date_flag", with_ctes("""
SELECT row_id, CAST(make_timestamp(launched_at * 1000000) >= TIMESTAMP '1998-07-01' AS INTEGER) AS f04__after_Jul1998
FROM projects""", "projects"))
def sc08(spark, sf):
    return projects(spark, sf).select(
        "row_id", S.after_date(S.ntz_from_epoch("launched_at"), "1998-07-01").alias("f04__after_Jul1998"))


@query("sc09_split_tokens", """
SELECT p_partkey, CAST(len(string_split(replace(lower(p_name), ' ', '-'), '-')) AS INTEGER) AS n_keywords,
       CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n_words
FROM part""")
def sc09(spark, sf):
    p = load(spark, sf, "part").withColumn("keywords", F.regexp_replace(F.lower("p_name"), " ", "-"))
    return p.select("p_partkey", F.size(F.split("keywords", "-")).alias("n_keywords"),
                    F.size(F.split("p_name", " ")).alias("n_words"))


@query("sc10_char_length", "SELECT doc_id, CAST(length(text) AS INTEGER) AS n_len FROM documents")
def sc10(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.length("text").alias("n_len"))


@query("sc11_strip_quotes", """
SELECT doc_id, md5(replace(coalesce(text, 'nan'), '"', '')) AS text_md5,
       CAST(length(replace(coalesce(text, 'nan'), '"', '')) AS INTEGER) AS n_len FROM documents""")
def sc11(spark, sf):
    t = S.strip_quotes("text")
    return load(spark, sf, "documents").select("doc_id", F.md5(t).alias("text_md5"), F.length(t).alias("n_len"))


@query("sc12_fill_null_zero", with_ctes("""
SELECT c.c_custkey, coalesce(o.n_orders, 0) AS n_orders
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) o
ON c.c_custkey = o.o_custkey""", "projects"))
def sc12(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey")
    o = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "n_orders").na.fill(0, ["n_orders"])


@query("sc13_lenient_parse", r"""
SELECT event_id, TRY_CAST(regexp_extract(props, ':\s*([^}]*)', 1) AS DOUBLE) AS k FROM events""")
def sc13(spark, sf):
    e = load(spark, sf, "events")
    return e.select("event_id", S.lenient_double(F.regexp_extract("props", r":\s*([^}]*)", 1)).alias("k"))


@query("sc14_round_half_even", """
SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS half_qty_even,
       round_even(l_extendedprice, -1) AS price_tens FROM lineitem""")
def sc14(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 2, 0).alias("half_qty_even"),
                     F.bround("l_extendedprice", -1).alias("price_tens"))


@query("sc15_pow_exp_minmax_clip", with_ctes("""
SELECT row_id, round(pow(x, 4), 6) AS x_pow4, round(exp(-x / 10), 6) AS x_exp,
       round((x - lo) / (hi - lo), 6) AS x_minmax, round(greatest(x - 12, 0), 6) AS x_clip
FROM (SELECT row_id, ln(1 + goal) AS x FROM projects) v,
     (SELECT min(ln(1 + goal)) AS lo, max(ln(1 + goal)) AS hi FROM projects) m""", "projects"))
def sc15(spark, sf):
    p = projects(spark, sf).select("row_id", F.log1p("goal").alias("x"))
    lo, hi = P.min_max(p, "x")
    return p.select("row_id", F.round(F.pow("x", 4), 6).alias("x_pow4"), F.round(F.exp(-F.col("x") / 10), 6).alias("x_exp"),
                    F.round(S.min_max_scale("x", lo, hi), 6).alias("x_minmax"),
                    F.round(F.greatest(F.col("x") - 12, F.lit(0.0)), 6).alias("x_clip"))


@query("sc18_sigmoid", with_ctes("""
SELECT row_id, round(1 / (1 + exp(-(ln(1 + goal) - 12))), 6) AS p1,
       round(1 - 1 / (1 + exp(-(ln(1 + goal) - 12))), 6) AS p0 FROM projects""", "projects"))
def sc18(spark, sf):
    p = projects(spark, sf)
    z = F.log1p("goal") - 12
    return p.select("row_id", F.round(S.sigmoid(z), 6).alias("p1"), F.round(1 - S.sigmoid(z), 6).alias("p0"))


# ---------------------------------------------------------------- projections / filters

@query("io02_column_pruned_scan", "SELECT l_orderkey, l_extendedprice FROM lineitem")
def io02(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice")


@query("pf01_select_by_prefix", "SELECT l_shipdate, l_extendedprice FROM lineitem")
def pf01(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.select(S.columns_like(li, prefix="l_ship") + S.columns_like(li, contains="price"))


@query("pf02_split_target", with_ctes(
    "SELECT row_id, goal, currency, created_at, final_status AS label FROM projects", "projects"))
def pf02(spark, sf):
    p = projects(spark, sf).select("row_id", "goal", "currency", "created_at", "final_status")
    return p.withColumnRenamed("final_status", "label")


@query("pf04_numeric_columns", "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def pf04(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.select(S.columns_of_type(li, "double"))


@query("pf05_mask_filter", with_ctes(
    "SELECT row_id, country, goal FROM projects WHERE final_status = 1 AND currency = 'GBP'", "projects"))
def pf05(spark, sf):
    p = projects(spark, sf)
    return p.filter((F.col("final_status") == 1) & (F.col("currency") == "GBP")).select("row_id", "country", "goal")


@query("pf10_casts", with_ctes("""
SELECT row_id, make_timestamp(created_at * 1000000) AS created_ts, CAST(disable_communication AS INTEGER) AS flag,
       CAST(CAST(goal AS FLOAT) AS DOUBLE) AS goal_f32 FROM projects""", "projects"))
def pf10(spark, sf):
    p = projects(spark, sf)
    return p.select("row_id", S.ntz_from_epoch("created_at").alias("created_ts"),
                    F.col("disable_communication").cast("int").alias("flag"),
                    F.col("goal").cast("float").cast("double").alias("goal_f32"))


@query("pf12_exclude_present_columns", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""")
def pf12(spark, sf):
    o = load(spark, sf, "orders")
    newer = load(spark, sf, "lineitem").select(F.col("l_shipdate").alias("o_orderdate"))
    return o.drop(*newer.columns)


@query("pf13_drop_raw_after_derive", with_ctes("""
SELECT row_id, ln(1 + goal) AS f01__goal_raw_log FROM projects""", "projects"))
def pf13(spark, sf):
    p = projects(spark, sf).withColumn("f01__goal_raw_log", F.log1p("goal"))
    return p.drop("goal", "country", "currency", *TIME_COLS, "disable_communication",
                  "final_status", "split")


# ---------------------------------------------------------------- set operations

@query("so02_token_union", """
SELECT DISTINCT token FROM (
  SELECT unnest(string_split(lower(p_name), ' ')) AS token FROM part
  UNION ALL SELECT lower(p_type) FROM part) t""")
def so02(spark, sf):
    p = load(spark, sf, "part")
    a = p.select(F.explode(F.split(F.lower("p_name"), " ")).alias("token"))
    return a.union(p.select(F.lower("p_type").alias("token"))).distinct()


@query("so03_intersect", """
SELECT DISTINCT o_custkey AS custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0""")
def so03(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"))
    c = load(spark, sf, "customer").filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("custkey"))
    return o.intersect(c)


@query("so04_difference", """
SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'""")
def so04(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey")
    o = load(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return c.subtract(o)

"""Stand-ins for the contest data, derived by Spark from the driver tables.

* a *project* is an order: goal = total price, country = customer nation,
  currency from the nation key, four epoch-second times from the order date
  and its line ship dates, label = order status 'F', train before 2000.
* an *interval* is a line: [order date, ship date] (often reversed).
* base-model scores are deterministic functions of (model, fold, row) and
  the label, so every blend, sweep and selection can be replayed in SQL.

Each builder has a SQL twin (a CTE body) used by the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stacksmith.functions.seeded import seeded_key, seeded_key_sql, unit_uniform, unit_uniform_sql
from stacksmith.operators.rank import rank_within
from stacksmith.sources.tables import load

# Currency code of a customer = CURRENCY_CODES[nation key mod 10];
# the last code has no rate and falls back to 1.0.
CURRENCY_CODES = ["USD", "GBP", "CAD", "AUD", "EUR", "NZD", "SEK", "DKK", "NOK", "MXN"]

# USD per unit of currency, May 2015 (unknown code -> 1.0).
USD_RATES = {
    "USD": 1.0,
    "GBP": 1.545,
    "CAD": 0.824,
    "AUD": 0.764,
    "EUR": 1.116,
    "NZD": 0.700,
    "SEK": 0.120,
    "DKK": 0.152,
    "NOK": 0.132,
}

SPLIT_DATE = "2000-01-01"
SEED = 42
N_FOLDS = 5
# Base models of the score table: how strongly each leans on the label.
MODEL_STRENGTH = {"m1": 0.15, "m2": 0.25, "m3": 0.35, "m4": 0.45, "m5": 0.30}


def epoch(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_timestamp(c)


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    li = (load(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
               F.count(F.lit(1)).alias("n_lines")))
    codes = F.array(*[F.lit(x) for x in CURRENCY_CODES])
    return (o.join(c, o.o_custkey == c.c_custkey)
            # nation has 25 rows at every scale: a fixed, proven bound.
            .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(li, o.o_orderkey == li.l_orderkey)
            .select(
                F.col("o_orderkey").alias("row_id"),
                F.col("o_totalprice").alias("goal"),
                F.col("n_name").alias("country"),
                F.element_at(codes, (F.col("c_nationkey") % 10 + 1).cast("int")).alias("currency"),
                epoch("o_orderdate").alias("created_at"),
                epoch("first_ship").alias("launched_at"),
                epoch("last_ship").alias("deadline"),
                (epoch("last_ship") + F.col("n_lines") * 86400).alias("state_changed_at"),
                (F.col("o_orderpriority") == "5-LOW").alias("disable_communication"),
                (F.col("o_orderstatus") == "F").cast("int").alias("final_status"),
                F.when(F.col("o_orderdate") < F.lit(SPLIT_DATE).cast("timestamp_ntz"), "train")
                 .otherwise("test").alias("split"),
            ))


def _sql_list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


PROJECTS_SQL = f"""
SELECT o.o_orderkey AS row_id,
       o.o_totalprice AS goal,
       n.n_name AS country,
       ({_sql_list(CURRENCY_CODES)})[c.c_nationkey % 10 + 1] AS currency,
       CAST(epoch(o.o_orderdate) AS BIGINT) AS created_at,
       CAST(epoch(l.first_ship) AS BIGINT) AS launched_at,
       CAST(epoch(l.last_ship) AS BIGINT) AS deadline,
       CAST(epoch(l.last_ship) AS BIGINT) + l.n_lines * 86400 AS state_changed_at,
       (o.o_orderpriority = '5-LOW') AS disable_communication,
       CAST(o.o_orderstatus = 'F' AS INTEGER) AS final_status,
       CASE WHEN o.o_orderdate < TIMESTAMP '{SPLIT_DATE}' THEN 'train' ELSE 'test' END AS split
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
             count(*) AS n_lines
      FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
"""


def rates_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(USD_RATES.items()), "currency string, usd_rate double")


RATES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', CAST({v} AS DOUBLE))" for k, v in sorted(USD_RATES.items())) + ") t(currency, usd_rate)"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One interval per line: [order date, ship date] in epoch seconds."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("l_orderkey").alias("row_id"), "l_linenumber",
                    epoch("o_orderdate").alias("start_ts"), epoch("l_shipdate").alias("end_ts"),
                    F.when(F.col("o_orderdate") < F.lit(SPLIT_DATE).cast("timestamp_ntz"), "train")
                     .otherwise("test").alias("split")))


INTERVALS_SQL = f"""
SELECT l.l_orderkey AS row_id, l.l_linenumber,
       CAST(epoch(o.o_orderdate) AS BIGINT) AS start_ts,
       CAST(epoch(l.l_shipdate) AS BIGINT) AS end_ts,
       CASE WHEN o.o_orderdate < TIMESTAMP '{SPLIT_DATE}' THEN 'train' ELSE 'test' END AS split
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""


def with_folds(df: DataFrame, k: int = N_FOLDS, seed=SEED, label: str = "final_status",
               key: str = "row_id") -> DataFrame:
    """Stratified k-fold id (wn02): rank within class of md5(seed:key), mod k."""
    keyed = df.withColumn("_sk", seeded_key(seed, key))
    ranked = rank_within(keyed, "_sk", key, [label], out="_rk")
    return ranked.withColumn("fold", ((F.col("_rk") - 1) % k).cast("int")).drop("_sk", "_rk")


def folds_sql(src: str, k: int = N_FOLDS, seed=SEED, label: str = "final_status",
              key: str = "row_id") -> str:
    return (f"SELECT *, CAST((row_number() OVER (PARTITION BY {label} ORDER BY "
            f"{seeded_key_sql(seed, key)}, {key}) - 1) % {k} AS INTEGER) AS fold FROM {src}")


def _proba(model: str, strength: float, fold: Column, row: Column, label: Column) -> Column:
    u = unit_uniform(F.md5(F.concat_ws(":", F.lit(model), fold.cast("string"), row.cast("string"))))
    return F.round(F.lit(strength) * label.cast("double") + F.lit(1.0 - strength) * u, 6)


def _proba_sql(model: str, strength: float, fold: str, row: str, label: str) -> str:
    u = unit_uniform_sql(f"md5('{model}:' || CAST({fold} AS VARCHAR) || ':' || CAST({row} AS VARCHAR))")
    return (f"round(CAST({strength} AS DOUBLE) * CAST({label} AS DOUBLE) + "
            f"CAST({1.0 - strength} AS DOUBLE) * {u}, 6)")


def scores(spark: SparkSession, sf_dir: str, split: str | None = None) -> DataFrame:
    """Long score table ``(row_id, split, model_id, fold, proba, final_status)``.

    Train rows carry their out-of-fold score (one row per model); test rows
    one score per fold model.  With ``split`` only that part is built.
    """
    p = projects(spark, sf_dir).select("row_id", "split", "final_status")
    parts = []
    if split != "test":
        parts.append(with_folds(p.filter(F.col("split") == "train")))
    if split != "train":
        parts.append(p.filter(F.col("split") == "test")
                     .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(N_FOLDS - 1)))))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    models = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s).alias("s"))
                       for m, s in MODEL_STRENGTH.items()])
    out = rows.withColumn("_ms", F.explode(models))
    proba = None
    for m, s in MODEL_STRENGTH.items():
        e = _proba(m, s, F.col("fold"), F.col("row_id"), F.col("final_status"))
        proba = F.when(F.col("_ms.m") == m, e) if proba is None else proba.when(F.col("_ms.m") == m, e)
    return out.select("row_id", "split", F.col("_ms.m").alias("model_id"), "fold",
                      proba.alias("proba"), "final_status")


def scores_sql() -> str:
    cases = " ".join(f"WHEN m.model_id = '{m}' THEN {_proba_sql(m, s, 'r.fold', 'r.row_id', 'r.final_status')}"
                     for m, s in MODEL_STRENGTH.items())
    models = ", ".join(f"('{m}')" for m in MODEL_STRENGTH)
    return f"""
SELECT r.row_id, r.split, m.model_id, r.fold, CASE {cases} END AS proba, r.final_status
FROM (
  SELECT row_id, split, final_status, fold FROM ({folds_sql("(SELECT row_id, split, final_status FROM projects WHERE split = 'train')")})
  UNION ALL
  SELECT p.row_id, p.split, p.final_status, CAST(f.fold AS INTEGER) AS fold
  FROM projects p, (SELECT range AS fold FROM range({N_FOLDS})) f WHERE p.split = 'test'
) r, (VALUES {models}) m(model_id)
"""


def with_ctes(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs it needs (projects, intervals, rates, scores)."""
    defs = {
        "projects": PROJECTS_SQL,
        "intervals": INTERVALS_SQL,
        "rates": RATES_SQL,
        "scores": None,
    }
    parts = []
    need = list(names)
    if "scores" in need and "projects" not in need:
        need.insert(0, "projects")
    for nm in need:
        sql = scores_sql() if nm == "scores" else defs[nm]
        parts.append(f"{nm} AS ({sql})")
    return "WITH " + ",\n".join(parts) + "\n" + body

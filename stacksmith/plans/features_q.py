"""Feature-engineering queries (fe01-fe05, fe07-fe09, fe16, fe17, pf03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stacksmith.functions import scalars as S
from stacksmith.operators import features as FE
from stacksmith.plans.inputs import CURRENCY_CODES, USD_RATES, projects, rates_frame, with_ctes
from stacksmith.plans.registry import query
from stacksmith.sources.tables import load

# The oracle needs the training vocabularies written out.  They follow from
# the data's rules: nations are NATION_<k> for k < 25, the currency codes are
# ours, and training orders fall in 1995Q1..1999Q4 (split at 2000-01-01).
NATIONS = [f"NATION_{k}" for k in range(25)]
TRAIN_QUARTERS = [f"{y}Q{q}" for y in range(1995, 2000) for q in range(1, 5)]


def _train(p):
    return p.filter(F.col("split") == "train")


def _onehot_sql(col: str, values, prefix="f03", expr: str | None = None) -> list[str]:
    e = expr or col
    return [f'CASE WHEN {e} = \'{v}\' THEN 1 ELSE 0 END AS "{prefix}__{col}__{v}"' for v in sorted(values)]


YQ_SQL = "(CAST(year(make_timestamp(created_at * 1000000)) AS VARCHAR) || 'Q' || CAST(quarter(make_timestamp(created_at * 1000000)) AS VARCHAR))"


@query("fe01_one_hot_train_vocab", with_ctes("SELECT row_id, " + ", ".join(
    _onehot_sql("country", NATIONS) + _onehot_sql("currency", CURRENCY_CODES)) + " FROM projects WHERE split = 'test'", "projects"))
def fe01(spark, sf):
    p = projects(spark, sf)
    tr = _train(p)
    oh = FE.OneHot.fit_many(tr, [("country", F.col("country"), "f03"), ("currency", F.col("currency"), "f03")])
    return p.filter(F.col("split") == "test").select("row_id", *[c for o in oh for c in o.columns()])


@query("fe02_year_quarter_one_hot", with_ctes("SELECT row_id, " + ", ".join(
    _onehot_sql("year_quarter", TRAIN_QUARTERS, "f04", YQ_SQL)) + " FROM projects", "projects"))
def fe02(spark, sf):
    p = projects(spark, sf).withColumn("year_quarter", S.year_quarter(S.ntz_from_epoch("created_at")))
    oh = FE.OneHot.fit(_train(p), "year_quarter", "f04")
    return p.select("row_id", *oh.columns())


@query("fe03_inverse_one_hot", with_ctes(f"""
SELECT row_id, CASE WHEN split = 'train' THEN {YQ_SQL} END AS year_quarter FROM projects""", "projects"))
def fe03(spark, sf):
    p = projects(spark, sf).withColumn("year_quarter", S.year_quarter(S.ntz_from_epoch("created_at")))
    oh = FE.OneHot.fit(_train(p), "year_quarter", "f04")
    wide = p.select("row_id", *oh.columns())
    return wide.select("row_id", FE.inverse_one_hot(oh.names(), oh.vocab).alias("year_quarter"))


@query("fe04_label_encoding", with_ctes(f"""
SELECT p.row_id, CAST(coalesce(v.idx, (SELECT count(DISTINCT {YQ_SQL}) FROM projects WHERE split = 'train')) AS DOUBLE) AS yq_index
FROM projects p LEFT JOIN (
  SELECT yq, dense_rank() OVER (ORDER BY yq) - 1 AS idx FROM (SELECT DISTINCT {YQ_SQL} AS yq FROM projects WHERE split = 'train') d
) v ON {YQ_SQL.replace('created_at', 'p.created_at')} = v.yq""", "projects"))
def fe04(spark, sf):
    p = projects(spark, sf).withColumn("yq", S.year_quarter(S.ntz_from_epoch("created_at")))
    enc = FE.label_encoder(_train(p), "yq", "yq_index")
    return enc.transform(p).select("row_id", "yq_index")


@query("fe05_keyword_multi_hot_long", """
SELECT DISTINCT p_partkey, token FROM (
  SELECT p_partkey, unnest(string_split(replace(lower(p_name), ' ', '-'), '-')) AS token FROM part) t WHERE token <> ''""")
def fe05(spark, sf):
    p = load(spark, sf, "part").withColumn("keywords", F.regexp_replace(F.lower("p_name"), " ", "-"))
    toks = p.select("p_partkey", F.explode(F.array_distinct(F.split("keywords", "-"))).alias("token"))
    return toks.filter(F.col("token") != "")


STD_COLS = ["goal", "created_at", "deadline"]


@query("fe07_standardize_train_stats", with_ctes("SELECT p.row_id, " + ", ".join(
    f"round(CASE WHEN s.sd_{c} = 0 THEN 0.0 ELSE (CAST(p.{c} AS DOUBLE) - s.m_{c}) / s.sd_{c} END, 6) AS z_{c}" for c in STD_COLS)
    + " FROM projects p, (SELECT " + ", ".join(
    f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS sd_{c}" for c in STD_COLS)
    + " FROM projects WHERE split = 'train') s", "projects"))
def fe07(spark, sf):
    p = projects(spark, sf)
    st = FE.Standardizer.fit(_train(p), STD_COLS)
    return p.select("row_id", *[F.round(st.column(c), 6).alias(f"z_{c}") for c in STD_COLS])


@query("fe08_group_scaling", with_ctes("""
SELECT p.row_id,
  round(CASE WHEN s.sd = 0 THEN 0.0 ELSE (p.goal - s.m) / s.sd END, 6) AS goal,
  round(CASE WHEN r.q3 - r.q1 = 0 THEN 0.0 ELSE (CAST(p.created_at AS DOUBLE) - r.med) / (r.q3 - r.q1) END, 6) AS created_at,
  round(CASE WHEN x.hi - x.lo = 0 THEN 0.0 ELSE (CAST(p.deadline AS DOUBLE) - x.lo) / (x.hi - x.lo) END, 6) AS deadline
FROM projects p,
  (SELECT avg(goal) AS m, stddev_pop(goal) AS sd FROM projects WHERE split = 'train') s,
  (SELECT quantile_cont(CAST(created_at AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(created_at AS DOUBLE), 0.5) AS med,
          quantile_cont(CAST(created_at AS DOUBLE), 0.75) AS q3 FROM projects WHERE split = 'train') r,
  (SELECT CAST(min(deadline) AS DOUBLE) AS lo, CAST(max(deadline) AS DOUBLE) AS hi FROM projects WHERE split = 'train') x""",
    "projects"))
def fe08(spark, sf):
    p = projects(spark, sf)
    gs = FE.GroupScaler.fit(_train(p), {"standard": ["goal"], "robust": ["created_at"], "minmax": ["deadline"]})
    out = gs.transform(p.select("row_id", "goal", "created_at", "deadline"))
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in ["goal", "created_at", "deadline"]])


LOG_CANDIDATES = ["goal", "created_at", "diff_launch", "n_days"]


def _log_frame(spark, sf):
    p = projects(spark, sf)
    return p.select("row_id", "split", "goal", "created_at",
                    (F.col("launched_at") - F.col("created_at")).alias("diff_launch"),
                    ((F.col("deadline") - F.col("launched_at")) / 86400).alias("n_days"))


@query("fe09_log_positive_columns", with_ctes("""
SELECT row_id, """ + ", ".join(
    f"round(CASE WHEN (SELECT min({c}) FROM f WHERE split = 'train') > 0 THEN "
    + (f"ln(CAST({c} AS DOUBLE))" if c != "created_at" else "NULL")
    + f" ELSE CAST({c} AS DOUBLE) END, 6) AS {c}" if c != "created_at" else f"CAST({c} AS DOUBLE) AS {c}"
    for c in LOG_CANDIDATES) + """ FROM f""", "projects").replace(
    "\nSELECT row_id,", """, f AS (SELECT row_id, split, goal, created_at, launched_at - created_at AS diff_launch,
  (deadline - launched_at) / 86400.0 AS n_days FROM projects)
SELECT row_id,""", 1))
def fe09(spark, sf):
    f = _log_frame(spark, sf)
    lp = FE.LogPositive.fit(_train(f), LOG_CANDIDATES, exclude=["created_at"])
    out = lp.transform(f.drop("split"))
    return out.select("row_id", *[F.round(F.col(c).cast("double"), 6).alias(c) if c in lp.cols
                                  else F.col(c).cast("double").alias(c) for c in LOG_CANDIDATES])


@query("fe16_flag_passthrough", with_ctes(
    "SELECT row_id, disable_communication AS f05__disable_communication FROM projects", "projects"))
def fe16(spark, sf):
    return projects(spark, sf).select("row_id", F.col("disable_communication").alias("f05__disable_communication"))


@query("pf03_align_to_train_columns", with_ctes("SELECT row_id, " + ", ".join(
    _onehot_sql("currency", [c for c in CURRENCY_CODES if c != "USD"]) + ['0 AS "f03__currency__USD"'])
    + " FROM projects WHERE split = 'test'", "projects"))
def pf03(spark, sf):
    p = projects(spark, sf)
    train_cols = FE.OneHot.fit(_train(p), "currency").names()
    test = p.filter(F.col("split") == "test")
    own = FE.OneHot.fit(test.filter(F.col("currency") != "USD"), "currency")   # test's own, partial vocabulary
    wide = test.select("row_id", *own.columns(), F.lit(7).alias("f03__currency__ZZZ"))
    return FE.align_columns(wide, ["row_id"] + train_cols)


def build_features(spark, sf):
    # The build reads the projects several times (vocabularies, training
    # intervals, the rows themselves): write them once to the shared folder.
    from stacksmith.operators.rank import cut
    p = cut(projects(spark, sf))
    train, test = _train(p), p.filter(F.col("split") == "test")
    model = FE.ProjectFeatures.fit(train, rates_frame(spark))
    return model.transform(p, F.col("split") == "train"), model


def _fe17_sql() -> str:
    tp = FE.time_pairs()
    diffs = [f"{a} - {b} AS f02__diff__{a}__and__{b}" for a, b in tp]
    dbl = [f"CAST({a} - {b} AS DOUBLE)" for a, b in tp] + ["CAST(launched_at AS DOUBLE)"]
    short = [f"{a}__and__{b}" for a, b in tp] + ["datetime"]
    prods = [f"{dbl[i]} * {dbl[j]} AS f02__product__{short[i]}_X_{short[j]}" for i in range(7) for j in range(i + 1, 7)]
    prods += [f"CAST(goal AS DOUBLE) * {dbl[i]} AS f02__product__goal_X_{short[i]}" for i in range(7)]
    rates = " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in USD_RATES.items())
    cols = (["row_id", "final_status", "f07__concurrent_projects", "round(f01__goal, 6) AS f01__goal",
             "CASE WHEN deadline - created_at = 0 THEN NULL ELSE CAST(launched_at - created_at AS DOUBLE) / CAST(deadline - created_at AS DOUBLE) END AS f01__ADratio"]
            + diffs + prods + _onehot_sql("country", NATIONS) + _onehot_sql("currency", CURRENCY_CODES)
            + ["CAST(make_timestamp(launched_at * 1000000) >= TIMESTAMP '1998-07-01' AS INTEGER) AS f04__after_date",
               "launched_at AS f04__datetime"]
            + _onehot_sql("year_quarter", TRAIN_QUARTERS, "f04", YQ_SQL)
            + ["disable_communication AS f05__disable_communication"])
    return with_ctes(f"""
, iv AS (SELECT row_id, split, least(launched_at, deadline) AS s, greatest(launched_at, deadline) AS e FROM projects),
 conc AS (
  SELECT a.row_id, CAST(count(b.row_id) - CASE WHEN a.split = 'train' THEN 1 ELSE 0 END AS BIGINT) AS f07__concurrent_projects
  FROM iv a LEFT JOIN (SELECT * FROM iv WHERE split = 'train') b ON b.s <= a.e AND b.e >= a.s
  GROUP BY a.row_id, a.split),
 base AS (
  SELECT p.*, c.f07__concurrent_projects,
         ln(1 + p.goal * coalesce(CASE p.currency {rates} END, 1.0)) AS f01__goal
  FROM projects p JOIN conc c ON p.row_id = c.row_id)
SELECT {", ".join(cols)} FROM base""", "projects").replace(")\n, iv AS", "),\n iv AS")


@query("fe17_feature_build", _fe17_sql())
def fe17(spark, sf):
    return build_features(spark, sf)[0]


def _sparse_sql() -> str:
    cats = ["country", "currency", "customer"]
    vocab = " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS value FROM (SELECT DISTINCT {c} FROM p WHERE split = 'train' AND {c} IS NOT NULL) t" for c in cats)
    found = " UNION ALL ".join(f"SELECT p.row_id, x.at AS position, 1.0::DOUBLE AS value FROM p JOIN placed x ON x.c = '{c}' AND x.value = p.{c}" for c in cats)
    return with_ctes(f"""
, p AS (SELECT r.row_id, r.split, r.goal, r.country, r.currency, r.disable_communication, CAST(o.o_custkey AS VARCHAR) AS customer
       FROM projects r JOIN orders o ON o.o_orderkey = r.row_id),
 v AS (SELECT c, value, row_number() OVER (PARTITION BY c ORDER BY md5(value), value) - 1 AS idx FROM ({vocab}) u),
 n AS (SELECT c, count(*) AS n FROM v GROUP BY c),
 placed AS (SELECT v.c, v.value, CAST(2 + v.idx + (SELECT coalesce(sum(n.n), 0) FROM n WHERE n.c < v.c) AS INTEGER) AS at FROM v)
SELECT row_id, CAST(0 AS INTEGER) AS position, goal AS value FROM p WHERE goal <> 0
UNION ALL SELECT row_id, 1, 1.0 FROM p WHERE disable_communication
UNION ALL {found}""", "projects")


@query("fe17_sparse_features", _sparse_sql())
def fe17_sparse(spark, sf):
    """Numbers and the dummies of country, currency and customer as one sparse vector; returned entry by entry."""
    from stacksmith.operators.rank import cut
    from stacksmith.operators.sparse import SparseFeatures, entries
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").cast("string").alias("customer"))
    p = cut(projects(spark, sf).select("row_id", "split", "goal", "country", "currency", "disable_communication").join(orders, "row_id"), "sparse-input")
    model = SparseFeatures.fit(p.filter(F.col("split") == "train"), ["goal", "disable_communication"],
                               {c: F.col(c) for c in ("country", "currency", "customer")})
    return model.transform(p).select("row_id", F.explode(entries("features")).alias("e")).select("row_id", "e.*")


def _schema_sql() -> str:
    names = {s: f"SELECT DISTINCT 'f04__year_quarter__' || {YQ_SQL} AS name FROM projects WHERE split = '{s}'" for s in ("train", "test")}
    return with_ctes(f"""
SELECT name, 'missing' AS difference, 'int' AS fitted_type, NULL::VARCHAR AS found_type FROM ({names['train']} EXCEPT {names['test']}) a
UNION ALL SELECT name, 'extra', NULL, 'int' FROM ({names['test']} EXCEPT {names['train']}) b
UNION ALL SELECT 'goal', 'retyped', 'double', 'string'""", "projects")


@query("so05_schema_differences", _schema_sql())
def so05_differences(spark, sf):
    """The schema stored at fit against test rows one-hot by a vocabulary of their own, with a number read as text."""
    from stacksmith.operators.rank import cut
    from stacksmith.operators.schema import FittedSchema
    from stacksmith.sources.store import fresh_path
    p = cut(projects(spark, sf).select("row_id", "split", "goal", S.year_quarter(S.ntz_from_epoch("created_at")).alias("year_quarter")), "schema-input")
    train, test = _train(p), p.filter(F.col("split") == "test")

    def built(rows, goal):
        return rows.select("row_id", goal, *FE.OneHot.fit(rows, "year_quarter", "f04").columns())
    fitted = FittedSchema.fit(built(train, F.col("goal")), fresh_path(spark, "fitted-schema"))
    return fitted.differences(built(test, F.col("goal").cast("string").alias("goal")))

"""Registered queries of the engine and, where SQL can state them, their equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from absorbia.functions import dist, kernels
from absorbia.operators import checks, groups, levels, resampling, sample
from absorbia.operators.absorb import residualize
from absorbia.operators.effects import diagnose, recover, recover_slopes
from absorbia.operators.iv import iv
from absorbia.operators.ols import ols
from absorbia.operators.poisson import ivppml, ppml, separated_rows
from absorbia.operators.results import predict
from absorbia.operators.session import Session
from absorbia.plans.factors import base_level, design, fv
from absorbia.plans.specs import fe
from absorbia.sources.cache import ResultStore
from absorbia.sources.readers import read
from absorbia.sources.scratch import shared_folder
from absorbia.streaming import windowed_moments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _coefs(spark: SparkSession, rows: list[tuple], digits: int = 6) -> DataFrame:
    """(term, estimate, std_error) rounded."""
    return spark.createDataFrame([(t, float(b), float(s)) for t, b, s in rows], "term string, estimate double, std_error double").select("term", F.round("estimate", digits).alias("estimate"), F.round("std_error", digits).alias("std_error"))


def _of(result) -> list[tuple]:
    return list(zip(result.names, result.beta, result.se))


def _value(spark: SparkSession, values: dict[str, float], digits: int = 6) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in values.items()], "name string, value double").select("name", F.round("value", digits).alias("value"))


# --- sources, checks, weights ----------------------------------------------------------------


@query("SELECT 'error' AS level, 'input.dtype' AS code, 'l_returnflag' AS \"column\", CAST(1 AS BIGINT) AS count UNION ALL SELECT 'error', 'input.negative_outcome', 'c_gap', (SELECT count(*) FROM lineitem WHERE l_quantity - 25 < 0)")
def preflight_report(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem").withColumn("c_gap", F.col("l_quantity") - 25)
    return checks.preflight(df, {"outcome": ["c_gap"], "regressor": ["l_discount", "l_returnflag"], "cluster": ["l_suppkey"], "fixed_effect": ["l_partkey"]}, poisson=True, strict=True)


@query("SELECT event_id, user_id, round(ln(value), 9) AS log_value FROM events WHERE value > 0 AND user_id IS NOT NULL")
def valid_sample(spark, sf_dir):
    df = _t(spark, sf_dir, "events").withColumn("log_value", F.log("value"))
    return checks.valid_sample(df, ["log_value", "user_id"]).select("event_id", "user_id", F.round("log_value", 9).alias("log_value"))


@query("SELECT l_orderkey, l_linenumber, round((1 + l_tax) * count(*) OVER () / sum(1 + l_tax) OVER (), 9) AS w FROM lineitem")
def weights_normalised(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem").withColumn("aw", 1 + F.col("l_tax"))
    return checks.weights_normalised(df, "aw", "aweight")[0].select("l_orderkey", "l_linenumber", F.round("_w", 9).alias("w"))


# --- levels ----------------------------------------------------------------------------------


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
def level_codes(spark, sf_dir):
    return levels.encode(_t(spark, sf_dir, "customer"), ["c_mktsegment"]).select("c_custkey", F.col("code").cast("long").alias("code"))


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderstatus, o_orderpriority) - 1 AS code FROM orders")
def interaction_codes(spark, sf_dir):
    return levels.encode(_t(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", F.col("code").cast("long").alias("code"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def interaction_cells(spark, sf_dir):
    return levels.cells(_t(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""SELECT 'supplier in nation' AS relation, (SELECT bool_and(n = 1) FROM (SELECT count(DISTINCT s_nationkey) n FROM supplier GROUP BY s_suppkey)) AS holds
UNION ALL SELECT 'nation in supplier', (SELECT bool_and(n = 1) FROM (SELECT count(DISTINCT s_suppkey) n FROM supplier GROUP BY s_nationkey))
UNION ALL SELECT 'nation in region', (SELECT bool_and(n = 1) FROM (SELECT count(DISTINCT n_regionkey) n FROM nation GROUP BY n_nationkey))""")
def refinement(spark, sf_dir):
    s, n = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "nation")
    rows = [("supplier in nation", levels.is_refinement(s, ["s_suppkey"], ["s_nationkey"])), ("nation in supplier", levels.is_refinement(s, ["s_nationkey"], ["s_suppkey"])), ("nation in region", levels.is_refinement(n, ["n_nationkey"], ["n_regionkey"]))]
    return spark.createDataFrame(rows, "relation string, holds boolean")


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, min('a:' || s_suppkey) OVER (PARTITION BY s_nationkey) AS component FROM supplier)
SELECT 'a' AS side, CAST(s_suppkey AS VARCHAR) AS level, component FROM s UNION SELECT 'b', CAST(s_nationkey AS VARCHAR), component FROM s""")
def components_two_way(spark, sf_dir):
    return levels.components(_t(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey")


def _peel_sql(outcome: str | None, rounds: int = 14) -> str:
    parts = ["e0 AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, event_type, hour(ts) AS hr, CASE WHEN value > 60 THEN 1 ELSE 0 END AS y FROM events)"]
    lone = "count(*) = 1" if outcome is None else "max(y) <= 0 OR count(*) = 1"
    for i in range(rounds):
        parts.append(f"e{2 * i + 1} AS (SELECT * FROM e{2 * i} WHERE (user_id, day, hr) NOT IN (SELECT (user_id, day, hr) FROM e{2 * i} GROUP BY user_id, day, hr HAVING {lone}))")
        parts.append(f"e{2 * i + 2} AS (SELECT * FROM e{2 * i + 1} WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM e{2 * i + 1} GROUP BY user_id, event_type HAVING {lone}))")
    return f"WITH {', '.join(p.replace(' AS (', ' AS MATERIALIZED (', 1) for p in parts)} SELECT event_id, user_id FROM e{2 * rounds}"


def _events(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type", F.hour("ts").alias("hr"), F.when(F.col("value") > 60, 1.0).otherwise(0.0).alias("y"))


_PEEL = [fe("user_id", "day", "hr"), fe("user_id", "event_type")]


@query(_peel_sql(None))
def singleton_peel(spark, sf_dir):
    return sample.prune(_events(spark, sf_dir), _PEEL)[0].select("event_id", "user_id")


@query(_peel_sql("y"))
def zero_outcome_peel(spark, sf_dir):
    return sample.prune(_events(spark, sf_dir), _PEEL, outcome="y")[0].select("event_id", "user_id")


@query("""WITH c AS (SELECT count(DISTINCT c_nationkey) AS n, count(DISTINCT c_mktsegment) AS s, count(DISTINCT (c_nationkey, c_mktsegment)) AS b FROM customer)
SELECT unnest(['pairwise', 'firstpair', 'none', 'exact']) AS method, CAST(unnest([n + s + b - 1 - greatest(n, s), n + s + b - 2, n + s + b - 2, b]) AS BIGINT) AS df_absorbed FROM c""")
def absorbed_dof_exact(spark, sf_dir):
    s = _t(spark, sf_dir, "customer")
    rows = []
    for method in ("pairwise", "firstpair", "none", "exact"):
        info = levels.absorbed_dof(s, [fe("c_nationkey"), fe("c_mktsegment"), fe("c_nationkey", "c_mktsegment")], method=method)
        rows.append((method, info["df_absorbed"]))
    return spark.createDataFrame(rows, "method string, df_absorbed long")


# --- projection ------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey), 4) AS r FROM lineitem")
def within_oneway(spark, sf_dir):
    out, _ = residualize(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"), [fe("l_suppkey")], ["l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", F.round("l_extendedprice_r", 4).alias("r"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice - sum((1 + l_tax) * l_extendedprice) OVER (PARTITION BY l_suppkey) / sum(1 + l_tax) OVER (PARTITION BY l_suppkey), 4) AS r FROM lineitem")
def within_weighted(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", (1 + F.col("l_tax")).alias("aw"))
    out, _ = residualize(df, [fe("l_suppkey")], ["l_extendedprice"], "aw")
    return out.select("l_orderkey", "l_linenumber", F.round("l_extendedprice_r", 4).alias("r"))


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice - (avg_y + b * (l_quantity - avg_x)), 3) AS r FROM lineitem
JOIN (SELECT l_suppkey, avg(l_extendedprice) avg_y, avg(l_quantity) avg_x, covar_pop(l_extendedprice, l_quantity) / var_pop(l_quantity) b FROM lineitem GROUP BY 1) USING (l_suppkey)""")
def within_slope(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    out, _ = residualize(df, [fe("l_suppkey", slopes="l_quantity")], ["l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", F.round("l_extendedprice_r", 3).alias("r"))


def _two_way_sql(final: str, sweeps: int = 20) -> str:
    parts = ["s0 AS MATERIALIZED (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice AS y, l_quantity AS x1, l_discount AS x2 FROM lineitem)"]
    for i in range(sweeps):
        for k, key in enumerate(("l_suppkey", "l_partkey")):
            src, name = f"s{2 * i + k}", f"s{2 * i + k + 1}"
            parts.append(f"{name} AS MATERIALIZED (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {key}) AS {c}" for c in ("y", "x1", "x2")) + f" FROM {src})")
    return f"WITH {', '.join(parts)} {final.replace('LAST', f's{2 * sweeps}')}"


@query(_two_way_sql("SELECT l_orderkey, l_linenumber, round(y, 2) AS r FROM LAST"))
def within_two_way(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    out, _ = residualize(df, [fe("l_suppkey"), fe("l_partkey")], ["l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", F.round("l_extendedprice_r", 2).alias("r"))


# --- least squares ----------------------------------------------------------------------------

_ONE = "w AS (SELECT l_suppkey, l_partkey, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS y, l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS x FROM lineitem), b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS g, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS p FROM w), e AS (SELECT l_suppkey, l_partkey, x * (y - b * x) AS s, y - b * x AS e FROM w, b)"


def _one_sql(se: str) -> str:
    return f"WITH {_ONE} SELECT 'l_quantity' AS term, round(b, 6) AS estimate, round(sqrt({se}) / sxx, 6) AS std_error FROM b"


def _one(spark, sf_dir, **kw):
    return ols(_t(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", "l_suppkey", **kw)


@query(_one_sql("sxx * (SELECT sum(e * e) FROM e) / (n - 1 - g)"))
def ols_oneway_iid(spark, sf_dir):
    return _coefs(spark, _of(_one(spark, sf_dir)))


@query(_one_sql("(SELECT sum(s * s) FROM e) * n / (n - 1 - g)"))
def ols_oneway_robust(spark, sf_dir):
    return _coefs(spark, _of(_one(spark, sf_dir, vce="robust")))


@query(_one_sql("(SELECT sum(t * t) FROM (SELECT sum(s) t FROM e GROUP BY l_suppkey)) * (n - 1) / (n - 2) * g / (g - 1)"))
def ols_oneway_cluster(spark, sf_dir):
    return _coefs(spark, _of(_one(spark, sf_dir, cluster="l_suppkey")))


@query(_one_sql("((SELECT sum(t * t) FROM (SELECT sum(s) t FROM e GROUP BY l_suppkey)) + (SELECT sum(t * t) FROM (SELECT sum(s) t FROM e GROUP BY l_partkey)) - (SELECT sum(t * t) FROM (SELECT sum(s) t FROM e GROUP BY l_suppkey, l_partkey))) * (n - 1) / (n - 2) * least(g, p) / (least(g, p) - 1)"))
def ols_oneway_two_clusters(spark, sf_dir):
    return _coefs(spark, _of(_one(spark, sf_dir, cluster=["l_suppkey", "l_partkey"])))


_WEIGHTED = [("aweight iid", "aw", None), ("aweight robust", "aw", "robust"), ("pweight", "aw", None), ("fweight iid", "l_linenumber", None), ("fweight robust", "l_linenumber", "robust")]


def _weighted_sql(label: str, column: str, vce: str | None) -> str:
    counted = label.startswith("fweight")
    weight, scale, n = ("l_linenumber", "1", "s") if counted else ("1 + l_tax", "c / s", "c")
    iid = vce is None and label != "pweight"
    meat = "sum(w * e * e) * any_value(sxx)" if iid else "sum(w * x * x * e * e)" if counted else "sum(w * w * x * x * e * e)"
    factor = f"1.0 / ({n} - 1 - g)" if iid else f"{n} / ({n} - 1 - g)"
    return f"""SELECT '{label}' AS term, round(b, 6) AS estimate, round(sqrt(meat * {factor}) / sxx, 6) AS std_error FROM (SELECT b, sxx, c, s, g, {meat} AS meat FROM (SELECT *, y - b * x AS e
FROM (SELECT *, sum(w * x * y) OVER () / sum(w * x * x) OVER () AS b, sum(w * x * x) OVER () AS sxx FROM (SELECT c, s, g, v * {scale} AS w, y - sum(v * y) OVER k / sum(v) OVER k AS y, x - sum(v * x) OVER k / sum(v) OVER k AS x
FROM (SELECT l_suppkey, CAST({weight} AS DOUBLE) AS v, l_extendedprice AS y, l_quantity AS x, count(*) OVER () AS c, sum(CAST({weight} AS DOUBLE)) OVER () AS s, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS g FROM lineitem) WINDOW k AS (PARTITION BY l_suppkey)))) GROUP BY ALL)"""


@query(" UNION ALL ".join(_weighted_sql(*case) for case in _WEIGHTED))
def ols_weighted(spark, sf_dir):
    li, rows = _t(spark, sf_dir, "lineitem").withColumn("aw", 1 + F.col("l_tax")), []
    for label, column, vce in _WEIGHTED:
        r = ols(li, "l_extendedprice", "l_quantity", "l_suppkey", weights=column, weight_kind=label.split()[0], vce=vce)
        rows.append((label, r.beta[0], r.se[0]))
    return _coefs(spark, rows)


@query("""WITH w AS (SELECT l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS y, l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS x, l_tax - avg(l_tax) OVER (PARTITION BY l_suppkey) AS z FROM lineitem),
m AS (SELECT sum(x * x) AS a, sum(x * z) AS b, sum(z * z) AS c, sum(x * y) AS d, sum(z * y) AS e, sum(y * y) AS f, count(*) - 2 - (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS df FROM w),
s AS (SELECT *, (c * d - b * e) / (a * c - b * b) AS u, (a * e - b * d) / (a * c - b * b) AS v FROM m), q AS (SELECT *, (f - u * d - v * e) / df AS s2 FROM s)
SELECT 'combination' AS name, round(u + 2 * v, 4) AS value FROM q UNION ALL SELECT 'combination_se', round(sqrt(s2 * (c - 4 * b + 4 * a) / (a * c - b * b)), 4) FROM q
UNION ALL SELECT 'wald_f', round((a * u * u + 2 * b * u * v + c * v * v) / 2 / s2, 3) FROM q UNION ALL SELECT 'wald_f_one', round(v * v / (s2 * a / (a * c - b * b)), 6) FROM q""")
def linear_tests(spark, sf_dir):
    r = ols(_t(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"], "l_suppkey")
    c = r.linear_combination({"l_quantity": 1.0, "l_tax": 2.0})
    values = {"combination": (c["estimate"], 4), "combination_se": (c["std_error"], 4), "wald_f": (r.wald([{"l_quantity": 1.0}, {"l_tax": 1.0}])["statistic"], 3), "wald_f_one": (r.wald([{"l_tax": 1.0}])["statistic"], 6)}
    return spark.createDataFrame([(k, round(float(v), d)) for k, (v, d) in values.items()], "name string, value double")


_X = "x1x1 AS (SELECT sum(x1 * x1) a, sum(x1 * x2) b, sum(x2 * x2) c, sum(x1 * y) d, sum(x2 * y) e FROM LAST)"


@query(_two_way_sql("SELECT 'l_quantity' AS term, round((c * d - b * e) / (a * c - b * b), 5) AS estimate FROM (SELECT sum(x1 * x1) a, sum(x1 * x2) b, sum(x2 * x2) c, sum(x1 * y) d, sum(x2 * y) e FROM LAST) UNION ALL SELECT 'l_discount', round((a * e - b * d) / (a * c - b * b), 5) FROM (SELECT sum(x1 * x1) a, sum(x1 * x2) b, sum(x2 * x2) c, sum(x1 * y) d, sum(x2 * y) e FROM LAST)"))
def ols_two_way(spark, sf_dir):
    r = ols(_t(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], ["l_suppkey", "l_partkey"], vce="robust")
    return _coefs(spark, _of(r), 5).select("term", "estimate")


@query(f"""WITH {_ONE}, t AS (SELECT var_pop(l_extendedprice) * count(*) AS tss FROM lineitem), r AS (SELECT sum(e * e) AS rss FROM e), v AS (SELECT sum(y * y) AS wss FROM w)
SELECT 'r2' AS name, round(1 - rss / tss, 9) AS value FROM t, r UNION ALL SELECT 'r2_within', round(1 - rss / wss, 9) FROM r, v UNION ALL SELECT 'rmse', round(sqrt(rss / (n - g - 1)), 5) FROM r, b UNION ALL SELECT 'n', n FROM b""")
def fit_stats(spark, sf_dir):
    s = _one(spark, sf_dir).stats
    return spark.createDataFrame([(k, round(float(s[k]), d)) for k, d in (("r2", 9), ("r2_within", 9), ("rmse", 5), ("n", 0))], "name string, value double")


@query(f"""WITH {_ONE}, m AS (SELECT l_suppkey, avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem GROUP BY 1) SELECT l_suppkey, round(my - b * mx, 4) AS effect FROM m, b""")
def effects_recovered(spark, sf_dir):
    return recover(_one(spark, sf_dir))[0][1].select("l_suppkey", F.round("effect", 4).alias("effect"))


@query(f"WITH {_ONE} SELECT l_orderkey, l_linenumber, round(b * l_quantity, 5) AS prediction FROM lineitem, b")
def predict_xb(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return predict(_one(spark, sf_dir), li).select("l_orderkey", "l_linenumber", F.round("prediction", 5).alias("prediction"))


@query(f"WITH {_ONE} SELECT l_suppkey, round(sum(s), 2) AS score FROM e GROUP BY 1")
def cluster_scores(spark, sf_dir):
    r = _one(spark, sf_dir)
    return r.rows.groupBy("l_suppkey").agg(F.round(F.sum(F.col("_resid") * F.col("l_quantity_r")), 2).alias("score"))


@query(" UNION ALL ".join(f"SELECT '{y}' AS outcome, round(sum(x * y) / sum(x * x), 6) AS estimate FROM (SELECT {y} - avg({y}) OVER (PARTITION BY l_suppkey) AS y, l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS x FROM lineitem)" for y in ("l_extendedprice", "l_discount", "l_tax")))
def session_many_y(spark, sf_dir):
    outcomes = ["l_extendedprice", "l_discount", "l_tax"]
    s = Session(_t(spark, sf_dir, "lineitem"), [{"y": y, "x": ["l_quantity"], "absorb": "l_suppkey"} for y in outcomes])
    rows = [(y, float(r.beta[0])) for y, r in zip(outcomes, s.fit_many_y(outcomes, x=["l_quantity"], absorb="l_suppkey"))]
    s.close()
    return spark.createDataFrame(rows, "outcome string, estimate double").select("outcome", F.round("estimate", 6).alias("estimate"))


def _daily(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("user_id", "value", F.hour("ts").cast("double").alias("hr"), F.datediff("ts", F.lit("2024-01-01")).cast("double").alias("day"))


_DK = """WITH d AS (SELECT user_id, value, hour(ts) AS hr, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events),
w AS (SELECT day, value - avg(value) OVER (PARTITION BY user_id) AS y, hr - avg(hr) OVER (PARTITION BY user_id) AS x FROM d),
b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n, count(DISTINCT day) AS t, (SELECT count(DISTINCT user_id) FROM events) AS g FROM w),
s AS (SELECT day, sum(x * (y - b * x)) AS s FROM w, b GROUP BY day),
m AS (SELECT sum(p.s * q.s * (1 - abs(p.day - q.day) / 4.0)) AS meat FROM s p JOIN s q ON abs(p.day - q.day) < 4)
SELECT 'hr' AS term, round(b, 8) AS estimate, round(sqrt(meat * (n - 1) / (n - 1 - g) * t / (t - 1)) / sxx, 8) AS std_error FROM b, m"""


@query(_DK)
def driscoll_kraay(spark, sf_dir):
    return _coefs(spark, _of(ols(_daily(spark, sf_dir), "value", "hr", "user_id", vce="dkraay", time="day", bandwidth=4, drop_singletons=False)), 8)


@query("""WITH d AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, avg(value) AS v, avg(hour(ts)) AS hr FROM events GROUP BY 1, 2),
w AS (SELECT user_id, day, v - avg(v) OVER (PARTITION BY user_id) AS y, hr - avg(hr) OVER (PARTITION BY user_id) AS x FROM d),
b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n, (SELECT count(DISTINCT user_id) FROM events) AS g FROM w),
s AS (SELECT user_id, day, x * (y - b * x) AS s FROM w, b),
m AS (SELECT sum(p.s * q.s * (1 - abs(p.day - q.day) / 3.0)) AS meat FROM s p JOIN s q ON p.user_id = q.user_id AND abs(p.day - q.day) < 3)
SELECT 'hr' AS term, round(b, 8) AS estimate, round(sqrt(meat * n / (n - 1 - g)) / sxx, 8) AS std_error FROM b, m""")
def hac_panel(spark, sf_dir):
    df = _daily(spark, sf_dir).groupBy("user_id", "day").agg(F.avg("value").alias("v"), F.avg("hr").alias("hr"))
    return _coefs(spark, _of(ols(df, "v", "hr", "user_id", vce="hac", time="day", panel="user_id", bandwidth=3, drop_singletons=False)), 8)


_LAG_KERNELS = {
    "bartlett": "greatest(1 - x, 0)", "truncated": "CASE WHEN x <= 1 THEN 1 ELSE 0 END",
    "parzen": "CASE WHEN x <= 0.5 THEN 1 - 6 * x * x + 6 * x * x * x WHEN x <= 1 THEN 2 * pow(1 - x, 3) ELSE 0 END",
    "thann": "CASE WHEN x <= 1 THEN 0.5 + 0.5 * cos(pi() * x) ELSE 0 END", "thamm": "CASE WHEN x <= 1 THEN 0.54 + 0.46 * cos(pi() * x) ELSE 0 END",
    "qs": "25 / (12 * pow(pi(), 2) * x * x) * (sin(1.2 * pi() * x) / (1.2 * pi() * x) - cos(1.2 * pi() * x))", "daniell": "sin(pi() * x) / (pi() * x)", "tent": "2 * (1 - cos(lag * x)) / (x * x)",
}


@query("SELECT lag, " + ", ".join(f"CAST(round(CASE WHEN lag = 0 THEN 1 ELSE {rule} END, 9) AS DOUBLE) AS {k}" for k, rule in _LAG_KERNELS.items()) + " FROM (SELECT CAST(range AS BIGINT) AS lag, range / 4.0 AS x FROM range(0, 8))")
def kernel_weights(spark, sf_dir):
    rows = [(lag, *(float(round(kernels.weight(k, lag, 4), 9)) for k in _LAG_KERNELS)) for lag in range(8)]
    return spark.createDataFrame(rows, "lag long, " + ", ".join(f"{k} double" for k in _LAG_KERNELS))


@query(" UNION ALL ".join(f"SELECT '{c}' AS cluster, count(*) AS clusters, CAST(min(n) AS DOUBLE) AS min_size, CAST(median(n) AS DOUBLE) AS median_size, round(avg(n), 9) AS mean_size, CAST(max(n) AS DOUBLE) AS max_size, round(stddev_pop(n) / avg(n), 9) AS cv, round(max(n) / sum(n), 12) AS largest_share, round(sum(n) * sum(n) / sum(n * n), 6) AS effective_clusters, CAST(count_if(n = 1) AS BIGINT) AS singleton_clusters FROM (SELECT {c}, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1)" for c in ("l_suppkey", "l_partkey", "l_orderkey")))
def cluster_diagnostics(spark, sf_dir):
    out = resampling.cluster_diagnostics(_t(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey", "l_orderkey"])
    return out.withColumns({"mean_size": F.round("mean_size", 9), "cv": F.round("cv", 9), "largest_share": F.round("largest_share", 12), "effective_clusters": F.round("effective_clusters", 6)})


@query()
def wild_cluster_bootstrap(spark, sf_dir):
    r = resampling.wild_cluster_test(_one(spark, sf_dir, cluster="l_suppkey"), "l_suppkey", "l_quantity", reps=999)
    return _value(spark, {k: float(v) for k, v in r.items()})


@query("""WITH w AS (SELECT l_linenumber AS c, l_tax - avg(l_tax) OVER (PARTITION BY l_suppkey) AS y, l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS x FROM lineitem),
c AS (SELECT row_number() OVER (ORDER BY c) - 1 AS i, sum(x * y) AS sy, sum(x * x) AS g FROM w GROUP BY c),
a AS (SELECT sum(sy) / sum(g) AS b, sum(g) AS gg, count(*) AS m FROM c),
o AS (SELECT any_value(b) * any_value(gg) / sqrt(sum((sy - g * b) * (sy - g * b))) AS t FROM c, a),
d AS (SELECT r, c.g, (((r >> i) & 1) * 2 - 1) * sy AS v, sum((((r >> i) & 1) * 2 - 1) * sy) OVER (PARTITION BY r) / gg AS b, gg FROM a, range(0, CAST(pow(2, (SELECT count(*) FROM c)) AS BIGINT)) AS q(r), c),
s AS (SELECT r, any_value(b) * any_value(gg) / sqrt(sum((v - g * b) * (v - g * b))) AS t FROM d GROUP BY r)
SELECT 'statistic' AS name, round(t, 6) AS value FROM o UNION ALL SELECT 'p_value', round(avg(CASE WHEN abs(s.t) >= abs(o.t) * (1 - 1e-10) THEN 1.0 ELSE 0.0 END), 6) FROM s, o
UNION ALL SELECT 'draws', count(*) FROM s UNION ALL SELECT 'exact', 1 UNION ALL SELECT 'clusters', m FROM a""")
def wild_bootstrap_all_signs(spark, sf_dir):
    r = ols(_t(spark, sf_dir, "lineitem"), "l_tax", "l_quantity", "l_suppkey", cluster="l_linenumber")
    return _value(spark, {k: float(v) for k, v in resampling.wild_cluster_test(r, "l_linenumber", "l_quantity").items()})


@query("SELECT count(DISTINCT l_suppkey) AS draws, CAST(0 AS BIGINT) AS broken FROM lineitem")
def cluster_draws(spark, sf_dir):
    """Every draw has an id of its own and all rows of one cluster."""
    li = _t(spark, sf_dir, "lineitem").select("l_suppkey")
    drawn = resampling.draw_clusters(li, "l_suppkey", 7).groupBy("_draw").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("k"), F.min("l_suppkey").alias("l_suppkey"))
    sizes = li.groupBy("l_suppkey").agg(F.count("*").alias("size"))
    return drawn.join(sizes, "l_suppkey").agg(F.count("*").alias("draws"), F.count_if((F.col("k") != 1) | (F.col("n") != F.col("size"))).alias("broken"))


# --- factors -----------------------------------------------------------------------------------


@query("""SELECT 'o_orderstatus[' || o_orderstatus || ']' AS term, CAST(count(*) AS DOUBLE) AS total FROM orders WHERE o_orderstatus <> (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) GROUP BY 1
UNION ALL SELECT 'o_orderstatus[' || o_orderstatus || ']#o_custkey', CAST(sum(o_custkey) AS DOUBLE) FROM orders WHERE o_orderstatus <> (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) GROUP BY 1
UNION ALL SELECT 'o_custkey', CAST(sum(o_custkey) AS DOUBLE) FROM orders""")
def factor_design(spark, sf_dir):
    df = _t(spark, sf_dir, "orders")
    made = design(df, fv("i(o_orderstatus)##c(o_custkey)", base="freq"))
    row = df.agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(made.values())])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("term"), F.col(f"s{i}").alias("total")) for i, n in enumerate(made)])).alias("r")).select("r.term", "r.total")


@query("SELECT o_orderpriority AS base FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def base_frequent(spark, sf_dir):
    return spark.createDataFrame([(base_level(_t(spark, sf_dir, "orders"), "o_orderpriority", "freq"),)], "base string")


# --- instruments ---------------------------------------------------------------------------------

_IV = "w AS (SELECT l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS y, l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS x, l_extendedprice * (1 + 0.0) * 0 + l_quantity * 0.5 + l_tax * 10 - avg(l_quantity * 0.5 + l_tax * 10) OVER (PARTITION BY l_suppkey) AS z FROM lineitem), m AS (SELECT sum(z * y) AS zy, sum(z * x) AS zx, sum(z * z) AS zz, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, count(*) AS n, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS g FROM w)"


def _iv(spark, sf_dir, **kw):
    df = _t(spark, sf_dir, "lineitem").withColumn("z", F.col("l_quantity") * 0.5 + F.col("l_tax") * 10)
    return iv(df, "l_extendedprice", [], "l_quantity", kw.pop("instruments", "z"), "l_suppkey", **kw)


@query(f"WITH {_IV} SELECT 'l_quantity' AS term, round(zy / zx, 5) AS estimate, round(sqrt((yy - 2 * zy / zx * xy + zy / zx * zy / zx * xx) / (n - 1 - g) * zz / (zx * zx)), 5) AS std_error FROM m")
def iv_2sls(spark, sf_dir):
    return _coefs(spark, _of(_iv(spark, sf_dir)), 5)


@query(f"WITH {_IV} SELECT 'partial_r2' AS name, round(zx * zx / zz / xx, 6) AS value FROM m UNION ALL SELECT 'f', round(zx * zx / zz / (xx - zx * zx / zz) * (n - g - 1), 3) FROM m UNION ALL SELECT 'cragg_donald_f', round(zx * zx / zz / (xx - zx * zx / zz) * (n - g - 1), 3) FROM m")
def first_stage(spark, sf_dir):
    s = _iv(spark, sf_dir).stats
    f = s["first_stage"]["l_quantity"]
    return spark.createDataFrame([("partial_r2", round(f["partial_r2"], 6)), ("f", round(f["f"], 3)), ("cragg_donald_f", round(s["cragg_donald_f"], 3))], "name string, value double")


@query("""WITH d AS (SELECT l_suppkey, l_extendedprice AS y, l_quantity AS x, l_quantity * 0.5 + l_tax * 10 AS p, CAST(l_linenumber AS DOUBLE) AS q FROM lineitem),
w AS (SELECT y - avg(y) OVER s AS y, x - avg(x) OVER s AS x, p - avg(p) OVER s AS p, q - avg(q) OVER s AS q FROM d WINDOW s AS (PARTITION BY l_suppkey)),
m AS (SELECT sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq, sum(p * x) AS px, sum(q * x) AS qx, sum(p * y) AS py, sum(q * y) AS qy, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, count(*) AS n, (SELECT count(DISTINCT l_suppkey) FROM d) AS g FROM w),
a AS (SELECT *, pp * qq - pq * pq AS det FROM m),
f AS (SELECT *, (qq * px * px - 2 * pq * px * qx + pp * qx * qx) / det AS fxx, (qq * px * py - pq * (px * qy + qx * py) + pp * qx * qy) / det AS fxy, (qq * py * py - 2 * pq * py * qy + pp * qy * qy) / det AS fyy, (qq * px - pq * qx) / det AS cp, (pp * qx - pq * px) / det AS cq FROM a),
e AS (SELECT *, (yy - fyy) * (xx - fxx) - (xy - fxy) * (xy - fxy) AS ea, -(yy * (xx - fxx) + xx * (yy - fyy) - 2 * xy * (xy - fxy)) AS eb, yy * xx - xy * xy AS ec FROM f),
k AS (SELECT *, (-eb - sqrt(eb * eb - 4 * ea * ec)) / (2 * ea) AS liml FROM e),
t AS (SELECT '2sls' AS estimator, 1.0 AS kk, * FROM k UNION ALL SELECT 'liml', liml, * FROM k UNION ALL SELECT 'fuller', liml - 1.0 / (n - 2 - g), * FROM k UNION ALL SELECT 'kclass', 0.5, * FROM k),
b AS (SELECT *, (1 - kk) * xx + kk * fxx AS bread, ((1 - kk) * xy + kk * fxy) / ((1 - kk) * xx + kk * fxx) AS beta FROM t),
r AS (SELECT *, yy - 2 * beta * xy + beta * beta * xx AS rss FROM b),
v AS (SELECT fxy / fxx AS b0, cp, cq FROM f),
s AS (SELECT sum((y - b0 * x) * (y - b0 * x) * p * p) AS spp, sum((y - b0 * x) * (y - b0 * x) * p * q) AS spq, sum((y - b0 * x) * (y - b0 * x) * q * q) AS sqq,
sum(x * x * p * p) AS lpp, sum(x * x * p * q) AS lpq, sum(x * x * q * q) AS lqq, sum(u * u * p * p) AS upp, sum(u * u * p * q) AS upq, sum(u * u * q * q) AS uqq FROM (SELECT *, x - cp * p - cq * q AS u FROM w, v)),
h AS (SELECT *, spp * sqq - spq * spq AS sd FROM s, f),
o AS (SELECT *, (sqq * px * px - 2 * spq * px * qx + spp * qx * qx) / sd AS hxx, (sqq * px * py - spq * (px * qy + qx * py) + spp * qx * qy) / sd AS hxy, (sqq * py * py - 2 * spq * py * qy + spp * qy * qy) / sd AS hyy FROM h)
SELECT estimator, round(beta, 5) AS estimate, round(sqrt(rss / (n - 1 - g) * ((1 - kk) * (1 - kk) * xx + (2 * kk * (1 - kk) + kk * kk) * fxx)) / abs(bread), 5) AS std_error,
round((fyy - 2 * beta * fxy + beta * beta * fxx) / (rss / n), 5) AS j, round(n * fxx / xx, 4) AS kp_lm, round(fxx / (xx - fxx) * (n - g - 2) / 2, 1) AS kp_f FROM r
UNION ALL SELECT 'gmm2s', round(hxy / hxx, 5), round(sqrt(n / (n - 1 - g) / hxx), 5), round(hyy - hxy * hxy / hxx, 5), round((lqq * px * px - 2 * lpq * px * qx + lpp * qx * qx) / (lpp * lqq - lpq * lpq), 4),
round((uqq * wp * wp - 2 * upq * wp * wq + upp * wq * wq) / (upp * uqq - upq * upq) / 2 * (n - g - 2) / n, 1) FROM (SELECT *, px AS wp, qx AS wq FROM o)""")
def iv_estimators(spark, sf_dir):
    rows = []
    for name, kw in (("2sls", {}), ("liml", {"estimator": "liml"}), ("fuller", {"estimator": "liml", "fuller": 1.0}), ("kclass", {"estimator": "kclass", "kappa": 0.5}), ("gmm2s", {"estimator": "gmm2s", "vce": "robust"})):
        r = _iv(spark, sf_dir, instruments=["z", "l_linenumber"], **kw)
        rows.append((name, *(round(float(v), d) for v, d in ((r.beta[0], 5), (r.se[0], 5), (r.stats["j"], 5), (r.stats["kp_lm"], 4), (r.stats["kp_f"], 1)))))
    return spark.createDataFrame(rows, "estimator string, estimate double, std_error double, j double, kp_lm double, kp_f double")


# --- Poisson -------------------------------------------------------------------------------------


@query("""WITH RECURSIVE it AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS h UNION ALL
SELECT i + 1, b + (SELECT sum(gx - gy * ex / e1) / sum(gy * (exx / e1 - ex / e1 * ex / e1)) FROM (SELECT sum(l_quantity) gy, sum(l_quantity * l_discount) gx, sum(exp(b * l_discount)) e1, sum(l_discount * exp(b * l_discount)) ex, sum(l_discount * l_discount * exp(b * l_discount)) exx FROM lineitem GROUP BY l_suppkey)),
(SELECT sum(gy * (exx / e1 - ex / e1 * ex / e1)) FROM (SELECT sum(l_quantity) gy, sum(exp(b * l_discount)) e1, sum(l_discount * exp(b * l_discount)) ex, sum(l_discount * l_discount * exp(b * l_discount)) exx FROM lineitem GROUP BY l_suppkey)) FROM it WHERE i < 8)
SELECT 'l_discount' AS term, round(b, 6) AS estimate, round(1 / sqrt(h), 6) AS std_error FROM it WHERE i = 8""")
def ppml_oneway(spark, sf_dir):
    return _coefs(spark, _of(ppml(_t(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", "l_suppkey", vce="iid")))


@query()
def ppml_two_way(spark, sf_dir):
    return _coefs(spark, _of(ppml(_t(spark, sf_dir, "lineitem"), "l_quantity", ["l_discount", "l_tax"], ["l_suppkey", "l_partkey"], cluster="l_suppkey")))


@query()
def ivppml_oneway(spark, sf_dir):
    return _coefs(spark, _of(ivppml(_t(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey")))


def _fitted(rows: DataFrame, sums: dict[str, object]) -> DataFrame:
    """(moment, level, total) of the fitted means, by level of a column or weighted by one."""
    out = None
    for name, part in sums.items():
        if part is None:
            one = rows.groupBy(F.col(name).cast("long").alias("level")).agg(F.sum("_mu").alias("total"))
        else:
            one = rows.agg(F.sum(F.col("_mu") * part).alias("total")).select(F.lit(None).cast("long").alias("level"), "total")
        one = one.select(F.lit(name).alias("moment"), "level", F.round("total", 1).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT 'l_suppkey' AS moment, CAST(l_suppkey AS BIGINT) AS level, round(sum(CAST(l_quantity AS DOUBLE)), 1) AS total FROM lineitem GROUP BY l_suppkey
UNION ALL SELECT 'l_partkey', CAST(l_partkey AS BIGINT), round(sum(CAST(l_quantity AS DOUBLE)), 1) FROM lineitem GROUP BY l_partkey
UNION ALL SELECT 'l_discount', NULL, round(sum(l_quantity * l_discount), 1) FROM lineitem UNION ALL SELECT 'l_tax', NULL, round(sum(l_quantity * l_tax), 1) FROM lineitem""")
def ppml_two_way_moments(spark, sf_dir):
    """The score equations: fitted totals are those of the outcome, by level and by regressor."""
    r = ppml(_t(spark, sf_dir, "lineitem"), "l_quantity", ["l_discount", "l_tax"], ["l_suppkey", "l_partkey"], separation=(), tolerance=1e-12)
    return _fitted(r.rows, {"l_suppkey": None, "l_partkey": None, "l_discount": F.col("l_discount"), "l_tax": F.col("l_tax")})


@query("""SELECT 'l_suppkey' AS moment, CAST(l_suppkey AS BIGINT) AS level, round(sum(CAST(l_quantity AS DOUBLE)), 1) AS total FROM lineitem GROUP BY l_suppkey
UNION ALL SELECT 'l_discount', NULL, round(sum(l_quantity * l_discount), 1) FROM lineitem UNION ALL SELECT 'l_linenumber', NULL, round(sum(CAST(l_quantity * l_linenumber AS DOUBLE)), 1) FROM lineitem""")
def ivppml_moments(spark, sf_dir):
    """The additive moments at zero: fitted totals by supplier, by control and by instrument."""
    r = ivppml(_t(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey", tolerance=1e-12)
    return _fitted(r.rows, {"l_suppkey": None, "l_discount": F.col("l_discount"), "l_linenumber": F.col("l_linenumber")})


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.095")
def separation_relu(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.when(F.col("l_discount") > 0.095, 0.0).otherwise(F.col("l_quantity")).alias("y"), F.when(F.col("l_discount") > 0.095, 1.0).otherwise(0.0).alias("d"))
    bad, _ = separated_rows(df, [fe("l_suppkey")], ["d"], "y")
    return (bad if bad is not None else df.limit(0)).select("l_orderkey", "l_linenumber")


@query()
def group_individual(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice", F.col("o_custkey").cast("double").alias("cust"))
    return _coefs(spark, _of(groups.group_ols(li.join(o, "l_orderkey"), "o_totalprice", ["cust"], "l_orderkey", "l_partkey")))


@query("SELECT date_trunc('day', ts) AS start, count(*) AS n, round(sum(value), 4) AS m0_1 FROM events GROUP BY 1")
def windowed_sums(spark, sf_dir):
    return windowed_moments(_t(spark, sf_dir, "events"), "ts", "value", []).select("start", "n", F.round("m0_1", 4).alias("m0_1"))


@query("SELECT 'cust' AS term, CAST(3 AS DOUBLE) AS estimate")
def group_individual_exact(spark, sf_dir):
    """An outcome made of 3 x the regressor and the mean of known effects of its members."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("double").alias("cust"))
    made = li.join(o, "l_orderkey").withColumn("y", 3 * F.col("cust") + F.avg(F.col("l_partkey") % 7).over(Window.partitionBy("l_orderkey")))
    r = groups.group_ols(made, "y", ["cust"], "l_orderkey", "l_partkey")
    return spark.createDataFrame([(t, round(float(b), 6)) for t, b in zip(r.names, r.beta)], "term string, estimate double")


@query("""WITH p AS (SELECT l_partkey AS k, CAST(l_partkey % 7 AS DOUBLE) AS e FROM lineitem GROUP BY 1), s AS (SELECT l_suppkey AS k, CAST(l_suppkey % 5 AS DOUBLE) AS e FROM lineitem GROUP BY 1)
SELECT 'l_suppkey' AS term, CAST(k AS BIGINT) AS level, round(e + (SELECT avg(e) FROM p), 5) AS effect FROM s UNION ALL SELECT 'l_partkey', CAST(k AS BIGINT), round(e - (SELECT avg(e) FROM p), 5) FROM p""")
def effects_two_way(spark, sf_dir):
    """Known effects of suppliers and parts, recovered up to the shift that the mean of the parts fixes."""
    li = _t(spark, sf_dir, "lineitem").withColumn("y", 2.0 * F.col("l_discount") + F.col("l_suppkey") % 5 + F.col("l_partkey") % 7)
    first, second = recover(ols(li, "y", "l_discount", ["l_suppkey", "l_partkey"], drop_singletons=False))
    one = lambda t, x: x.select(F.lit(t.name).alias("term"), F.col(t.keys[0]).cast("long").alias("level"), F.round("effect", 5).alias("effect"))
    return one(*first).unionByName(one(*second))


@query("SELECT l_orderkey, l_linenumber, round(2.0 * l_discount + l_suppkey % 5 + l_partkey % 7, 5) AS prediction FROM lineitem")
def predict_response(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").withColumn("y", 2.0 * F.col("l_discount") + F.col("l_suppkey") % 5 + F.col("l_partkey") % 7)
    r = ols(li, "y", "l_discount", ["l_suppkey", "l_partkey"], drop_singletons=False)
    return predict(r, li, "response").select("l_orderkey", "l_linenumber", F.round("prediction", 5).alias("prediction"))


@query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 1")
def csv_source(spark, sf_dir):
    """The customers written as CSV and read back through the reader, two columns of them."""
    path = f"{shared_folder(spark)}/absorbia/customers-{uuid.uuid4().hex}.csv"
    _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).csv(path)
    df = read(spark, path, ["c_mktsegment", "c_custkey"], schema="c_custkey long, c_name string, c_mktsegment string")
    return df.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("SELECT 'slope' AS kind, CAST(l_suppkey AS BIGINT) AS level, round(CAST(l_suppkey % 5 AS DOUBLE), 4) AS effect FROM lineitem GROUP BY ALL UNION ALL SELECT 'intercept', CAST(l_suppkey AS BIGINT), round(CAST(l_suppkey % 3 AS DOUBLE), 4) FROM lineitem GROUP BY ALL")
def effects_slopes(spark, sf_dir):
    """Known intercepts and slopes of suppliers, recovered from a fit."""
    li = _t(spark, sf_dir, "lineitem").withColumn("y", 2.0 * F.col("l_discount") + F.col("l_suppkey") % 3 + (F.col("l_suppkey") % 5) * F.col("l_quantity"))
    r = ols(li, "y", "l_discount", [fe("l_suppkey", slopes="l_quantity")], drop_singletons=False)
    one = lambda kind, x: x.select(F.lit(kind).alias("kind"), F.col("l_suppkey").cast("long").alias("level"), F.round("effect", 4).alias("effect"))
    return one("slope", recover_slopes(r)[0][2]).unionByName(one("intercept", recover(r)[0][1]))


@query("SELECT l_orderkey, l_linenumber, round(2.0 * l_discount + l_suppkey % 3 + (l_suppkey % 5) * l_quantity, 4) AS prediction FROM lineitem")
def predict_slopes(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").withColumn("y", 2.0 * F.col("l_discount") + F.col("l_suppkey") % 3 + (F.col("l_suppkey") % 5) * F.col("l_quantity"))
    r = ols(li, "y", "l_discount", [fe("l_suppkey", slopes="l_quantity")], drop_singletons=False)
    return predict(r, li, "response").select("l_orderkey", "l_linenumber", F.round("prediction", 4).alias("prediction"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey), 4) AS x, round(l_tax - avg(l_tax) OVER (PARTITION BY l_suppkey), 6) AS z, true AS same FROM lineitem")
def session_within(spark, sf_dir):
    """Residuals kept in a store by one session and read by another."""
    store = ResultStore(spark, f"{shared_folder(spark)}/absorbia/results-{uuid.uuid4().hex}")
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_tax")
    first, second = Session(li, store=store), Session(li, store=store)
    first.within(["l_extendedprice", "l_tax"], "l_suppkey")
    out = second.within(["l_extendedprice", "l_tax"], "l_suppkey")
    same = list(first.projected) == list(second.projected)
    return out.select("l_orderkey", "l_linenumber", F.round("l_extendedprice_r", 4).alias("x"), F.round("l_tax_r", 6).alias("z"), F.lit(same).alias("same"))


@query("""WITH s AS (SELECT l_suppkey, count(*) AS r FROM lineitem GROUP BY 1)
SELECT 'l_orderkey' AS term, count(*) AS lone FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1) HAVING count(*) > 0 UNION ALL SELECT 'l_suppkey', count(*) FROM s WHERE r = 1 HAVING count(*) > 0""")
def recovery_diagnosis(spark, sf_dir):
    found = diagnose(_t(spark, sf_dir, "lineitem"), [fe("l_orderkey"), fe("l_suppkey")])
    return spark.createDataFrame([(f["terms"][0], f["count"]) for f in found if f["code"] == "effects.singletons"], "term string, lone long")


_DK_KERNELS = ("truncated", "parzen", "thann", "thamm", "qs", "daniell", "tent")


@query(_DK.partition("m AS (")[0] + "p AS (SELECT p.s * q.s AS s, abs(p.day - q.day) AS lag, abs(p.day - q.day) / 4.0 AS x FROM s p JOIN s q ON true), " + "m AS (" + " UNION ALL ".join(f"SELECT '{k}' AS term, sum(s * CASE WHEN lag = 0 THEN 1 ELSE {_LAG_KERNELS[k]} END) AS meat FROM p" for k in _DK_KERNELS) + ") SELECT term, round(b, 8) AS estimate, round(sqrt(greatest(meat, 0) * (n - 1) / (n - 1 - g) * t / (t - 1)) / sxx, 8) AS std_error FROM b, m")
def driscoll_kraay_kernels(spark, sf_dir):
    df, rows = _daily(spark, sf_dir).persist(), []
    for k in _DK_KERNELS:
        r = ols(df, "value", "hr", "user_id", vce="dkraay", time="day", bandwidth=4, kernel=k, drop_singletons=False)
        rows.append((k, r.beta[0], r.se[0]))
    df.unpersist()
    return _coefs(spark, rows, 8)


@query(f"WITH {_ONE} SELECT 'l_quantity' AS term, round(b, 6) AS estimate, round(sqrt(sxx * (SELECT sum(e * e) FROM e) / (n - 1 - g)) / sxx, 6) AS std_error, CAST(1 AS BIGINT) AS hits, true AS kept FROM b")
def session_store(spark, sf_dir):
    """A fit repeated within a session, and published again by a second one from the store."""
    folder = f"{shared_folder(spark)}/absorbia/results-{uuid.uuid4().hex}"
    spec = {"y": "l_extendedprice", "x": ["l_quantity"], "absorb": "l_suppkey"}
    first = Session(_t(spark, sf_dir, "lineitem"), [spec], ResultStore(spark, folder))
    first.fit_many([spec, spec])
    second = Session(_t(spark, sf_dir, "lineitem"), [spec], ResultStore(spark, folder))
    p = second.published(**spec)
    out = spark.createDataFrame([(p["terms"][0], round(p["estimates"][0], 6), round(p["std_errors"][0], 6), first.hits, not second.done)], "term string, estimate double, std_error double, hits long, kept boolean")
    first.close(), second.close()
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-way fixed effects with clustered errors: the coefficient table."""
    return ols(_t(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], ["l_suppkey", "l_partkey"], cluster="l_suppkey").coef_table(spark)

"""Queries of section 2.14: features, models, scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions import numbers as N
from tabulon.operators import features as M
from tabulon.operators import predictive as P
from tabulon.operators import prescriptive as R
from tabulon.operators import series as W
from tabulon.operators.predicates import Condition
from tabulon.plans.catalog.analyses import DIMS, EFFECTS, LIFT_SQL
from tabulon.plans.catalog.base import FLAT_SQL, ORDER_GAPS_SQL, Tables, flat, query, with_order_gaps
from tabulon.session import cut_lineage

IDS = ["o_orderkey", "o_custkey"]


def order_features(t: Tables):
    """Orders with size, priority, status and month; the price follows from none of them exactly."""
    n = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("sum_qty"), F.sum("l_extendedprice").alias("sum_price")
    )
    return t.orders.join(n, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@query("m1_feature_preparation", f"""
WITH b AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price FROM ({ORDER_GAPS_SQL})),
 k AS (SELECT coalesce(o_orderpriority, '(missing)') AS p FROM b GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)
SELECT o_orderkey, coalesce(price, (SELECT median(price) FROM b)) AS price, CASE WHEN coalesce(o_orderpriority, '(missing)') IN (SELECT p FROM k) THEN coalesce(o_orderpriority, '(missing)') ELSE '(other)' END AS o_orderpriority FROM b""", {"price": 2})
def _(t: Tables):
    b = with_order_gaps(t.orders).withColumn("price", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    spec = M.learn_features(b, "o_totalprice", ["price", "o_orderpriority"], max_levels=3)
    return M.apply_features(b, spec).select("o_orderkey", "price", "o_orderpriority")


@query("m1_feature_defaults", """
SELECT 'price' AS feature, CAST(median(o_totalprice) AS VARCHAR) IS NOT NULL AS has_default, quantile_cont(o_totalprice, 0.01) AS p01, median(o_totalprice) AS median, quantile_cont(o_totalprice, 0.99) AS p99 FROM orders""",
       {"p01": 2, "median": 2, "p99": 2})
def _(t: Tables):
    s = M.learn_features(t.orders, "o_custkey", ["o_totalprice"]).numeric["o_totalprice"]
    return t.orders.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("price").alias("feature"), (F.col("n") > 0).alias("has_default"), *[F.lit(s[k]).alias(k) for k in ("p01", "median", "p99")]
    )


@query("m2_modular_split", "SELECT o_orderkey, ((o_orderkey % 1000003) * 7919) % 100 < 80 AS is_train FROM orders")
def _(t: Tables):
    return M.modular_split(t.orders.select("o_orderkey"), "o_orderkey")


@query("m2_hash_split")
def _(t: Tables):
    return M.hash_split(t.orders, ["o_orderkey"]).groupBy("is_train").agg(F.count(F.lit(1)).alias("n"))


@query("m2_hash_split_properties", "SELECT count(*) AS n_rows, 0 AS n_otherwise, true AS share_near FROM orders")
def _(t: Tables):
    """Every row is in one part, the same one whatever the partitions are; four in five are for training."""
    keys = t.orders.select("o_orderkey")
    again = M.hash_split(keys.repartition(5), ["o_orderkey"]).withColumnRenamed("is_train", "again")
    both = M.hash_split(keys, ["o_orderkey"]).join(again, "o_orderkey")
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("is_train") != F.col("again")).cast("int").alias("n_otherwise"),
        F.avg(F.col("is_train").cast("int")).between(0.77, 0.83).alias("share_near"),
    )


def price_model(t: Tables):
    data = M.hash_split(order_features(t), ["o_orderkey"])
    return P.fit_regression(data, "sum_price", columns=["n_lines", "sum_qty", "o_orderpriority", "o_orderstatus"])


@query("m3_regression")
def _(t: Tables):
    return price_model(t).metrics


@query("m4_rare_classes", """
WITH b AS (SELECT doc_id, CASE WHEN lang = 'de' THEN NULL ELSE source || '/' || lang END AS c FROM documents), n AS (SELECT coalesce(c, '(missing)') AS c, count(*) AS n FROM b GROUP BY 1)
SELECT doc_id, CASE WHEN n.n < 5 THEN '(other)' ELSE n.c END AS c FROM b JOIN n ON coalesce(b.c, '(missing)') = n.c""")
def _(t: Tables):
    b = t.documents.select("doc_id", F.when(F.col("lang") != "de", F.concat_ws("/", "source", "lang")).alias("c"))
    return M.rare_classes_merged(b, "c")


@query("m4_confusion_matrix", """
WITH c AS (SELECT o_orderstatus AS actual, CASE WHEN o_totalprice > 200000 THEN 'F' ELSE 'O' END AS predicted, count(*) AS n FROM orders GROUP BY 1, 2),
 g AS (SELECT a.l AS actual, b.l AS predicted, coalesce(n, 0) AS n FROM (VALUES ('F'), ('O'), ('P')) a(l) CROSS JOIN (VALUES ('F'), ('O'), ('P')) b(l) LEFT JOIN c ON c.actual = a.l AND c.predicted = b.l)
SELECT actual, predicted, n, n / sum(n) OVER (PARTITION BY actual) AS share FROM g""", {"share": 6})
def _(t: Tables):
    guess = F.when(F.col("o_totalprice") > 200000, F.lit("F")).otherwise(F.lit("O"))
    return P.confusion_matrix(t.orders.select(F.col("o_orderstatus").alias("actual"), guess.alias("predicted")), ["F", "O", "P"])


def quality_model(t: Tables):
    docs = t.documents.join(t.labels, "doc_id").select("doc_id", "lang", "source", "n_chars", F.col("quality").cast("string").alias("quality"))
    return P.fit_classification(M.hash_split(docs, ["doc_id"]), "quality", columns=["lang", "source", "n_chars"])


@query("m4_classification")
def _(t: Tables):
    return quality_model(t)[1]


@query("m4_class_metrics")
def _(t: Tables):
    return quality_model(t)[0].metrics


KEY = ["o_orderpriority"]


def weekly(t: Tables):
    return W.build_series(t.orders, KEY, "o_orderdate", "o_totalprice", "week")


@query("m5_trend_line", """
WITH w AS (SELECT o_orderpriority, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS t, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY t DESC) AS rn FROM w),
 x AS (SELECT *, 10 - rn AS x, median(y) OVER p AS med FROM r WHERE rn <= 10 WINDOW p AS (PARTITION BY o_orderpriority)),
 d AS (SELECT *, median(abs(y - med)) OVER (PARTITION BY o_orderpriority) AS mad FROM x),
 f AS (SELECT o_orderpriority, regr_slope(y, x) AS s, stddev_pop(y) AS sd FROM d WHERE abs(0.6745 * (y - med) / mad) <= 4 GROUP BY 1)
SELECT f.o_orderpriority, CAST(step AS INTEGER) AS step, y + greatest(-2.5 * sd, least(2.5 * sd, s)) * step AS trend, 0.65 - 0.45 * (step - 1) / 5.0 AS weight
FROM f JOIN r ON f.o_orderpriority = r.o_orderpriority AND rn = 1, range(1, 7) AS st(step)""", {"trend": 2, "weight": 4})
def _(t: Tables):
    return P.trend_line(weekly(t), KEY, 6)


@query("m5_forecast")
def _(t: Tables):
    return P.forecast(weekly(t), KEY, "week", 8).points


@query("m5_forecast_holdout")
def _(t: Tables):
    return P.forecast(weekly(t), KEY, "week", 1).metrics


@query("m6_importances")
def _(t: Tables):
    return price_model(t).importances


@query("m7_scenario_rows", """
WITH s AS (SELECT quantile_cont(o_totalprice, 0.01) AS p01, median(o_totalprice) AS med, quantile_cont(o_totalprice, 0.99) AS p99 FROM orders)
SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN med ELSE c_acctbal END AS o_totalprice, CASE WHEN c_mktsegment = 'BUILDING' THEN '(other)' ELSE 'F' END AS o_orderstatus,
 CAST(CAST(c_mktsegment = 'MACHINERY' OR c_acctbal < p01 OR c_acctbal > p99 AS INTEGER) + CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS INTEGER) AS n_warnings FROM customer, s""", {"o_totalprice": 2})
def _(t: Tables):
    """One scenario per customer: the balance as price ("1,5 days" style), an unknown status for one segment."""
    spec = M.learn_features(t.orders, "o_custkey", ["o_totalprice", "o_orderstatus"])
    price = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("a lot")).otherwise(
        F.concat(F.translate(F.col("c_acctbal").cast("decimal(12,2)").cast("string"), ".", ","), F.lit(" days"))
    )
    status = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("nowhere")).otherwise(F.lit(" 'F' "))
    rows = M.scenario_rows(t.customer.select("c_custkey", price.alias("o_totalprice"), status.alias("o_orderstatus")), spec)
    return rows.select("c_custkey", "o_totalprice", "o_orderstatus", F.size("warnings").alias("n_warnings"))


@query("m8_scenario_evaluation")
def _(t: Tables):
    scenario = M.scenario_from_conditions([Condition("sum_qty", ">=", 100), Condition("sum_qty", "<=", 140), Condition("o_orderstatus", "==", "F")])
    return R.evaluate_scenario(price_model(t), scenario, "maximize").drop("warnings")


@query("m9_candidates", "SELECT p_type AS candidate, count(*) AS n_obs FROM part GROUP BY 1 HAVING count(*) >= 5")
def _(t: Tables):
    return M.candidate_list(t.part, "p_type")


@query("m9_candidate_ranking")
def _(t: Tables):
    return R.rank_candidates(order_features(t), price_model(t), "o_orderpriority", {"n_lines": 3}, "minimize")


@query("m11_decision_baseline", """
SELECT count(x) AS n, avg(x) AS mean, median(x) AS median, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.9) AS p90, min(x) AS min, max(x) AS max FROM (SELECT l_extendedprice AS x FROM lineitem)""",
       {c: 4 for c in ("mean", "median", "p10", "p90", "min", "max")})
def _(t: Tables):
    return R.decision_baseline(t.lineitem, "l_extendedprice")


@query("m11_decision_table", f"""
WITH e AS (SELECT 'numeric' AS kind, feature, CAST(NULL AS VARCHAR) AS value, effect, n FROM (SELECT * FROM ({' UNION ALL '.join(f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) * stddev_pop(l_extendedprice) AS effect, CAST(count({c}) AS DOUBLE) AS n FROM ({FLAT_SQL})" for c in EFFECTS)}) ORDER BY abs(effect) DESC, feature LIMIT 6)
 UNION ALL SELECT 'categorical', feature, value, lift, n FROM (SELECT * FROM ({LIFT_SQL}) ORDER BY abs(lift) DESC, feature, value LIMIT 8))
SELECT *, CASE WHEN effect > 0 THEN 'positive' WHEN effect < 0 THEN 'negative' ELSE 'zero' END AS direction, CASE WHEN effect > 0 THEN 'decrease' WHEN effect < 0 THEN 'increase' ELSE 'no clear direction' END AS suggested_change FROM e""", {"effect": 4})
def _(t: Tables):
    return R.decision_table(flat(t), "l_extendedprice", "minimize", list(EFFECTS), list(DIMS))


@query("m3_model_properties", """
SELECT (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS n_rows, true AS rmse_from_mae, true AS r2_below_one, true AS importances_sum, 4 AS n_features, true AS line_rows,
 true AS spread_ordered, (SELECT count(*) FROM (SELECT o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1 HAVING count(*) >= 5)) AS n_candidates, true AS ranked,
 true AS shares_sum, true AS confusion_rows, true AS rates_within""")
def _(t: Tables):
    """What must hold of every forest: rows of both parts, errors, importances, spread, ranking and confusion sums."""
    fitted = price_model(t)
    m = N.one_row(fitted.metrics)
    i = N.one_row(fitted.importances.agg(F.sum("importance").alias("s"), F.count(F.lit(1)).alias("n")))
    line = N.one_row(P.fit_line(fitted.holdout))
    scenario = M.scenario_from_conditions([Condition("sum_qty", ">=", 100), Condition("sum_qty", "<=", 140)])
    spread = R.evaluate_scenario(fitted, scenario, "maximize")
    s = N.one_row(spread.agg(F.min((F.col("p10") <= F.col("mean")) & (F.col("mean") <= F.col("p90"))).alias("ok")))
    ranking = R.rank_candidates(order_features(t), fitted, "o_orderpriority", {"n_lines": 3}, "minimize")
    c = N.one_row(ranking.agg(F.count(F.lit(1)).alias("n"), F.min("n_obs").alias("least")))
    classes, confusion = quality_model(t)
    rows = N.one_row(confusion.groupBy("actual").agg(F.sum("n").alias("n"), F.sum("share").alias("share")).agg(
        F.sum("n").alias("n"), F.min((F.abs(F.col("share") - 1) < 1e-9) | (F.col("n") == 0)).alias("ok"),
    ))
    held = N.one_row(classes.holdout.agg(F.count(F.lit(1)).alias("n")))
    rates = N.one_row(classes.metrics)
    return t.spark.range(1).select(
        (m["n_train"] + m["n_test"]).cast("bigint").alias("n_rows"), (m["rmse"] >= m["mae"]).alias("rmse_from_mae"), (m["r2"] <= 1).alias("r2_below_one"),
        (F.abs(i["s"] - 1) < 1e-6).alias("importances_sum"), i["n"].cast("int").alias("n_features"), (line["n"] == m["n_test"]).alias("line_rows"),
        s["ok"].alias("spread_ordered"), c["n"].alias("n_candidates"), (c["least"] >= 5).alias("ranked"), rows["ok"].alias("shares_sum"),
        (rows["n"] == held["n"]).alias("confusion_rows"), (rates["accuracy"].between(0, 1) & rates["weighted_f1"].between(0, 1)).alias("rates_within"),
    )


@query("m5_forecast_properties", """
WITH w AS (SELECT o_orderpriority, date_trunc('week', o_orderdate) AS t FROM orders GROUP BY 1, 2), s AS (SELECT o_orderpriority, max(t) AS last_t, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 30)
SELECT o_orderpriority, CAST(step AS INTEGER) AS step, CAST(last_t + to_days(CAST(7 * step AS INTEGER)) AS TIMESTAMP) AS t, true AS within FROM s, range(1, 9) AS r(step) WHERE n - 12 >= 25""")
def _(t: Tables):
    """Each long enough series has all its steps at the right times, and no value leaves what forest and trend can give."""
    series = cut_lineage(weekly(t))
    points = P.forecast(series, KEY, "week", 8).points
    ends = series.groupBy(*KEY).agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    whole = N.one_row(series.agg(F.min("y").alias("lo"), F.max("y").alias("hi")))
    trend = P.trend_line(series, KEY, 8).select(*KEY, "step", "trend")
    joined = points.join(ends, KEY).join(trend, [*KEY, "step"])
    low, high = F.least(whole["lo"], F.col("trend")), F.greatest(whole["hi"], F.col("trend"))
    return joined.select(*KEY, "step", "t", F.col("forecast").between(low - 1e-6 * F.abs(low), high + 1e-6 * F.abs(high)).alias("within"))


@query("m12_holdout_line")
def _(t: Tables):
    return P.fit_line(price_model(t).holdout)


@query("m12_line_of_values", "SELECT count(*) AS n, regr_slope(l_quantity, l_extendedprice) * 1000 AS slope, regr_intercept(l_quantity, l_extendedprice) AS intercept FROM lineitem", {"slope": 6, "intercept": 4})
def _(t: Tables):
    line = P.fit_line(t.lineitem.select(F.col("l_quantity").alias("prediction"), F.col("l_extendedprice").alias("actual")))
    return line.withColumn("slope", F.col("slope") * 1000)

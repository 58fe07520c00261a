"""Queries of sections 2.6-2.11: aggregates, series, joins, sorting, reshaping, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions import numbers as N
from tabulon.functions import text as X
from tabulon.operators import aggregate as A
from tabulon.operators import reshape as U
from tabulon.operators import series as W
from tabulon.operators.clean import first_per_key
from tabulon.operators.diagnostic import best_per_key, by_dimension
from tabulon.operators.descriptive import crosstab
from tabulon.operators.verify import join_support
from tabulon.plans.catalog.base import GAPS_SQL, ORDER_GAPS_SQL, Tables, query, with_gaps, with_order_gaps

M = A.Metric


@query("a1_group_aggregate", f"""
SELECT l_returnflag, l_linestatus, count(*) AS n, coalesce(sum(l_quantity), 0) AS sum_q, avg(l_quantity) AS mean_q,
 median(l_extendedprice) AS median_p, min(l_tax) AS min_t, max(l_tax) AS max_t
FROM (SELECT * REPLACE (CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_linestatus END AS l_linestatus) FROM ({GAPS_SQL})) GROUP BY 1, 2""",
       {"sum_q": 2, "mean_q": 4, "median_p": 4, "min_t": 4, "max_t": 4})
def _(t: Tables):
    base = with_gaps(t.lineitem).withColumn("l_linestatus", F.when(F.col("l_linestatus") != "O", F.col("l_linestatus")))
    return A.aggregate(base, A.Plan(["l_returnflag", "l_linestatus"], [
        M("n", None, "count"), M("sum_q", "l_quantity", "sum"), M("mean_q", "l_quantity", "mean"),
        M("median_p", "l_extendedprice", "median"), M("min_t", "l_tax", "min"), M("max_t", "l_tax", "max"),
    ]))


@query("a2_plain_aggregate", f"""
SELECT CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS l_shipdate_week, l_returnflag, count(l_quantity) AS count_l_quantity,
 coalesce(sum(l_quantity), 0) AS qty, avg(l_extendedprice) AS mean_l_extendedprice FROM ({GAPS_SQL}) GROUP BY 1, 2""", {"qty": 2, "mean_l_extendedprice": 6})
def _(t: Tables):
    return A.aggregate_plain(
        with_gaps(t.lineitem), ["l_returnflag"], [("l_quantity", "count"), ("l_quantity", "sum", "qty"), ("l_extendedprice", "mean")], "l_shipdate"
    )


def _bucket_query(name: str, grain: str):
    @query(name, f"SELECT CAST(date_trunc('{grain}', ts) AS TIMESTAMP) AS time_bucket, event_type, avg(value) AS mean_value, count(*) AS n_records FROM events GROUP BY 1, 2", {"mean_value": 6})
    def _(t: Tables):
        return A.aggregate(t.events, A.Plan(["event_type", "ts"], [M("mean_value", "value", "mean")], "ts", grain))


for _grain in A.GRAINS:
    _bucket_query(f"a3_time_bucket_{_grain}", _grain)


@query("a4_support_added", "SELECT l_suppkey, max(l_quantity) AS max_q, count(*) AS n_records FROM lineitem GROUP BY 1", {"max_q": 2})
def _(t: Tables):
    return A.aggregate(t.lineitem, A.Plan(["l_suppkey"], [M("max_q", "l_quantity", "max")]))


@query("a5_support_counts", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS time_bucket, event_type, count(*) AS n_records FROM events GROUP BY 1, 2")
def _(t: Tables):
    return A.support_counts(t.events, ["event_type"], "ts", "day")


@query("a5_support_totals", "SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS total_records FROM (SELECT count(*) AS n FROM events GROUP BY date_trunc('day', ts), event_type)")
def _(t: Tables):
    return A.support_totals(A.support_counts(t.events, ["event_type"], "ts", "day"))


USERS = "SELECT user_id, count(*) AS n FROM events GROUP BY 1"


@query("a6_support_quality", f"""
SELECT count(*) AS n_points, CAST(min(n) AS BIGINT) AS min_n, quantile_cont(n, 0.1) AS p10_n, quantile_cont(n, 0.5) AS median_n,
 CAST(count(*) FILTER (n < 5) AS BIGINT) AS low_n_lt5, CAST(count(*) FILTER (n < 10) AS BIGINT) AS low_n_lt10 FROM ({USERS})""", {"p10_n": 4, "median_n": 4})
def _(t: Tables):
    return A.support_quality(A.support_counts(t.events, ["user_id"]))


@query("a7_sort_and_limit", """
SELECT l_suppkey, sum(l_extendedprice) AS revenue, count(*) AS n_records FROM lineitem GROUP BY 1 ORDER BY revenue DESC NULLS LAST, l_suppkey LIMIT 15""", {"revenue": 2})
def _(t: Tables):
    return A.aggregate(t.lineitem, A.Plan(["l_suppkey"], [M("revenue", "l_extendedprice", "sum")], sort_by="revenue", descending=True, limit=15))


STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, stddev_pop({c}) AS std_pop, min({c}) AS min, max({c}) AS max, "
    f"quantile_cont({c}, 0.05) AS p05, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.99) AS p99 FROM ({GAPS_SQL})"
    for c in ("l_quantity", "l_extendedprice", "l_tax"))
STAT_DIGITS = {c: 4 for c in ("mean", "std", "std_pop", "min", "max", "p05", "p50", "p99")}


@query("a8_global_stats", STATS, STAT_DIGITS)
def _(t: Tables):
    return A.global_stats(with_gaps(t.lineitem), ["l_quantity", "l_extendedprice", "l_tax"], [0.05, 0.5, 0.99])


@query("a8_quantiles_by_counting", """
SELECT l_returnflag, quantile_cont(l_extendedprice, 0.01) AS p01, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.999) AS p999,
 quantile_cont(l_quantity, 0.5) AS q50 FROM (%s) GROUP BY 1""" % GAPS_SQL, {"p01": 4, "p50": 4, "p999": 4, "q50": 4})
def _(t: Tables):
    """The route for large inputs, forced: the same quantiles by counting and running sums."""
    q = A.quantiles(with_gaps(t.lineitem), ["l_extendedprice", "l_quantity"], [0.01, 0.5, 0.999], ["l_returnflag"])
    p = F.col("l_extendedprice")
    return q.select("l_returnflag", p[0].alias("p01"), p[1].alias("p50"), p[2].alias("p999"), F.col("l_quantity")[1].alias("q50"))


@query("a8_quantiles_by_bracket", """
SELECT quantile_cont(l_extendedprice, 0.01) AS p01, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.999) AS p999, quantile_cont(l_quantity, 0.5) AS q50 FROM (%s)""" % GAPS_SQL,
       {"p01": 4, "p50": 4, "p999": 4, "q50": 4})
def _(t: Tables):
    """The route for large inputs without keys, forced: a sketch, a proof by counts, the few values between."""
    q = A.quantiles(with_gaps(t.lineitem), ["l_extendedprice", "l_quantity"], [0.01, 0.5, 0.999])
    p = F.col("l_extendedprice")
    return q.select(p[0].alias("p01"), p[1].alias("p50"), p[2].alias("p999"), F.col("l_quantity")[1].alias("q50"))


@query("a9_distinct_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM ({GAPS_SQL})" for c in ("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")))
def _(t: Tables):
    return A.distinct_counts(with_gaps(t.lineitem), ["l_orderkey", "l_partkey", "l_quantity", "l_returnflag"])


@query("a10_value_counts", """
WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS k FROM c),
 b AS (SELECT value, n FROM r WHERE k <= 10 UNION ALL SELECT '(other)', CAST(sum(n) AS BIGINT) FROM r WHERE k > 10)
SELECT value, n, n / (SELECT sum(n) FROM b) AS share FROM b""", {"share": 6})
def _(t: Tables):
    return A.value_counts(t.part, "p_brand", 10)


@query("a11_weighted_mean", f"""
SELECT l_returnflag, sum(coalesce(l_quantity, 0) * l_discount) / sum(coalesce(l_quantity, 0)) AS weighted_mean, sum(coalesce(l_quantity, 0)) AS support
FROM ({GAPS_SQL}) GROUP BY 1""", {"weighted_mean": 6, "support": 2})
def _(t: Tables):
    return A.weighted_mean(with_gaps(t.lineitem), "l_discount", "l_quantity", ["l_returnflag"])


@query("a12_rate_table", "SELECT l_linestatus, l_returnflag, avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0 END) AS rate, count(*) AS n FROM lineitem GROUP BY 1, 2", {"rate": 6})
def _(t: Tables):
    return A.rate_table(t.lineitem, ["l_linestatus", "l_returnflag"], F.col("l_quantity") > 25)


MONTHS = "SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS time_bucket, l_returnflag, avg(l_extendedprice) AS y, count(*) AS n_records FROM lineitem GROUP BY 1, 2"


def monthly(t: Tables):
    return A.aggregate(t.lineitem, A.Plan(["l_returnflag"], [M("y", "l_extendedprice", "mean")], "l_shipdate", "month"))


@query("a13_first_last", f"""
SELECT l_returnflag, arg_min(y, time_bucket) AS start, arg_max(y, time_bucket) AS "end", arg_max(y, time_bucket) - arg_min(y, time_bucket) AS delta
FROM ({MONTHS}) GROUP BY 1""", {"start": 4, "end": 4, "delta": 4})
def _(t: Tables):
    return A.first_last(monthly(t), "time_bucket", "y", ["l_returnflag"])


@query("a14_support_extremes", """
WITH c AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS time_bucket, event_type, count(*) AS n_records FROM events GROUP BY 1, 2)
SELECT * FROM (SELECT *, 'lowest' AS side FROM c ORDER BY n_records, time_bucket, event_type LIMIT 3)
UNION ALL SELECT * FROM (SELECT *, 'highest' AS side FROM c ORDER BY n_records DESC, time_bucket, event_type LIMIT 3)""")
def _(t: Tables):
    return A.support_extremes(A.support_counts(t.events, ["event_type"], "ts", "day"))


# --- series -----------------------------------------------------------------------------------

WEEKS = """SELECT o_orderpriority, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS t, sum(o_totalprice) AS y, count(*) AS n_records
FROM orders GROUP BY 1, 2"""
KEY = ["o_orderpriority"]


def weekly(t: Tables):
    return W.build_series(t.orders, KEY, "o_orderdate", "o_totalprice", "week")


def _lag_sql() -> str:
    return ", ".join(f"lag(y, {n}) OVER w AS lag_{n}" for n in W.LAGS)


def _roll_sql() -> str:
    out = []
    for n in W.WINDOWS:
        for f, s in (("avg", "mean"), ("stddev_samp", "std")):
            over = f"OVER (PARTITION BY o_orderpriority ORDER BY t ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
            out.append(f"CASE WHEN count(y) {over} = {n} THEN {f}(y) {over} END AS roll_{s}_{n}")
    return ", ".join(out)


LAG_COLS = [f"lag_{n}" for n in W.LAGS]
ROLL_COLS = [f"roll_{s}_{n}" for n in W.WINDOWS for s in ("mean", "std")]
WIN = "WINDOW w AS (PARTITION BY o_orderpriority ORDER BY t)"
SUPERVISED = f"SELECT * FROM (SELECT *, {_lag_sql()}, {_roll_sql()} FROM ({WEEKS}) {WIN}) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in LAG_COLS + ROLL_COLS)


@query("w1_lags", f"SELECT *, {_lag_sql()} FROM ({WEEKS}) {WIN}", {c: 2 for c in ["y", *LAG_COLS]})
def _(t: Tables):
    return W.lag_features(weekly(t), KEY)


@query("w2_rolling", f"SELECT *, {_roll_sql()} FROM ({WEEKS})", {c: 4 for c in ["y", *ROLL_COLS]})
def _(t: Tables):
    return W.rolling_features(weekly(t), KEY)


@query("w3_supervised", SUPERVISED, {c: 4 for c in ["y", *LAG_COLS, *ROLL_COLS]})
def _(t: Tables):
    return W.supervised(weekly(t), KEY)


@query("w4_chronological_split", f"""
SELECT o_orderpriority, t, CAST(row_number() OVER w AS INTEGER) AS position,
 row_number() OVER w <= greatest(10, CAST(floor(0.8 * count(*) OVER (PARTITION BY o_orderpriority)) AS INTEGER)) AS is_train
FROM ({SUPERVISED}) {WIN}""")
def _(t: Tables):
    return W.chronological_split(W.supervised(weekly(t), KEY), KEY).select("o_orderpriority", "t", "position", "is_train")


@query("w5_cumulative_share", """
WITH g AS (SELECT l_returnflag, l_linestatus, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2),
 r AS (SELECT *, s / (SELECT sum(s) FROM g) AS share, row_number() OVER (ORDER BY s DESC) AS rank FROM g)
SELECT l_returnflag, l_linestatus, CAST(rank AS INTEGER) AS rank, share, sum(share) OVER (ORDER BY rank) AS cum_share FROM r""", {"share": 6, "cum_share": 6})
def _(t: Tables):
    g = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_extendedprice").alias("s"))
    total = N.one_row(g.agg(F.sum("s").alias("s")))["s"]
    ranked = W.running(g.withColumn("share", F.col("s") / total), [F.col("s").desc(), F.col("l_returnflag"), F.col("l_linestatus")], number="rank")
    return W.cumulative_share(ranked.drop("s").withColumn("rank", F.col("rank").cast("int")), "share", "rank")


@query("w6_recent_slope", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY t DESC) AS rn FROM ({WEEKS})),
 x AS (SELECT *, count(*) OVER p - rn AS x, median(y) OVER p AS med FROM r WHERE rn <= 10 WINDOW p AS (PARTITION BY o_orderpriority)),
 d AS (SELECT *, median(abs(y - med)) OVER (PARTITION BY o_orderpriority) AS mad FROM x),
 k AS (SELECT *, mad = 0 OR abs(0.6745 * (y - med) / mad) <= 4 AS near FROM d),
 n AS (SELECT *, count(*) FILTER (near) OVER (PARTITION BY o_orderpriority) AS nn FROM k),
 f AS (SELECT o_orderpriority, count(*) AS n, regr_slope(y, x) AS s, stddev_pop(y) AS sd FROM n WHERE near OR nn < 3 GROUP BY 1)
SELECT o_orderpriority, CASE WHEN n < 3 THEN 0.0 WHEN sd > 0 THEN greatest(-2.5 * sd, least(2.5 * sd, s)) ELSE coalesce(s, 0) END AS slope FROM f""", {"slope": 2})
def _(t: Tables):
    return W.recent_slope(weekly(t), KEY)


def _calendar_query(grain: str):
    unit = {"day": "1 DAY", "week": "7 DAY", "month": "1 MONTH", "quarter": "3 MONTH", "year": "1 YEAR"}[grain]
    sql = f"""
SELECT o_orderstatus, last_t, CAST(step AS INTEGER) AS step, CAST(date_trunc('{grain}', last_t) + step * INTERVAL '{unit}' AS TIMESTAMP) AS t
FROM (SELECT o_orderstatus, max(o_orderdate) AS last_t FROM orders GROUP BY 1), range(1, 9) AS s(step)"""

    @query(f"w7_future_calendar_{grain}", sql)
    def _(t: Tables):
        return W.future_calendar(t.orders.select("o_orderstatus", F.col("o_orderdate").alias("t")), ["o_orderstatus"], grain, 8)


for _grain in A.GRAINS:
    _calendar_query(_grain)


@query("w8_scaled_support", """
WITH c AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS time_bucket, event_type, count(*) AS n_records FROM events GROUP BY 1, 2)
SELECT *, 25 + (n_records - (SELECT min(n_records) FROM c)) * 155.0 / ((SELECT max(n_records) FROM c) - (SELECT min(n_records) FROM c)) AS scaled FROM c""", {"scaled": 4})
def _(t: Tables):
    return W.scaled_support(A.support_counts(t.events, ["event_type"], "ts", "day"))


@query("w9_trend_table", f"SELECT time_bucket, y, l_returnflag, n_records FROM ({MONTHS})", {"y": 6})
def _(t: Tables):
    return W.trend_table(monthly(t), "time_bucket", "y", "l_returnflag")


def _trend_sql(scope: str, label: str, group: str) -> str:
    return f"""SELECT '{scope}' AS scope, {label} AS series, count(*) AS n_points, avg(y) AS mean, min(y) AS min, max(y) AS max,
 arg_min(y, (time_bucket, y)) AS start, arg_max(y, (time_bucket, y)) AS "end", arg_max(y, (time_bucket, y)) - arg_min(y, (time_bucket, y)) AS delta,
 min(time_bucket) AS x_start, max(time_bucket) AS x_end, quantile_cont(y, 0.05) AS p05, median(y) AS median, quantile_cont(y, 0.95) AS p95
FROM ({MONTHS}) {group}"""


@query("w10_trend_stats", _trend_sql("global", "'(all)'", "") + " UNION ALL " + _trend_sql("group", "l_returnflag", "GROUP BY l_returnflag"),
       {c: 4 for c in ("mean", "min", "max", "start", "end", "delta", "p05", "median", "p95")})
def _(t: Tables):
    return W.trend_stats(monthly(t), "time_bucket", "y", ["l_returnflag"])


# --- joins ------------------------------------------------------------------------------------


@query("j1_join_support", """
WITH a AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS time_bucket, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS event_type, avg(value) AS mean_value FROM events GROUP BY 1, 2),
 c AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS time_bucket, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS event_type, count(*) AS n_records FROM events GROUP BY 1, 2)
SELECT a.time_bucket, a.event_type, a.mean_value, c.n_records FROM a LEFT JOIN c ON a.time_bucket = c.time_bucket AND a.event_type IS NOT DISTINCT FROM c.event_type""", {"mean_value": 6})
def _(t: Tables):
    e = t.events.withColumn("event_type", F.when(F.col("event_type") != "error", F.col("event_type")))
    means = A.aggregate(e, A.Plan(["event_type"], [M("mean_value", "value", "mean")], "ts", "day"), add_support=False)
    return join_support(means, A.support_counts(e, ["event_type"], "ts", "day"))


@query("j2_means_with_support", """
SELECT g.l_returnflag, g.mean, s.support FROM (SELECT l_returnflag, avg(l_extendedprice) AS mean FROM lineitem GROUP BY 1) g
LEFT JOIN (SELECT l_returnflag, sum(l_quantity) AS support FROM lineitem GROUP BY 1) s ON g.l_returnflag = s.l_returnflag""", {"mean": 4, "support": 2})
def _(t: Tables):
    """One grouping gives both sides of the join."""
    return t.lineitem.groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("mean"), F.sum("l_quantity").alias("support"))


FIRST_LINE = """SELECT l_orderkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem WHERE l_linenumber = 1 GROUP BY 1"""


def first_lines(t: Tables):
    return t.lineitem.filter("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"))


@query("j3_join_baseline", f"""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_returnflag, b.l_returnflag AS l_returnflag_base, b.l_orderkey IS NOT NULL AS has_base
FROM lineitem l LEFT JOIN ({FIRST_LINE}) b ON l.l_orderkey = b.l_orderkey WHERE l.l_linenumber > 1""")
def _(t: Tables):
    variants = t.lineitem.filter("l_linenumber > 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return U.join_baseline(variants, first_lines(t), ["l_orderkey"], ["l_returnflag"])


@query("j4_join_column_lists", """
WITH b AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY 1)
SELECT o.o_orderkey AS l_orderkey, o.o_orderstatus, array_to_string(b.flags, ',') AS flags_base, b.l_orderkey IS NOT NULL AS has_base FROM orders o LEFT JOIN b ON o.o_orderkey = b.l_orderkey""")
def _(t: Tables):
    """Orders with the list of flags of all their lines."""
    base = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))
    return U.join_baseline(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), base, ["l_orderkey"], ["flags"], check=False)


@query("j5_features_and_target", f"SELECT o_orderpriority, t, y, lag_1, roll_mean_3 FROM (SELECT *, {_lag_sql()}, {_roll_sql()} FROM ({WEEKS}) {WIN})", {"y": 2, "lag_1": 2, "roll_mean_3": 4})
def _(t: Tables):
    """Features and target stay on the same row, so no join is made."""
    return W.rolling_features(W.lag_features(weekly(t), KEY), KEY).select("o_orderpriority", "t", "y", "lag_1", "roll_mean_3")


@query("j6_compare_counts", """
SELECT coalesce(a.k, b.k) AS nation, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b FROM
(SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k""")
def _(t: Tables):
    """Customers and suppliers of each nation; some have only one of them."""
    def counts(df, key):
        return df.groupBy(F.col(key).alias("nation")).agg(F.count(F.lit(1)).alias("n"))

    return U.compare_counts(counts(t.customer, "c_nationkey"), counts(t.supplier, "s_nationkey"), "nation")


@query("j7_baseline_missing", f"""
SELECT o.o_orderkey, CASE WHEN b.l_orderkey IS NULL THEN 'baseline_missing' ELSE '' END AS note, b.l_linestatus AS l_linestatus_base
FROM orders o LEFT JOIN ({FIRST_LINE}) b ON o.o_orderkey = b.l_orderkey""")
def _(t: Tables):
    base = first_lines(t).withColumnRenamed("l_orderkey", "o_orderkey")
    joined = U.join_baseline(t.orders.select("o_orderkey"), base, ["o_orderkey"], ["l_linestatus"])
    return joined.select("o_orderkey", F.when(F.col("has_base"), F.lit("")).otherwise(F.lit("baseline_missing")).alias("note"), "l_linestatus_base")


# --- sorting and top-k ------------------------------------------------------------------------


@query("t1_nulls_last", f"SELECT l_suppkey, min(l_quantity) AS q, count(*) AS n_records FROM ({GAPS_SQL}) GROUP BY 1 ORDER BY q ASC NULLS LAST, l_suppkey", {"q": 2})
def _(t: Tables):
    return A.aggregate(with_gaps(t.lineitem), A.Plan(["l_suppkey"], [M("q", "l_quantity", "min")], sort_by="q"))


@query("t2_head", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey LIMIT 25", {"l_extendedprice": 2})
def _(t: Tables):
    cols = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    return A.sort_and_limit(cols, "l_extendedprice", True, 25)


@query("t3_top_groups", "SELECT p_brand AS value, avg(p_retailprice) AS mean, count(*) AS n FROM part GROUP BY 1 ORDER BY mean DESC, value LIMIT 20", {"mean": 4})
def _(t: Tables):
    return A.top_groups_by_mean(t.part, "p_brand", "p_retailprice", 20)


CROSS_SQL = """
WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {table} GROUP BY 1, 2),
 r AS (SELECT a FROM c GROUP BY 1 ORDER BY sum(n) DESC, a LIMIT {k}),
 k AS (SELECT b FROM c WHERE a IN (SELECT a FROM r) GROUP BY 1 ORDER BY sum(n) DESC, b LIMIT {k}),
 g AS (SELECT r.a, k.b, coalesce(c.n, 0) AS n FROM r CROSS JOIN k LEFT JOIN c ON c.a = r.a AND c.b = k.b)
SELECT a, b, n, CASE WHEN sum(n) OVER (PARTITION BY a) = 0 THEN 0.0 ELSE n / sum(n) OVER (PARTITION BY a) END AS share FROM g"""


@query("t4_top_rows_and_columns", CROSS_SQL.format(a="p_brand", b="p_name", table="part", k=20), {"share": 6})
def _(t: Tables):
    return crosstab(t.part, "p_brand", "p_name")


@query("t5_best_per_key", """
WITH g AS (SELECT 'l_returnflag' AS feature, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2
 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2)
SELECT feature, value, n FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY abs(n) DESC, value) AS k FROM g) WHERE k = 1""")
def _(t: Tables):
    g = by_dimension(t.lineitem, ["l_returnflag", "l_linestatus"], {"n": F.count(F.lit(1))})
    return best_per_key(g, "feature", F.abs("n"), "value")


# --- reshaping --------------------------------------------------------------------------------

SYSTEMS = "SELECT *, CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'done' END AS system FROM lineitem"


@query("u1_union_all", """
SELECT l_orderkey, l_linenumber, 'flag' AS source, l_returnflag AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'status', l_linestatus FROM lineitem""")
def _(t: Tables):
    keys = ["l_orderkey", "l_linenumber"]
    return U.union_all([
        t.lineitem.select(*keys, F.lit("flag").alias("source"), F.col("l_returnflag").alias("v")),
        t.lineitem.select(F.col("l_linestatus").alias("v"), *keys, F.lit("status").alias("source")),
    ])


@query("u2_missing_ids", """
SELECT g.l_returnflag, i.l_suppkey, i.l_linenumber FROM (SELECT DISTINCT l_returnflag FROM lineitem) g
CROSS JOIN (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem) i
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_returnflag = g.l_returnflag AND l.l_suppkey = i.l_suppkey AND l.l_linenumber = i.l_linenumber)""")
def _(t: Tables):
    pairs = t.lineitem.select("l_returnflag", F.struct("l_suppkey", "l_linenumber").alias("id"))
    return U.missing_ids(pairs, "l_returnflag", "id").select("l_returnflag", "id.*")


@query("u3_duplicate_ids", "SELECT l_returnflag, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t: Tables):
    return U.duplicate_ids(t.lineitem, "l_returnflag", "l_partkey")


@query("u3_id_report", """
SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_unique_ids, CAST(count(*) FILTER (n > 1) AS BIGINT) AS n_duplicate_ids,
 (SELECT count(DISTINCT l_partkey) FROM lineitem) - count(*) AS n_missing_ids FROM (SELECT l_returnflag, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def _(t: Tables):
    return U.id_report(t.lineitem, "l_returnflag", "l_partkey")


@query("u4_first_per_key", """
SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1""")
def _(t: Tables):
    return first_per_key(t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber"), ["l_partkey"], ["l_orderkey", "l_linenumber"])


@query("u5_set_tests", """
WITH s AS (SELECT l_orderkey, list(DISTINCT l_linestatus) AS f FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_sort(f) = [o_orderstatus] AS same, list_has_all(f, [o_orderstatus]) AS contained FROM s JOIN orders ON o_orderkey = l_orderkey""")
def _(t: Tables):
    """The states of all lines of an order against the state of the order itself."""
    s = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_linestatus").alias("f"))
    s = s.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("h", F.array("o_orderstatus"))
    return s.select("l_orderkey", U.same_set(F.col("f"), F.col("h")).alias("same"), U.subset(F.col("h"), F.col("f")).alias("contained"))


@query("u6_melt", f"""
SELECT l_orderkey, l_linenumber, 'l_discount' AS system, l_discount AS score FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_quantity', l_quantity FROM ({GAPS_SQL}) WHERE l_quantity IS NOT NULL""", {"score": 4})
def _(t: Tables):
    base = with_gaps(t.lineitem).withColumn("l_discount", F.col("l_discount").cast("string"))
    return U.melt(base, ["l_orderkey", "l_linenumber"], ["l_discount", "l_quantity", "l_returnflag"])


@query("u7_pivot", """
SELECT l_linenumber, avg(l_quantity) FILTER (l_returnflag = 'R') AS R, avg(l_quantity) FILTER (l_returnflag = 'A') AS A, avg(l_quantity) FILTER (l_returnflag = 'N') AS N
FROM lineitem GROUP BY 1""", {"R": 4, "A": 4, "N": 4})
def _(t: Tables):
    return U.pivot_mean(t.lineitem, ["l_linenumber"], "l_returnflag", "l_quantity", ["R", "A", "N"])


@query("u8_row_mean", f"""
SELECT l_orderkey, l_linenumber, round((coalesce(l_quantity, 0) + l_linenumber + l_suppkey) / (2 + CAST(l_quantity IS NOT NULL AS INTEGER)), 2) AS m FROM ({GAPS_SQL})""")
def _(t: Tables):
    base = with_gaps(t.lineitem)
    return base.select("l_orderkey", "l_linenumber", U.row_mean(base, ["l_quantity", "l_linenumber", "l_suppkey"]).alias("m"))


@query("u9_row_min", "SELECT l_orderkey, l_linenumber, least(l_discount, l_tax) AS m FROM lineitem", {"m": 4})
def _(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", U.row_min(["l_discount", "l_tax"]).alias("m"))


@query("u10_one_hot", f"""
WITH b AS (SELECT o_orderkey, coalesce(o_orderpriority, '(missing)') AS p FROM ({ORDER_GAPS_SQL}))
SELECT o_orderkey, CAST(p NOT IN (SELECT p FROM b GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3) AS INTEGER) AS other FROM b""")
def _(t: Tables):
    return U.one_hot(with_order_gaps(t.orders), "o_orderpriority", 3, "p").select("o_orderkey", F.col("`p_(other)`").alias("other"))


@query("u10_one_hot_levels", f"""
WITH b AS (SELECT o_orderkey, coalesce(o_orderpriority, '(missing)') AS p FROM ({ORDER_GAPS_SQL})), k AS (SELECT p FROM b GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)
SELECT o_orderkey, 'p_' || CASE WHEN p IN (SELECT p FROM k) THEN p ELSE '(other)' END AS set_column, 1 AS n_set, (SELECT count(*) FROM k) + 1 AS n_columns FROM b""")
def _(t: Tables):
    """The name of the one column that is set in each row, over all columns made."""
    wide = U.one_hot(with_order_gaps(t.orders).select("o_orderkey", "o_orderpriority"), "o_orderpriority", 3, "p")
    made = [c for c in wide.columns if c.startswith("p_")]
    named = F.concat_ws("", *[F.when(F.col(f"`{c}`") == 1, F.lit(c)) for c in made])
    return wide.select("o_orderkey", named.alias("set_column"), sum((F.col(f"`{c}`") for c in made), F.lit(0)).alias("n_set"), F.lit(len(made)).cast("bigint").alias("n_columns"))


# --- scalar functions -------------------------------------------------------------------------


@query("x1_strip_lower", "SELECT c_custkey, lower(trim('  ' || c_mktsegment || chr(9), ' ' || chr(9))) AS v FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", X.normal(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("\t"))).alias("v"))


@query("x2_short_label", "SELECT c_custkey, CASE WHEN length(v) <= 20 THEN v ELSE substr(v, 1, 20) || ' [...]' END AS v FROM (SELECT c_custkey, c_name || ' ' || c_mktsegment AS v FROM customer)")
def _(t: Tables):
    return t.customer.select("c_custkey", X.short_label(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("v"))


@query("x3_labels", f"""
SELECT o_orderstatus || '=' || coalesce(o_orderpriority, '(missing)') || ' (n=' || count(*) || ')' AS label, o_orderstatus || ' | ' || coalesce(o_orderpriority, '(missing)') AS pair
FROM ({ORDER_GAPS_SQL}) GROUP BY o_orderstatus, o_orderpriority""")
def _(t: Tables):
    g = with_order_gaps(t.orders).groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    pair = F.concat_ws(" | ", "o_orderstatus", F.coalesce("o_orderpriority", F.lit("(missing)")))
    return g.select(X.driver_label("o_orderstatus", "o_orderpriority", "n").alias("label"), pair.alias("pair"))


@query("x4_number_formats", """
SELECT c_custkey, format('{:+.1f}', c_acctbal + 0.03) || 'pp' AS pp,
 CASE WHEN abs(c_acctbal) >= 1000 THEN format('{:,.2f}', c_acctbal) WHEN abs(c_acctbal) >= 10 THEN format('{:.2f}', c_acctbal)
  ELSE regexp_replace(format('{:.4f}', c_acctbal), '\\.?0+$', '') END AS short FROM customer""")
def _(t: Tables):
    return t.customer.select("c_custkey", X.signed_percent_points(F.col("c_acctbal") + 0.03).alias("pp"), X.short_number("c_acctbal").alias("short"))


@query("x5_regex", """
SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z]+')) AS n_words, length(regexp_replace(text, '\\s+', ' ', 'g')) AS n_squeezed,
 len(string_split(text, chr(10))) AS n_lines, regexp_matches(text, '(?i)license') AS has_license FROM documents""")
def _(t: Tables):
    x = F.col("text")
    return t.documents.select(
        "doc_id", F.size(F.regexp_extract_all(F.lower(x), F.lit("([a-z]+)"), 1)).cast("bigint").alias("n_words"), F.length(F.regexp_replace(x, r"\s+", " ")).cast("bigint").alias("n_squeezed"),
        F.size(F.split(x, "\n")).cast("bigint").alias("n_lines"), x.rlike("(?i)license").alias("has_license"),
    )


@query("x6_sorted_names", """
SELECT p_partkey, array_to_string(list_sort(list_filter(list_transform(string_split(lower(p_type || ' ,' || p_name || ', ' || p_brand || ',,'), ','), lambda x: trim(x)), lambda x: x <> '')), '|') AS names FROM part""")
def _(t: Tables):
    text = F.concat("p_type", F.lit(" ,"), "p_name", F.lit(", "), "p_brand", F.lit(",,"))
    return t.part.select("p_partkey", F.array_join(X.sorted_names(text), "|").alias("names"))


@query("x7_humanize", "SELECT event_id, upper(substr(v, 1, 1)) || substr(v, 2) AS v FROM (SELECT event_id, trim(replace(event_type || '_by_user', '_', ' ')) AS v FROM events)")
def _(t: Tables):
    return t.events.select("event_id", X.humanize(F.concat("event_type", F.lit("_by_user"))).alias("v"))


@query("x8_math", """
SELECT c_custkey, abs(c_acctbal) AS a, sqrt(abs(c_acctbal)) AS s, ln(1 + abs(c_acctbal)) AS l, floor(c_acctbal) AS f, ceil(c_acctbal) AS c,
 round_even(c_acctbal, 0) AS r, greatest(0, least(c_acctbal, 5000)) AS clipped FROM customer""", {c: 4 for c in ("a", "s", "l", "f", "c", "r", "clipped")})
def _(t: Tables):
    x = F.col("c_acctbal")
    return t.customer.select(
        "c_custkey", F.abs(x).alias("a"), F.sqrt(F.abs(x)).alias("s"), F.log1p(F.abs(x)).alias("l"), F.floor(x).cast("double").alias("f"),
        F.ceil(x).cast("double").alias("c"), F.rint(x).alias("r"), N.clip(x, F.lit(0.0), F.lit(5000.0)).alias("clipped"),
    )


@query("x9_safe_ratio", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 0.0 ELSE l_tax / l_discount END AS r, CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END AS s FROM lineitem", {"r": 4, "s": 4})
def _(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", N.ratio(F.col("l_tax"), F.col("l_discount"), 0.0).alias("r"), N.ratio(F.col("l_discount"), F.col("l_tax")).alias("s"))


@query("x10_whole_numbers", "SELECT c_custkey, abs(c_acctbal - round_even(c_acctbal, 0)) <= 1e-9 + 1e-5 * abs(round_even(c_acctbal, 0)) AS w FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", N.whole("c_acctbal").alias("w"))


@query("x11_dates", """
SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, CAST(date_trunc('quarter', ts) AS TIMESTAMP) AS quarter, year(ts) = 2024 AS in_2024, strftime(ts, '%Y-%m-%d') AS iso FROM events""")
def _(t: Tables):
    ts = A.as_time(t.events, "ts")
    return t.events.select(
        "event_id", A.bucket_start(ts, "day").alias("day"), A.bucket_start(ts, "quarter").alias("quarter"),
        (F.year(ts) == 2024).alias("in_2024"), F.date_format(ts, "yyyy-MM-dd").alias("iso"),
    )


@query("x12_nulls", f"""
SELECT o_orderkey, coalesce(o_orderpriority, '(missing)') AS p, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS masked FROM ({ORDER_GAPS_SQL})""", {"masked": 2})
def _(t: Tables):
    return with_order_gaps(t.orders).select(
        "o_orderkey", X.as_label("o_orderpriority").alias("p"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("masked")
    )


@query("x13_arrays", """
SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS lines, count(DISTINCT l_linenumber) AS n,
 array_to_string(list_sort(list_filter(list(DISTINCT l_linenumber), lambda x: x NOT IN (1, 2))), ',') AS later FROM lineitem GROUP BY 1""")
def _(t: Tables):
    s = F.array_sort(F.array_distinct(F.collect_list("l_linenumber")))
    g = t.lineitem.groupBy("l_orderkey").agg(s.alias("s"))
    later = F.array_sort(F.array_except("s", F.array(F.lit(1), F.lit(2))))
    return g.select("l_orderkey", F.array_join("s", ",").alias("lines"), F.size("s").cast("bigint").alias("n"), F.array_join(later, ",").alias("later"))


@query("x14_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
def _(t: Tables):
    return t.events.select(
        "event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.get_json_object("props", "$.none").alias("none")
    )


@query("x15_units", """
SELECT p_partkey, CASE WHEN contains(n, '_min') THEN 'min' WHEN contains(n, '_h') THEN 'h' WHEN contains(n, 'price') THEN '€' END AS by_name,
 CASE WHEN p_size > 40 THEN 'days' WHEN p_size > 20 THEN 'hours' END AS by_text, 'length of a ' || p_name AS label
FROM (SELECT *, CASE p_type WHEN 'ECONOMY' THEN 'run_min' WHEN 'PROMO' THEN 'run_hours' WHEN 'STANDARD' THEN 'price' ELSE p_type END AS n FROM part)""")
def _(t: Tables):
    ty = F.col("p_type")
    name = F.when(ty == "ECONOMY", "run_min").when(ty == "PROMO", "run_hours").when(ty == "STANDARD", "price").otherwise(ty)
    remark = F.when(F.col("p_size") > 40, "(in  days )").when(F.col("p_size") > 20, "(per shift, hour by hour)").otherwise("")
    text = F.concat(F.lit("length of a "), "p_name", F.lit(" "), remark)
    return t.part.select("p_partkey", X.unit_from_name(name).alias("by_name"), X.unit_from_description(text).alias("by_text"), X.label_from_description(text).alias("label"))

"""Queries of sections 2.12 and 2.13: descriptive and diagnostic analyses, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions import roles
from tabulon.operators import aggregate as A
from tabulon.operators import descriptive as N
from tabulon.operators import diagnostic as G
from tabulon.operators import verify as V
from tabulon.operators.clean import drop_incomplete
from tabulon.operators.predicates import Condition, where_guarded
from tabulon.plans.registry import analyse
from tabulon.plans.catalog.base import FLAT_SQL, GAPS_SQL, Tables, flat, query, with_gaps

# A skewed metric: price times discount, with its square root as a second one.
NET_SQL = "SELECT *, l_extendedprice * l_discount * l_discount AS cut FROM lineitem"


def net(t: Tables):
    return t.lineitem.withColumn("cut", F.col("l_extendedprice") * F.col("l_discount") * F.col("l_discount"))


def q_sql(c: str, source: str) -> str:
    return f"SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM ({source})"


def fence_sql(c: str, source: str, k: float = 1.5) -> str:
    return f"SELECT q1, q3, q1 - {k} * (q3 - q1) AS low, q3 + {k} * (q3 - q1) AS high FROM ({q_sql(c, source)})"


@query("n1_fences", f"""
SELECT count(cut) >= 30 AS ok, count(cut) AS n_valid, max(q1) AS q1, max(q3) AS q3, max(q3 - q1) AS iqr, max(low) AS low, max(high) AS high,
 CAST(count(*) FILTER (cut < low OR cut > high) AS BIGINT) AS outlier_count, avg(CASE WHEN cut < low OR cut > high THEN 1.0 ELSE 0 END) AS outlier_frac,
 min(cut) AS min, max(cut) AS max, CAST(count(*) FILTER (cut BETWEEN low AND high) AS BIGINT) AS n_between
FROM ({NET_SQL}), ({fence_sql('cut', NET_SQL)})""", {c: 4 for c in ("q1", "q3", "iqr", "low", "high", "outlier_frac", "min", "max")})
def _(t: Tables):
    return N.fences(net(t), "cut")


@query("n2_rare_outliers", f"""
WITH f AS ({fence_sql('l_extendedprice', 'lineitem', 0.7)}), o AS (SELECT avg(CASE WHEN l_extendedprice < low OR l_extendedprice > high THEN 1.0 ELSE 0 END) AS share FROM lineitem, f)
SELECT l_orderkey, l_linenumber FROM lineitem, f, o WHERE NOT (share > 0 AND share <= 0.02) OR l_extendedprice BETWEEN low AND high""")
def _(t: Tables):
    return N.without_rare_outliers(t.lineitem, "l_extendedprice", k=0.7).select("l_orderkey", "l_linenumber")


@query("n2_common_outliers_stay", "SELECT l_orderkey, l_linenumber FROM lineitem")
def _(t: Tables):
    return N.without_rare_outliers(net(t), "cut").select("l_orderkey", "l_linenumber")


VIEW = ("low_view", "high_view", "mean_in_view")


@query("n3_view_range", f"""
SELECT low AS low_view, high AS high_view, CAST(count(*) FILTER (cut BETWEEN low AND high) AS BIGINT) AS n_in_view, CAST(count(*) FILTER (cut < low) AS BIGINT) AS n_below,
 CAST(count(*) FILTER (cut > high) AS BIGINT) AS n_above, avg(cut) FILTER (cut BETWEEN low AND high) AS mean_in_view FROM ({NET_SQL}), ({fence_sql('cut', NET_SQL)}) GROUP BY low, high""",
       {c: 4 for c in VIEW})
def _(t: Tables):
    return N.view_range(net(t), "cut").select("low_view", "high_view", "n_in_view", "n_below", "n_above", "mean_in_view")


# Four fifths and more of the lines have no surcharge, so the fences show a single value.
LUMP_SQL = "SELECT *, CASE WHEN l_tax = 0.08 THEN 2.5 WHEN l_tax = 0.0 THEN -1.5 ELSE 0.5 END AS lump FROM lineitem"


def lump(t: Tables):
    x = F.col("l_tax")
    return t.lineitem.withColumn("lump", F.when(x == 0.08, F.lit(2.5)).when(x == 0.0, F.lit(-1.5)).otherwise(F.lit(0.5)))


@query("n3_widened_view", f"""
SELECT -1.5 AS low_view, 2.5 AS high_view, count(*) AS n_in_view, CAST(0 AS BIGINT) AS n_below, CAST(0 AS BIGINT) AS n_above, avg(lump) AS mean_in_view FROM ({LUMP_SQL})""",
       {c: 4 for c in VIEW})
def _(t: Tables):
    return N.view_range(lump(t), "lump").select("low_view", "high_view", "n_in_view", "n_below", "n_above", "mean_in_view")


@query("n4_histogram", f"""
WITH v AS (SELECT cut AS x, low, high FROM ({NET_SQL}), ({fence_sql('cut', NET_SQL)}) WHERE cut BETWEEN low AND high),
 e AS (SELECT max(low) AS lo, max(high) AS hi, CAST(least(50, greatest(12, round_even(1.2 * sqrt(count(*)), 0))) AS INTEGER) AS k FROM v),
 c AS (SELECT least(CAST(floor((x - lo) / (hi - lo) * k) AS INTEGER), k - 1) AS bin, count(*) AS n FROM v, e GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, lo + b.bin * (hi - lo) / k AS bin_start, lo + (b.bin + 1) * (hi - lo) / k AS bin_end, coalesce(n, 0) AS n
FROM e, (SELECT unnest(range(0, 50)) AS bin) b LEFT JOIN c ON c.bin = b.bin WHERE b.bin < k""", {"bin_start": 4, "bin_end": 4})
def _(t: Tables):
    return N.histogram(net(t), "cut")


@query("n4_integer_histogram", """
WITH e AS (SELECT floor(q1 - 1.5 * (q3 - q1)) - 1.5 AS lo, ceil(q3 + 1.5 * (q3 - q1)) + 1.5 AS hi FROM (SELECT quantile_cont(l_linenumber, 0.25) AS q1, quantile_cont(l_linenumber, 0.75) AS q3 FROM lineitem)),
 c AS (SELECT CAST(floor(l_linenumber - lo) AS INTEGER) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, lo + b.bin AS bin_start, lo + b.bin + 1 AS bin_end, coalesce(n, 0) AS n
FROM e, (SELECT unnest(range(0, 100)) AS bin) b LEFT JOIN c ON c.bin = b.bin WHERE b.bin < hi - lo""", {"bin_start": 4, "bin_end": 4})
def _(t: Tables):
    return N.histogram(t.lineitem, "l_linenumber")


@query("n5_view_summary", f"""
SELECT low AS low_view, high AS high_view, CAST(count(*) FILTER (cut BETWEEN low AND high) AS BIGINT) AS n_in_view, CAST(count(*) FILTER (cut < low) AS BIGINT) AS n_below,
 CAST(count(*) FILTER (cut > high) AS BIGINT) AS n_above, avg(cut) FILTER (cut BETWEEN low AND high) AS mean_in_view, median(cut) FILTER (cut BETWEEN low AND high) AS median_in_view
FROM ({NET_SQL}), ({fence_sql('cut', NET_SQL)}) GROUP BY low, high""", {c: 4 for c in (*VIEW, "median_in_view")})
def _(t: Tables):
    return N.view_summary(net(t), "cut")


@query("n6_box_stats", f"""
WITH q AS (SELECT l_returnflag AS "group", quantile_cont(cut, 0.25) AS q1, median(cut) AS median, quantile_cont(cut, 0.75) AS q3 FROM ({NET_SQL}) GROUP BY 1)
SELECT q."group", count(*) AS n, max(q1) AS q1, max(median) AS median, max(q3) AS q3,
 coalesce(min(cut) FILTER (cut >= q1 - 1.5 * (q3 - q1) AND cut <= q1), max(q1)) AS whisker_low,
 coalesce(max(cut) FILTER (cut <= q3 + 1.5 * (q3 - q1) AND cut >= q3), max(q3)) AS whisker_high,
 CAST(count(*) FILTER (cut < q1 - 1.5 * (q3 - q1) OR cut > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS fliers
FROM ({NET_SQL}) JOIN q ON l_returnflag = q."group" GROUP BY 1""", {c: 4 for c in ("q1", "median", "q3", "whisker_low", "whisker_high")})
def _(t: Tables):
    return N.box_stats(net(t), "cut", "l_returnflag")


@query("n7_composition", """
WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS k FROM c),
 b AS (SELECT value, n FROM r WHERE k <= 20 UNION ALL SELECT '(other)', CAST(sum(n) AS BIGINT) FROM r WHERE k > 20)
SELECT value, n, n / (SELECT sum(n) FROM b) AS share, n = (SELECT max(n) FROM b) AS is_top FROM b""", {"share": 6})
def _(t: Tables):
    return N.composition(t.part, "p_brand")


CARDS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("n8_summary_cards", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_total, count({c}) AS n, 1 - count({c}) / count(*) AS missing_rate, avg({c}) AS mean, median({c}) AS median, stddev_samp({c}) AS std, "
    f"min({c}) AS min, quantile_cont({c}, 0.05) AS p05, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.75) AS p75, quantile_cont({c}, 0.95) AS p95, max({c}) AS max FROM ({GAPS_SQL})"
    for c in CARDS), {c: 4 for c in ("missing_rate", "mean", "median", "std", "min", "p05", "p25", "p75", "p95", "max")})
def _(t: Tables):
    return N.summary_cards(with_gaps(t.lineitem), list(CARDS))


@query("n9_group_compare", """
WITH s AS (SELECT p_brand AS value, avg(p_retailprice) AS mean, count(*) AS n FROM part GROUP BY 1 ORDER BY mean DESC, value LIMIT 20)
SELECT value, mean, n, (SELECT arg_max(value, mean) FROM s) AS highest, (SELECT arg_min(value, mean) FROM s) AS lowest, (SELECT max(mean) - min(mean) FROM s) AS gap,
 (SELECT count(DISTINCT p_brand) FROM part) AS groups_total FROM s""", {"mean": 4, "gap": 4})
def _(t: Tables):
    return N.group_compare(t.part, "p_brand", "p_retailprice")


MATRIX = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


def _matrix_sql(columns, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, covar_pop({a}, {b}) / (stddev_pop({a}) FILTER ({b} IS NOT NULL) * stddev_pop({b}) FILTER ({a} IS NOT NULL)) AS r FROM ({source})"
        for a in columns for b in columns)


@query("n10_correlation_matrix", _matrix_sql(MATRIX, GAPS_SQL), {"r": 6})
def _(t: Tables):
    return N.correlation_matrix(with_gaps(t.lineitem), list(MATRIX))


@query("n10_top_pairs", f"SELECT * FROM ({_matrix_sql(MATRIX, GAPS_SQL)}) WHERE a < b ORDER BY abs(r) DESC, a, b LIMIT 3", {"r": 6})
def _(t: Tables):
    return N.top_pairs(N.correlation_matrix(with_gaps(t.lineitem), list(MATRIX)))


@query("n11_crosstab", """
WITH c AS (SELECT p_brand AS a, p_type AS b, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT a FROM c GROUP BY 1 ORDER BY sum(n) DESC, a LIMIT 20),
 g AS (SELECT r.a, k.b, coalesce(c.n, 0) AS n FROM r CROSS JOIN (SELECT DISTINCT b FROM c) k LEFT JOIN c ON c.a = r.a AND c.b = k.b)
SELECT a, b, n, n / sum(n) OVER (PARTITION BY a) AS share FROM g""", {"share": 6})
def _(t: Tables):
    return N.crosstab(t.part, "p_brand", "p_type")


@query("n12_scatter_stats", f"""
WITH p AS (SELECT cut AS x, l_extendedprice AS y FROM ({NET_SQL})), fx AS ({fence_sql('cut', NET_SQL)}), fy AS ({fence_sql('l_extendedprice', NET_SQL)}),
 b AS (SELECT x, y, fx.low AS xl, fx.high AS xh, fy.low AS yl, fy.high AS yh FROM p, fx, fy)
SELECT count(*) AS n_pairs, CAST(count(*) FILTER (x BETWEEN xl AND xh AND y BETWEEN yl AND yh) AS BIGINT) AS n_in_view, CAST(count(*) FILTER (x < xl OR y < yl) AS BIGINT) AS n_below,
 CAST(count(*) FILTER (x > xh OR y > yh) AS BIGINT) AS n_above, corr(x, y) FILTER (x BETWEEN xl AND xh AND y BETWEEN yl AND yh) AS r,
 max(xl) AS x_low, max(xh) AS x_high, max(yl) AS y_low, max(yh) AS y_high FROM b""", {c: 4 for c in ("r", "x_low", "x_high", "y_low", "y_high")})
def _(t: Tables):
    return N.scatter_stats(net(t), "cut", "l_extendedprice")


@query("n13_linear_fit", """
SELECT 1 AS degree, count(*) AS n, regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) / count(*) AS rss_per_row FROM lineitem""", {"rss_per_row": 0})
def _(t: Tables):
    fit = N.polynomial_fit(t.lineitem, "l_quantity", "l_extendedprice", max_degree=1)
    return fit.select("degree", "n", (F.col("rss") / F.col("n")).alias("rss_per_row"))


@query("n13_polynomial_fit")
def _(t: Tables):
    return N.polynomial_fit(net(t), "l_discount", "cut")


def _polynomial_sql(rows: str, x: str, y: str) -> str:
    """Residuals of all degrees from polynomials that are orthogonal over the rows, each made from the two before."""
    steps, names = [], ["1.0"]
    for k in range(1, 5):
        a = f"(SELECT sum(z * p{k - 1} * p{k - 1}) / sum(p{k - 1} * p{k - 1}) FROM o{k - 1})"
        b = f" - (SELECT sum(p{k - 1} * p{k - 1}) / sum(p{k - 2} * p{k - 2}) FROM o{k - 1}) * p{k - 2}" if k > 1 else ""
        steps.append(f"o{k} AS MATERIALIZED (SELECT *, (z - {a}) * p{k - 1}{b} AS p{k} FROM o{k - 1})")
        names.append(f"p{k}")
    gain = lambda k: f"(SELECT sum(v * p{k}) ** 2 / sum(p{k} * p{k}) FROM o4)"
    rss = [f"(SELECT sum(v * v) FROM o4) - {' - '.join(gain(k) for k in range(d + 1))}" for d in range(1, 5)]
    lines = " UNION ALL ".join(f"SELECT {d} AS degree, n, ({r}) * sy * sy AS rss FROM m" for d, r in enumerate(rss, 1))
    return f"""
WITH d AS (SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM ({rows}) WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
 m AS MATERIALIZED (SELECT count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM d),
 o0 AS MATERIALIZED (SELECT (x - mx) / sx AS z, (y - my) / sy AS v, 1.0::DOUBLE AS p0 FROM d, m), {", ".join(steps)},
 f AS (SELECT degree, n, rss, n * ln(rss / n) + 2 * (degree + 1) AS aic FROM ({lines}))
SELECT CAST(degree AS INTEGER) AS degree, n, rss / n AS rss_per_row, aic, degree = (SELECT arg_min(degree, aic) FROM f) AS is_best FROM f"""


@query("n13_polynomial_degrees", _polynomial_sql(NET_SQL, "l_discount", "cut"), {"rss_per_row": 3, "aic": 1})
def _(t: Tables):
    fit = N.polynomial_fit(net(t), "l_discount", "cut")
    return fit.select("degree", "n", (F.col("rss") / F.col("n")).alias("rss_per_row"), "aic", "is_best")


def _uses(dims, y: str, extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, {y} AS y{extra} FROM ({FLAT_SQL})" for d in dims)


DIMS = ("l_returnflag", "l_linestatus", "o_orderpriority", "p_brand", "p_type")
N14_SQL = f"""
WITH u AS ({_uses(DIMS, 'l_extendedprice')}), mu AS (SELECT avg(l_extendedprice) AS mu FROM ({FLAT_SQL})),
 g AS (SELECT dimension, value, count(*) AS n, avg(y) AS mean FROM u GROUP BY 1, 2)
SELECT dimension, value, CAST(n AS DOUBLE) AS n, mean, mu AS overall_mean, (n * mean + 20 * mu) / (n + 20) AS mean_shrunk, n * ((n * mean + 20 * mu) / (n + 20) - mu) ** 2 AS contribution FROM g, mu"""


@query("n14_variance_decomposition", f"SELECT dimension, value, n, mean, overall_mean, mean_shrunk, contribution / sum(contribution) OVER () AS share FROM ({N14_SQL})",
       {"mean": 4, "overall_mean": 4, "mean_shrunk": 4, "share": 6})
def _(t: Tables):
    out = G.variance_decomposition(flat(t), "l_extendedprice", list(DIMS))
    total = G.one_row(out.agg(F.sum("contribution").alias("s")))["s"]
    return out.withColumn("share", F.col("contribution") / total).drop("contribution")


def _pareto_sql(source: str, top: int, min_n: int) -> str:
    return f"""
WITH c AS (SELECT coalesce(value, '(missing)') || ' (n=' || CAST(n AS BIGINT) || ')' AS driver, n, contribution FROM ({source}) WHERE contribution > 0),
 f AS (SELECT *, n < {min_n} AND (SELECT max(n) FROM c) >= {min_n} AS low FROM c),
 r AS (SELECT *, row_number() OVER (PARTITION BY low ORDER BY contribution DESC, driver) AS k FROM f),
 l AS (SELECT driver, contribution, 1 AS part FROM r WHERE NOT low AND k <= {top}
  UNION ALL SELECT '(other stable drivers)', sum(contribution), 2 FROM r WHERE NOT low AND k > {top} HAVING count(*) > 0
  UNION ALL SELECT '(low-support drivers: n<{min_n})', sum(contribution), 3 FROM r WHERE low HAVING count(*) > 0),
 s AS (SELECT driver, row_number() OVER (ORDER BY part, contribution DESC, driver) AS rank, 100 * contribution / (SELECT sum(contribution) FROM c) AS share_pct FROM l)
SELECT driver, CAST(rank AS INTEGER) AS rank, share_pct, sum(share_pct) OVER (ORDER BY rank) AS cum_share_pct FROM s"""


@query("n15_pareto", _pareto_sql(N14_SQL, 10, 1000), {"share_pct": 4, "cum_share_pct": 4})
def _(t: Tables):
    return G.pareto(G.variance_decomposition(flat(t), "l_extendedprice", list(DIMS)), 10, 1000)


@query("n16_aggregated_decomposition", """
WITH a AS (SELECT l_returnflag, l_linestatus, l_linenumber, avg(l_extendedprice) AS mean_p, count(*) AS n_records FROM lineitem GROUP BY 1, 2, 3),
 mu AS (SELECT sum(mean_p * n_records) / sum(n_records) AS mu FROM a),
 c AS (SELECT l_returnflag || ' | ' || l_linestatus || ' | ' || l_linenumber AS value, CAST(n_records AS DOUBLE) AS n, mean_p AS mean, mu AS overall_mean, (n_records * mean_p + 20 * mu) / (n_records + 20) AS mean_shrunk FROM a, mu)
SELECT 'l_returnflag & l_linestatus & l_linenumber' AS dimension, value, n, mean, overall_mean, mean_shrunk,
 n * (mean_shrunk - overall_mean) ** 2 / sum(n * (mean_shrunk - overall_mean) ** 2) OVER () AS share FROM c""", {"mean": 4, "overall_mean": 4, "mean_shrunk": 4, "share": 6})
def _(t: Tables):
    dims = ["l_returnflag", "l_linestatus", "l_linenumber"]
    a = A.aggregate(t.lineitem, A.Plan(dims, [A.Metric("mean_p", "l_extendedprice", "mean")]))
    out = G.variance_decomposition_aggregated(a, "mean_p", "n_records", dims)
    total = G.one_row(out.agg(F.sum("contribution").alias("s")))["s"]
    return out.withColumn("share", F.col("contribution") / total).drop("contribution")


FLAG_SQL = f"SELECT *, (cut < low OR cut > high) AS is_outlier FROM ({FLAT_SQL.replace('l.*', 'l.*, l_extendedprice * l_discount * l_discount AS cut')}), ({fence_sql('cut', NET_SQL)})"


def flagged(t: Tables):
    """Lines are flagged by bounds over all lines before orders and parts are joined to them."""
    cut = t.lineitem.withColumn("cut", F.col("l_extendedprice") * F.col("l_discount") * F.col("l_discount"))
    return flat(t, G.flag_outliers(cut, "cut"))


@query("n17_outlier_flag", f"SELECT l_orderkey, l_linenumber, is_outlier FROM ({FLAG_SQL})")
def _(t: Tables):
    return flagged(t).select("l_orderkey", "l_linenumber", "is_outlier")


@query("n17_outlier_bounds_high", """
WITH q AS (SELECT quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3, quantile_cont(l_quantity, 0.95) AS p95, quantile_cont(l_quantity, 0.01) AS p01, quantile_cont(l_quantity, 0.99) AS p99, count(*) AS n FROM lineitem)
SELECT n, q1 - 1.5 * (q3 - q1) AS low, p95 AS high, true AS widened, p01, p99 FROM q""", {c: 4 for c in ("low", "high", "p01", "p99")})
def _(t: Tables):
    """Quantities have no outliers, so the upper bound falls back to p95."""
    return G.outlier_bounds(t.lineitem, "l_quantity", "high")


@query("n18_categorical_contrast", f"""
WITH f AS ({FLAG_SQL}), u AS ({' UNION ALL '.join(f"SELECT '{d}' AS feature, {d} AS value, is_outlier FROM f" for d in DIMS)}),
 g AS (SELECT feature, value, 100.0 * count(*) FILTER (is_outlier) / (SELECT count(*) FROM f WHERE is_outlier) AS share_out, 100.0 * count(*) FILTER (NOT is_outlier) / (SELECT count(*) FROM f WHERE NOT is_outlier) AS share_base FROM u GROUP BY 1, 2),
 r AS (SELECT *, share_out - share_base AS diff_pp, row_number() OVER (PARTITION BY feature ORDER BY abs(share_out - share_base) DESC, value) AS k FROM g)
SELECT feature, value, share_out, share_base, diff_pp FROM r WHERE k = 1 ORDER BY abs(diff_pp) DESC, feature LIMIT 8""", {"share_out": 4, "share_base": 4, "diff_pp": 4})
def _(t: Tables):
    return G.categorical_contrast(flagged(t), "cut", list(DIMS)).drop("label")


CONTRAST = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size")


@query("n19_numeric_contrast", f"""
SELECT * FROM ({' UNION ALL '.join(f"SELECT '{c}' AS feature, corr({c}, CAST(is_outlier AS INTEGER)) AS r, avg({c}) FILTER (is_outlier) AS mean_out, avg({c}) FILTER (NOT is_outlier) AS mean_base, count({c}) AS n FROM ({FLAG_SQL})" for c in CONTRAST)})
ORDER BY abs(r) DESC, feature LIMIT 8""", {"r": 6, "mean_out": 4, "mean_base": 4})
def _(t: Tables):
    return G.numeric_contrast(flagged(t), "cut", list(CONTRAST)).drop("label")


@query("n20_outlier_summary", f"""
SELECT CASE WHEN cut < low OR cut > high THEN 'outlier' ELSE 'typical' END AS part, count(*) AS n, avg(cut) AS mean, median(cut) AS median FROM ({NET_SQL}), ({fence_sql('cut', NET_SQL)}) GROUP BY 1""", {"mean": 4, "median": 4})
def _(t: Tables):
    return G.outlier_summary(net(t), "cut")


def _hist_sql(part: str, cond: str, most: int) -> str:
    return f"""SELECT '{part}' AS part, bin, lo + bin * (hi - lo) / k AS bin_start, lo + (bin + 1) * (hi - lo) / k AS bin_end, count(*) AS n FROM
 (SELECT least(CAST(floor((cut - lo) / (hi - lo) * k) AS INTEGER), k - 1) AS bin, lo, hi, k FROM (SELECT cut FROM ({NET_SQL}), ({fence_sql('cut', NET_SQL)}) WHERE {cond}),
  (SELECT min(cut) AS lo, max(cut) AS hi, CAST(greatest(10, least({most}, floor(1.2 * sqrt(count(*))))) AS INTEGER) AS k FROM ({NET_SQL}), ({fence_sql('cut', NET_SQL)}) WHERE {cond})) GROUP BY bin, lo, hi, k"""


@query("n20_outlier_histograms", _hist_sql("typical", "cut BETWEEN low AND high", 40) + " UNION ALL " + _hist_sql("outliers", "cut NOT BETWEEN low AND high", 30), {"bin_start": 4, "bin_end": 4})
def _(t: Tables):
    return G.outlier_histograms(net(t), "cut")


EFFECTS = ("l_quantity", "l_discount", "l_tax", "l_linenumber", "p_size")


@query("n21_numeric_effects", f"""
SELECT * FROM ({' UNION ALL '.join(f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) * stddev_pop(l_extendedprice) AS effect, corr({c}, l_extendedprice) AS corr, count({c}) AS n FROM ({FLAT_SQL})" for c in EFFECTS)})
ORDER BY abs(effect) DESC, feature LIMIT 8""", {"effect": 4, "corr": 6})
def _(t: Tables):
    return G.numeric_effects(flat(t), "l_extendedprice", list(EFFECTS))


LIFT_SQL = f"""
WITH u AS ({_uses(DIMS, 'l_extendedprice').replace('AS dimension', 'AS feature')}), mu AS (SELECT avg(l_extendedprice) AS mu FROM ({FLAT_SQL})),
 g AS (SELECT feature, value, count(*) AS c, sum(y) AS s FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY c DESC, value) AS k FROM g),
 b AS (SELECT feature, CASE WHEN k <= 12 THEN value ELSE '(other)' END AS value, CAST(sum(c) AS DOUBLE) AS n, sum(s) / sum(c) AS mean FROM r GROUP BY 1, 2 HAVING sum(c) >= 10)
SELECT feature, value, n, mean, mu AS overall_mean, (n * mean + 20 * mu) / (n + 20) AS mean_shrunk, (n * mean + 20 * mu) / (n + 20) - mu AS lift FROM b, mu ORDER BY abs(lift) DESC, feature, value LIMIT 10"""


@query("n22_categorical_lifts", LIFT_SQL, {"mean": 4, "overall_mean": 4, "mean_shrunk": 4, "lift": 4})
def _(t: Tables):
    return G.categorical_lifts(flat(t), "l_extendedprice", list(DIMS)).drop("label")


@query("n23_looks_aggregated", """
SELECT o_orderstatus, 'aggregated' AS seen_as, count(*) AS n_records FROM orders GROUP BY 1 UNION ALL SELECT 'raw', 'row level', count(*) FROM orders""")
def _(t: Tables):
    """The rule on the schema of orders and of its aggregate, next to their sizes."""
    def name(df):
        return F.lit("aggregated" if roles.looks_aggregated(df) else "row level")

    agg = A.aggregate(t.orders, A.Plan(["o_orderstatus"]))
    raw = t.orders.agg(F.count(F.lit(1)).alias("n_records"))
    return agg.select("o_orderstatus", name(agg).alias("seen_as"), "n_records").unionByName(
        raw.select(F.lit("raw").alias("o_orderstatus"), name(t.orders).alias("seen_as"), "n_records")
    )


@query("n24_scale_choice", """
SELECT count(x) AS n, min(x) AS min, max(x) AS max, quantile_cont(x, 0.95) / quantile_cont(x, 0.05) AS spread_ratio,
 CASE WHEN min(x) > 0 AND max(x) / min(x) > 1000 THEN 'log' ELSE 'linear' END AS scale_by_extremes, CASE WHEN quantile_cont(x, 0.95) / quantile_cont(x, 0.05) >= 20 THEN 'log' ELSE 'linear' END AS scale_by_spread
FROM (SELECT CASE WHEN l_discount > 0 THEN l_extendedprice * l_discount * l_discount END AS x FROM lineitem)""", {"min": 4, "max": 4, "spread_ratio": 4})
def _(t: Tables):
    return N.scale_choice(net(t).withColumn("x", F.when(F.col("l_discount") > 0, F.col("cut"))), "x")


@query("n24_percent_scale", """
SELECT count(l_discount) AS n, min(l_discount) AS min, max(l_discount) AS max, quantile_cont(l_discount, 0.95) FILTER (l_discount > 0) / quantile_cont(l_discount, 0.05) FILTER (l_discount > 0) AS spread_ratio,
 'percent' AS scale_by_extremes, 'linear' AS scale_by_spread FROM lineitem""", {"min": 4, "max": 4, "spread_ratio": 4})
def _(t: Tables):
    return N.scale_choice(t.lineitem, "l_discount")


@query("n25_axis_range", f"""
SELECT 0.0 AS axis_min, hi + greatest(0.03 * (hi - lo), 0.01 * greatest(abs(lo), abs(hi), 1.0)) AS axis_max, true AS view_clipped
FROM (SELECT min(cut) AS lo, max(cut) AS hi FROM ({NET_SQL}), ({fence_sql('cut', NET_SQL)}) WHERE cut BETWEEN low AND high)""", {"axis_min": 4, "axis_max": 4})
def _(t: Tables):
    return N.axis_range(net(t), "cut")


@query("n25_log_axis_range", "SELECT min(o_totalprice) * 0.9 AS axis_min, max(o_totalprice) * 1.1 AS axis_max, false AS view_clipped FROM orders", {"axis_min": 4, "axis_max": 4})
def _(t: Tables):
    return N.axis_range(t.orders, "o_totalprice", scale="log")


@query("z3_analysis_by_name", """
WITH s AS (SELECT o_orderpriority AS value, avg(o_totalprice) AS mean, count(*) AS n FROM orders GROUP BY 1 ORDER BY mean DESC, value LIMIT 20)
SELECT value, mean, n, (SELECT arg_max(value, mean) FROM s) AS highest, (SELECT arg_min(value, mean) FROM s) AS lowest, (SELECT max(mean) - min(mean) FROM s) AS gap,
 (SELECT count(DISTINCT o_orderpriority) FROM orders) AS groups_total FROM s""", {"mean": 4, "gap": 4})
def _(t: Tables):
    return analyse(t.orders, "descriptive", "group_compare", group="o_orderpriority", column="o_totalprice")


@query("z3_relationships", f"""
SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE r END AS r FROM ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))})""", {"r": 6})
def _(t: Tables):
    return analyse(t.lineitem, "descriptive", "relationships", ids=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


@query("z3_relationships_of_labels", """
WITH g AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), x AS (SELECT DISTINCT a FROM g), y AS (SELECT DISTINCT b FROM g)
SELECT a, b, coalesce(n, 0) AS n, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY a) AS share FROM (SELECT * FROM x, y) LEFT JOIN g USING (a, b)""", {"share": 6})
def _(t: Tables):
    return analyse(t.orders.select("o_orderstatus", "o_orderpriority"), "descriptive", "relationships")


# --- checks -----------------------------------------------------------------------------------

DAILY = "SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS time_bucket, sum(o_totalprice) AS y, count(*) AS n_records FROM orders GROUP BY 1"


def daily(t: Tables):
    return A.aggregate(t.orders, A.Plan([], [A.Metric("y", "o_totalprice", "sum")], "o_orderdate", "day"))


@query("v1_robust_outliers", f"""
WITH d AS ({DAILY}), m AS (SELECT median(y) AS med FROM d), a AS (SELECT median(abs(y - med)) AS mad FROM d, m)
SELECT time_bucket, y, n_records, 0.6745 * (y - med) / mad AS robust_z FROM d, m, a WHERE abs(0.6745 * (y - med) / mad) > 3.5""", {"y": 2, "robust_z": 4})
def _(t: Tables):
    return V.robust_outliers(daily(t), "y")


@query("v2_time_duplicates", """
SELECT count(*) AS n_rows, 1 - count(DISTINCT date_trunc('hour', ts)) / count(*) AS dup_rate, 1 - count(DISTINCT date_trunc('hour', ts)) / count(*) > 0.15 AS warn FROM events""", {"dup_rate": 6})
def _(t: Tables):
    return V.time_duplicates(t.events.withColumn("hour", F.date_trunc("hour", "ts")), "hour")


@query("v3_low_support", """
SELECT count(*) AS n_buckets, avg(CASE WHEN n < 5 THEN 1.0 ELSE 0 END) AS low_share, 'table:n_records' AS source FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type)""", {"low_share": 6})
def _(t: Tables):
    return V.low_support(A.support_counts(t.events, ["user_id", "event_type"]))


@query("v3_low_support_joined", """
SELECT count(*) AS n_buckets, avg(CASE WHEN n < 5 THEN 1.0 ELSE 0 END) AS low_share, 'joined' AS source FROM (SELECT count(*) AS n FROM events GROUP BY date_trunc('day', ts), event_type)""", {"low_share": 6})
def _(t: Tables):
    means = A.aggregate(t.events, A.Plan(["event_type"], [A.Metric("m", "value", "mean")], "ts", "day"), add_support=False)
    return V.low_support(means, A.support_counts(t.events, ["event_type"], "ts", "day"))


@query("v4_basic_stats", """
SELECT 'l_extendedprice' AS "column", count(x) AS n, avg(x) AS mean, median(x) AS median, stddev_pop(x) AS std, min(x) AS min, quantile_cont(x, 0.05) AS p05, quantile_cont(x, 0.95) AS p95,
 quantile_cont(x, 0.99) AS p99, max(x) AS max, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM (SELECT l_extendedprice AS x FROM lineitem)""",
       {c: 4 for c in ("mean", "median", "std", "min", "p05", "p95", "p99", "max", "q1", "q3", "iqr")})
def _(t: Tables):
    return V.basic_stats(t.lineitem, "l_extendedprice")


@query("v5_findings", f"""
WITH d AS (SELECT o_orderstatus, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS time_bucket, sum(o_totalprice) AS y, count(*) AS n_records FROM orders GROUP BY 1, 2),
 m AS (SELECT median(y) AS med FROM d), a AS (SELECT median(abs(y - med)) AS mad FROM d, m),
 f AS (SELECT 'time_duplicates' AS code, 1 - count(DISTINCT time_bucket) / count(*) AS value FROM d HAVING 1 - count(DISTINCT time_bucket) / count(*) > 0.15
  UNION ALL SELECT 'series_outliers', count(*) FROM d, m, a WHERE abs(0.6745 * (y - med) / mad) > 3.5 HAVING count(*) > 0
  UNION ALL SELECT 'low_bucket_support', avg(CASE WHEN n_records < 5 THEN 1.0 ELSE 0 END) FROM d HAVING avg(CASE WHEN n_records < 5 THEN 1.0 ELSE 0 END) > 0)
SELECT code, 'warn' AS severity, CAST(value AS DOUBLE) AS value FROM f UNION ALL SELECT '(status)', CASE WHEN (SELECT count(*) FROM f) > 0 THEN 'warn' ELSE 'ok' END, NULL""", {"value": 6})
def _(t: Tables):
    d = A.aggregate(t.orders, A.Plan(["o_orderstatus"], [A.Metric("y", "o_totalprice", "sum")], "o_orderdate", "day"))
    return V.findings(d, "time_bucket", "y")


@query("v6_step_delta", """
SELECT 'filters' AS step, (SELECT count(*) FROM lineitem) AS rows_before, count(*) AS rows_after, 11 AS cols_before, 11 AS cols_after FROM lineitem WHERE l_returnflag = 'A'
UNION ALL SELECT 'prepare', (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A'), count(*), 11, 11 FROM lineitem WHERE l_returnflag = 'A'""")
def _(t: Tables):
    kept = where_guarded(t.lineitem, [Condition("l_returnflag", "==", "A")])[0]
    return V.step_delta(t.lineitem, kept, "filters").unionByName(V.step_delta(kept, drop_incomplete(kept, ["l_quantity"]), "prepare"))

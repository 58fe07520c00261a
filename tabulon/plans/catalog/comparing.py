"""Queries of section 2.16 and K9: decisions and ratings across variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions.expressions import canonical
from tabulon.operators import evaluation as E
from tabulon.operators.clean import first_per_key
from tabulon.operators.columns import choose_dimension
from tabulon.plans.catalog.base import Tables, query
from tabulon.session import spread

COMPONENTS = ["l_returnflag", "l_linestatus", "l_tax"]
SYSTEMS = ["s0", "s1", "s2"]

# Line 1 of an order is its baseline, later lines are variants; the supplier decides the system.
BASE_SQL = """SELECT * FROM (SELECT l_orderkey, l_returnflag, l_linestatus, l_tax, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linestatus, l_tax) AS rn FROM lineitem WHERE l_linenumber = 1) WHERE rn = 1"""
MATCH_SQL = f"""
SELECT *, least(match_l_returnflag, match_l_linestatus, match_l_tax) AS match_all FROM (
 SELECT 's' || (l.l_suppkey % 3) AS system, l.l_orderkey, l.l_linenumber, l.l_partkey, {', '.join(f"CASE WHEN l.{c} IS NOT DISTINCT FROM b.{c} THEN 1.0 ELSE 0.0 END AS match_{c}" for c in COMPONENTS)}
 FROM lineitem l LEFT JOIN ({BASE_SQL}) b ON l.l_orderkey = b.l_orderkey WHERE l.l_linenumber > 1)"""
MATCHES = [f"match_{c}" for c in [*COMPONENTS, "all"]]


def matches(t: Tables):
    base = first_per_key(t.lineitem.filter("l_linenumber = 1").select("l_orderkey", *COMPONENTS), ["l_orderkey"])
    variants = t.lineitem.filter("l_linenumber > 1").withColumn("system", F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")))
    return E.component_matches(variants, base, ["l_orderkey"], COMPONENTS)


def stable(t: Tables):
    return E.stability(matches(t), ["system", "l_orderkey"], COMPONENTS)


STABLE_SQL = f"SELECT system, l_orderkey, {', '.join(f'avg({m}) AS {m}' for m in MATCHES)} FROM ({MATCH_SQL}) GROUP BY 1, 2"


@query("e1_component_matches", f"SELECT system, l_orderkey, l_linenumber, l_partkey, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in MATCHES)} FROM ({MATCH_SQL})", {m: 2 for m in MATCHES})
def _(t: Tables):
    return matches(t).select("system", "l_orderkey", "l_linenumber", "l_partkey", *MATCHES)


@query("e1_stability", STABLE_SQL, {m: 6 for m in MATCHES})
def _(t: Tables):
    return stable(t)


@query("e2_match_rates", "SELECT component, " + ", ".join(f"max(rate_pct) FILTER (system = '{s}') AS {s}" for s in SYSTEMS) + " FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS component, system, 100 * avg(match_{c}) AS rate_pct FROM ({STABLE_SQL}) GROUP BY 2 HAVING count(*) >= 30" for c in COMPONENTS) + ") GROUP BY 1", {s: 4 for s in SYSTEMS})
def _(t: Tables):
    return E.match_rates(stable(t), "system", COMPONENTS, SYSTEMS)


@query("e3_full_stability", f"SELECT system, 100 * avg(match_all) AS rate_pct, count(*) AS n FROM ({STABLE_SQL}) GROUP BY 1 HAVING count(*) >= 30", {"rate_pct": 4})
def _(t: Tables):
    return E.full_stability(stable(t), "system")


# Decision log: one row per (order, line number), lists of what its lines hold; line number 1 is the baseline.
LOG_SQL = """
SELECT l_orderkey AS id, CASE l_linenumber WHEN 1 THEN 'base' ELSE 'alt' || l_linenumber END AS variant, min(l_returnflag) AS family_n, min(l_linestatus) AS type_n,
 list_sort(list(DISTINCT 'tax>' || CAST(CAST(l_tax * 100 AS INTEGER) // 3 AS VARCHAR))) AS filters_n, list_sort(list(DISTINCT l_returnflag)) AS columns_n,
 list_sort(list(DISTINCT 'q' || CAST(CAST(l_quantity AS INTEGER) // 26 AS VARCHAR))) AS prepare_n, list_sort(list(DISTINCT l_linestatus)) AS aggregate_n FROM lineitem GROUP BY l_orderkey, l_linenumber"""


def log(t: Tables):
    tax = F.floor(F.rint(F.col("l_tax") * 100) / 3).cast("int").cast("string")
    qty = F.floor(F.col("l_quantity") / 26).cast("int").cast("string")

    def names(c):
        return F.array_sort(F.collect_set(c))

    variant = F.when(F.col("l_linenumber") == 1, F.lit("base")).otherwise(F.concat(F.lit("alt"), F.col("l_linenumber").cast("string")))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("id"), variant.alias("variant")).agg(
        F.min("l_returnflag").alias("family_n"), F.min("l_linestatus").alias("type_n"), names(F.concat(F.lit("tax>"), tax)).alias("filters_n"),
        names("l_returnflag").alias("columns_n"), names(F.concat(F.lit("q"), qty)).alias("prepare_n"), names("l_linestatus").alias("aggregate_n"),
    )


CMP_SQL = f"""
WITH g AS ({LOG_SQL}), b AS (SELECT * FROM g WHERE variant = 'base'),
 j AS (SELECT g.id, g.variant, b.id IS NOT NULL AS have, g.variant = 'base' AS is_base,
  g.family_n = b.family_n AND g.type_n = b.type_n AS ft, g.filters_n = b.filters_n AS fi, list_has_all(g.columns_n, b.columns_n) AS co, g.prepare_n = b.prepare_n AND g.aggregate_n = b.aggregate_n AS pa,
  list_has_all(g.filters_n, b.filters_n) AS hf, list_has_all(g.prepare_n, b.prepare_n) AS hp, list_has_all(g.aggregate_n, b.aggregate_n) AS ha FROM g LEFT JOIN b ON g.id = b.id)
SELECT id, variant, CASE WHEN NOT have THEN 'baseline_missing' WHEN is_base THEN '' ELSE concat_ws(', ', CASE WHEN NOT hf THEN 'filters' END, CASE WHEN NOT hp THEN 'prepare' END, CASE WHEN NOT ha THEN 'aggregate' END, CASE WHEN NOT co THEN 'columns' END) END AS missing_fields,
 have AND (is_base OR coalesce(ft, false)) AS same_family_type, have AND (is_base OR coalesce(fi, false)) AS same_filters, have AND (is_base OR coalesce(co, false)) AS columns_include_base,
 have AND (is_base OR coalesce(pa, false)) AS same_prepare_aggregate, have AND (is_base OR coalesce(ft AND fi AND co AND pa, false)) AS all_three_ok FROM j"""


def compared(t: Tables):
    return E.compare_to_baseline(log(t)).select("id", "variant", "missing_fields", *E.FLAGS)


@query("e4_comparison_table", CMP_SQL)
def _(t: Tables):
    return compared(t)


RATE_SQL = ", ".join(f"avg(CAST({f} AS INTEGER)) AS rate_{f}" for f in E.FLAGS)
RATE_DIGITS = {f"rate_{f}": 6 for f in E.FLAGS}


@query("e5_overall_rates", f"SELECT count(*) AS n_alts, {RATE_SQL} FROM ({CMP_SQL}) WHERE variant <> 'base'", RATE_DIGITS)
def _(t: Tables):
    return E.overall_rates(compared(t))


@query("e5_rates_per_id", f"""
SELECT *, rate_all_three_ok = 1 AS all_match, rate_same_family_type = 1 AS all_match_task FROM (SELECT id, count(*) AS n_alts, {RATE_SQL} FROM ({CMP_SQL}) WHERE variant <> 'base' GROUP BY 1)""", RATE_DIGITS)
def _(t: Tables):
    return E.rates_per_id(compared(t))


@query("e5_rate_distribution", f"SELECT round(r, 6) AS rate, count(*) AS n_ids FROM (SELECT avg(CAST(all_three_ok AS INTEGER)) AS r FROM ({CMP_SQL}) WHERE variant <> 'base' GROUP BY id) GROUP BY 1")
def _(t: Tables):
    return E.rate_distribution(E.rates_per_id(compared(t)))


@query("e5_strict_columns", f"""
WITH g AS ({LOG_SQL}) SELECT g.id, g.variant, coalesce(g.columns_n = b.columns_n, false) AS columns_exact_match FROM g LEFT JOIN (SELECT * FROM g WHERE variant = 'base') b ON g.id = b.id WHERE g.variant <> 'base'""")
def _(t: Tables):
    return E.strict_columns_match(log(t)).select("id", "variant", "columns_exact_match")


@query("e6_missing_field_counts", f"SELECT trim(f) AS field, count(*) AS n FROM (SELECT unnest(string_split(missing_fields, ',')) AS f FROM ({CMP_SQL}) WHERE variant <> 'base') WHERE trim(f) <> '' GROUP BY 1")
def _(t: Tables):
    return E.missing_field_counts(compared(t))


@query("e7_winners", """
WITH m AS (SELECT p_name, p_type, avg(p_size) AS m FROM part GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY p_name ORDER BY m DESC) AS k FROM m),
 w AS (SELECT p_name, CASE WHEN count(*) > 1 THEN 'TIE' ELSE min(p_type) END AS winner FROM r WHERE k = 1 GROUP BY 1) SELECT winner, count(DISTINCT p_name) AS n_items FROM w GROUP BY 1""")
def _(t: Tables):
    return E.win_counts(E.winners(t.part, "p_name", "p_type", "p_size"), "p_name")


RATING_SQL = "SELECT l_orderkey AS item, 's' || (l_suppkey % 3) AS system, 'm' || l_linenumber AS metric, l_quantity AS score FROM lineitem"
METRICS = [f"m{i}" for i in range(1, 8)]


def ratings(t: Tables):
    return t.lineitem.select(
        F.col("l_orderkey").alias("item"), F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("system"),
        F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("metric"), F.col("l_quantity").alias("score"),
    )


@query("e8_metric_group_means", f"""
SELECT 'scoping' AS "group", item, system, avg(score) AS value FROM ({RATING_SQL}) WHERE metric IN ('m2', 'm3', 'm4') GROUP BY 2, 3
UNION ALL SELECT 'output', item, system, avg(score) FROM ({RATING_SQL}) WHERE metric IN ('m5', 'm6') GROUP BY 2, 3""", {"value": 4})
def _(t: Tables):
    return E.metric_group_means(ratings(t), "item", "system", "metric", "score", {"scoping": ["m2", "m3", "m4"], "output": ["m5", "m6"]})


WIDE_SQL = f"SELECT item, {', '.join(f'''avg(score) FILTER (metric = '{m}') AS {m}''' for m in METRICS)} FROM ({RATING_SQL}) GROUP BY 1"


@query("e9_metric_correlations", "WITH w AS MATERIALIZED (" + WIDE_SQL + ") " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, covar_pop({a}, {b}) / (stddev_pop({a}) FILTER ({b} IS NOT NULL) * stddev_pop({b}) FILTER ({a} IS NOT NULL)) AS r FROM w" for a in METRICS for b in METRICS), {"r": 6})
def _(t: Tables):
    return E.metric_correlations(ratings(t), "item", "metric", "score", METRICS)


@query("e10_feature_fits", f"""
WITH w AS MATERIALIZED ({WIDE_SQL.replace('SELECT item,', 'SELECT system, item,').replace('GROUP BY 1', 'GROUP BY 1, 2')})
{' UNION ALL '.join(f"SELECT system, '{m}' AS feature, CAST(regr_count(m7, {m}) AS BIGINT) AS n, regr_slope(m7, {m}) AS slope, regr_intercept(m7, {m}) AS intercept, corr(m7, {m}) AS r, coalesce(format('{{:.2f}}', corr(m7, {m})), 'NA') AS r_text FROM w GROUP BY 1" for m in METRICS[1:6])}""",
       {"slope": 4, "intercept": 4, "r": 6})
def _(t: Tables):
    return E.feature_fits(ratings(t), "item", "system", "metric", "score", "m7", METRICS[1:6]).withColumn("n", F.col("n").cast("bigint"))


@query("k9_canonical_decisions", """
SELECT o_orderkey, 'in(o_status,{' || CASE WHEN o_orderstatus < 'o' AND lower(o_orderstatus) < 'o' THEN lower(o_orderstatus) || ',o' WHEN lower(o_orderstatus) = 'o' THEN 'o' ELSE 'o,' || lower(o_orderstatus) END || '})&notna(o_orderdate)&o_price>=' || CAST(floor(o_totalprice) AS BIGINT) || '&year(o_orderdate)==' || year(o_orderdate) AS canonical FROM orders""")
def _(t: Tables):
    """Every order as a wordy condition; the canonical form is known in advance."""
    words = F.concat(
        F.lit("Filter to: o_orderdate is not null & o_price at least "), F.floor("o_totalprice").cast("bigint").cast("string"),
        F.lit(" & o_orderdate.dt.year == "), F.year("o_orderdate").cast("string"), F.lit(" & o_status in ['O', '"), F.col("o_orderstatus"),
        F.lit("'] (optionally drop gaps)  # note"),
    )
    return spread(t.orders).select("o_orderkey", canonical(words).alias("canonical"))


@query("m10_candidate_dimension", "SELECT o_orderstatus AS level, count(*) AS n FROM orders GROUP BY 1")
def _(t: Tables):
    """o_orderstatus wins: few levels and an actionable name."""
    dim = choose_dimension(t.orders, "o_totalprice", ids=["o_orderkey", "o_custkey"])
    return t.orders.groupBy(F.col(dim).alias("level")).agg(F.count(F.lit(1)).alias("n"))

"""Queries of sections 2.4 and 2.5: cleaning and profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions.text import MISSING_TOKENS
from tabulon.operators import clean as K
from tabulon.operators import profile as D
from tabulon.plans.catalog.base import GAPS_SQL, ORDER_GAPS_SQL, Tables, in_sql, query, strip_sql, with_gaps, with_order_gaps

# documents with padded, mixed-case languages and sources of which two are disguised gaps.
MESSY_SQL = """SELECT doc_id, CASE WHEN source = 'src1' THEN ' N/A ' WHEN source = 'src2' THEN '--' ELSE source END AS source,
 CASE WHEN source = 'src3' THEN chr(9) || upper(lang) || ' ' ELSE lang END AS lang, text FROM documents"""


def messy(t: Tables):
    s = F.col("source")
    return t.documents.select(
        "doc_id", F.when(s == "src1", " N/A ").when(s == "src2", "--").otherwise(s).alias("source"),
        F.when(s == "src3", F.concat(F.lit("\t"), F.upper("lang"), F.lit(" "))).otherwise(F.col("lang")).alias("lang"), "text",
    )


@query("c1_missing_tokens", f"""
SELECT doc_id, CASE WHEN lower({strip_sql('source')}) IN {in_sql(MISSING_TOKENS)} THEN NULL ELSE source END AS source, lang,
 CASE WHEN lower({strip_sql('text')}) IN {in_sql(MISSING_TOKENS)} THEN NULL ELSE sha256(text) END AS text_hash FROM ({MESSY_SQL})""")
def _(t: Tables):
    return K.normalize_missing(messy(t)).select("doc_id", "source", "lang", F.sha2("text", 256).alias("text_hash"))


@query("c2_strip_text", f"SELECT doc_id, {strip_sql('source')} AS source, {strip_sql('lang')} AS lang, sha256({strip_sql('text')}) AS text_hash FROM ({MESSY_SQL})")
def _(t: Tables):
    return K.strip_text(messy(t)).select("doc_id", "source", "lang", F.sha2("text", 256).alias("text_hash"))


@query("c3_coerce_numeric", """
SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'bad' ELSE json_extract_string(props, '$.k') END AS DOUBLE) AS k FROM events""")
def _(t: Tables):
    k = F.when(F.col("event_type") == "error", F.lit("bad")).otherwise(F.concat(F.lit(" "), F.get_json_object("props", "$.k")))
    return K.coerce_numeric(t.events.select("event_id", k.alias("k")), ["k"])


@query("c4_parse_times", """
SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN CAST(date_trunc('day', ts) AS TIMESTAMP)
 WHEN 'view' THEN CAST(date_trunc('minute', ts) AS TIMESTAMP) ELSE CAST(date_trunc('second', ts) AS TIMESTAMP) END AS at FROM events""")
def _(t: Tables):
    ts = F.col("ts")
    text = (
        F.when(F.col("event_type") == "error", F.lit("soon")).when(F.col("event_type") == "click", F.date_format(ts, "M/d/yyyy"))
        .when(F.col("event_type") == "view", F.date_format(ts, "dd.MM.yyyy HH:mm")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
    )
    return K.parse_times(t.events.select("event_id", text.alias("at")), ["at"])


@query("c5_impute_median", f"""
SELECT l_orderkey, l_linenumber, coalesce(l_quantity, (SELECT median(l_quantity) FROM ({GAPS_SQL}))) AS l_quantity FROM ({GAPS_SQL})""", {"l_quantity": 4})
def _(t: Tables):
    return K.impute_median(with_gaps(t.lineitem), ["l_quantity", "l_tax"]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("c6_impute_mode", f"""
SELECT o_orderkey, coalesce(o_orderpriority, (SELECT o_orderpriority FROM ({ORDER_GAPS_SQL}) WHERE o_orderpriority IS NOT NULL
 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM ({ORDER_GAPS_SQL})""")
def _(t: Tables):
    return K.impute_mode(with_order_gaps(t.orders), ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")


@query("c7_drop_incomplete", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax <> 0.08 OR (SELECT avg(CASE WHEN l_tax = 0.08 THEN 1.0 ELSE 0 END) FROM lineitem) > 0.10""")
def _(t: Tables):
    """A gap in the tax is few enough to drop, one in the return flag is not."""
    gaps = t.lineitem.withColumns({
        "tax": F.when(F.col("l_tax") != 0.08, F.col("l_tax")), "flag": F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")),
    })
    return K.drop_incomplete(K.drop_incomplete(gaps, ["tax"]), ["flag"]).select("l_orderkey", "l_linenumber")


@query("c8_drop_duplicates", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (
 SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS rn
 FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem)) WHERE rn = 1""")
def _(t: Tables):
    """Refused on whole rows, forced on the order key."""
    base = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    kept = K.drop_duplicates(base, ["l_orderkey"], ["l_linenumber", "l_partkey"])
    return K.drop_duplicates(kept, ["l_orderkey"], ["l_linenumber", "l_partkey"], force=True)


@query("c9_clip_outliers", """
SELECT l_orderkey, l_linenumber, greatest(q1 - 0.5 * (q3 - q1), least(l_extendedprice, q3 + 0.5 * (q3 - q1))) AS l_extendedprice
FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)""", {"l_extendedprice": 4})
def _(t: Tables):
    return K.clip_outliers(t.lineitem, "l_extendedprice", 0.5).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("c10_key_candidates", "SELECT event_id, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables):
    """event_id and user_id are named like keys; the first one is counted."""
    keys = K.key_candidates(t.events)
    return t.events.groupBy(keys[0]).agg(F.count(F.lit(1)).alias("n"))


ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def _quality_sql() -> str:
    parts = []
    g = f"({ORDER_GAPS_SQL})"
    for c in ORDER_COLUMNS:
        parts.append(f"SELECT 'column' AS scope, '{c}' AS \"column\", 'missing_rate' AS measure, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) AS value FROM {g}")
        parts.append(f"SELECT 'column', '{c}', 'n_unique', CAST(count(DISTINCT {c}) AS DOUBLE) FROM {g}")
        parts.append(f"SELECT 'column', '{c}', 'unique_rate', count(DISTINCT {c}) / count(*) FROM {g}")
    for c in ("o_orderstatus", "o_orderpriority"):
        parts.append(f"SELECT 'text', '{c}', 'cardinality', CAST(count(DISTINCT {c}) AS DOUBLE) FROM {g}")
        parts.append(f"SELECT 'text', '{c}', 'top_share', max(n) / sum(n) FROM (SELECT count(*) AS n FROM {g} WHERE {c} IS NOT NULL GROUP BY {c})")
    for c in ("o_orderkey", "o_custkey", "o_totalprice"):
        parts.append(
            f"SELECT 'numeric', '{c}', 'outlier_rate_iqr', avg(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0 END) "
            f"FROM orders, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM orders)"
        )
    parts.append(f"SELECT 'table', '*', 'duplicate_rows', CAST(count(*) - count(DISTINCT ({', '.join(ORDER_COLUMNS)})) AS DOUBLE) FROM {g}")
    parts.append(f"SELECT 'table', '*', 'duplicate_rate_all', 1 - count(DISTINCT ({', '.join(ORDER_COLUMNS)})) / count(*) FROM {g}")
    parts.append(f"SELECT 'table', 'o_custkey', 'duplicate_rate_on_keys', 1 - count(DISTINCT o_custkey) / count(*) FROM {g}")
    return " UNION ALL ".join(parts)


@query("c11_quality_report", _quality_sql(), {"value": 6})
def _(t: Tables):
    return K.quality_report(with_order_gaps(t.orders), ["o_custkey"])


@query("c12_worst_columns", f"SELECT * FROM ({_quality_sql()}) WHERE measure = 'unique_rate' ORDER BY value DESC, \"column\" LIMIT 10", {"value": 6})
def _(t: Tables):
    return K.worst(K.quality_report(with_order_gaps(t.orders), ["o_custkey"]), "unique_rate")


@query("d1_row_sample")
def _(t: Tables):
    return D.row_sample(t.lineitem, ["l_orderkey", "l_linenumber"], 0.25)


@query("d1_sample_properties", "SELECT count(*) AS n_rows, 0 AS n_strange, 0 AS n_otherwise, true AS share_near, true AS smaller_inside FROM lineitem")
def _(t: Tables):
    """All sampled rows are rows of the table, whatever its partitions; the share is near, a smaller share lies inside."""
    key = ["l_orderkey", "l_linenumber"]
    own = t.lineitem.select(*key)
    sample = D.row_sample(own, key, 0.25)
    again, less = D.row_sample(own.repartition(7), key, 0.25), D.row_sample(own, key, 0.1)
    sides = (
        own.select(*key, F.lit(1).alias("a"), F.lit(0).alias("s"), F.lit(0).alias("r"), F.lit(0).alias("l"))
        .unionByName(sample.select(*key, F.lit(0).alias("a"), F.lit(1).alias("s"), F.lit(0).alias("r"), F.lit(0).alias("l")))
        .unionByName(again.select(*key, F.lit(0).alias("a"), F.lit(0).alias("s"), F.lit(1).alias("r"), F.lit(0).alias("l")))
        .unionByName(less.select(*key, F.lit(0).alias("a"), F.lit(0).alias("s"), F.lit(0).alias("r"), F.lit(1).alias("l")))
    ).groupBy(*key).agg(*[F.sum(c).alias(c) for c in "asrl"])
    return sides.agg(
        F.sum("a").alias("n_rows"), F.count_if(F.col("s") > F.col("a")).cast("int").alias("n_strange"), F.count_if(F.col("s") != F.col("r")).cast("int").alias("n_otherwise"),
        F.abs(F.sum("s") / F.sum("a") - 0.25).between(0, 0.03).alias("share_near"), (F.count_if(F.col("l") > F.col("s")) == 0).alias("smaller_inside"),
    )


EVENTS_GAPS = "SELECT * REPLACE (CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE props END AS props) FROM events"


def event_gaps(t: Tables):
    e = F.col("event_type")
    return t.events.withColumns({"value": F.when(e != "error", F.col("value")), "props": F.when(~e.isin("error", "view"), F.col("props"))})


@query("d2_missing_rates", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) AS missing_rate FROM ({EVENTS_GAPS})"
    for c in ("event_id", "ts", "user_id", "event_type", "value", "props")), {"missing_rate": 6})
def _(t: Tables):
    return D.missing_rates(event_gaps(t))


@query("d2_row_missingness", f"""
SELECT CAST(quantile_cont(n, 0.5) AS BIGINT) AS p50, CAST(quantile_cont(n, 0.9) AS BIGINT) AS p90, CAST(max(n) AS BIGINT) AS max
FROM (SELECT CAST((value IS NULL) AS INTEGER) + CAST((props IS NULL) AS INTEGER) AS n FROM ({EVENTS_GAPS}))""")
def _(t: Tables):
    return D.row_missingness(event_gaps(t))


NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("d3_numeric_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, quantile_cont({c}, 0.05) AS p05, "
    f"median({c}) AS median, quantile_cont({c}, 0.95) AS p95, max({c}) AS max, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) AS missing_rate FROM ({GAPS_SQL})"
    for c in NUMERIC), {c: 4 for c in ("mean", "std", "min", "p05", "median", "p95", "max", "missing_rate")})
def _(t: Tables):
    return D.numeric_profile(with_gaps(t.lineitem), list(NUMERIC)).drop("std_pop")


@query("d4_outlier_rates", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} < q1 - 0.5 * (q3 - q1) OR {c} > q3 + 0.5 * (q3 - q1) THEN 1.0 ELSE 0 END) AS outlier_rate "
    f"FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)"
    for c in NUMERIC), {"outlier_rate": 6})
def _(t: Tables):
    return K.outlier_rates(t.lineitem, list(NUMERIC), k=0.5)


@query("d5_top_values", f"""
SELECT "column", value, n, CAST(rank AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC NULLS LAST) AS rank FROM (
  SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM ({ORDER_GAPS_SQL}) GROUP BY 2
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM ({ORDER_GAPS_SQL}) GROUP BY 2)) WHERE rank <= 10""")
def _(t: Tables):
    gaps = with_order_gaps(t.orders)
    return D.top_values(gaps, D.categorical_columns(gaps))


@query("d6_uniqueness", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) / count({c}) AS uniqueness_ratio FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
    {"uniqueness_ratio": 6})
def _(t: Tables):
    return D.uniqueness(t.customer)


@query("d6_id_candidates", """
SELECT * FROM (SELECT 'c_custkey' AS "column", count(DISTINCT c_custkey) / count(c_custkey) AS uniqueness_ratio FROM customer
 UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey) / count(c_nationkey) FROM customer) WHERE uniqueness_ratio >= 0.8""", {"uniqueness_ratio": 6})
def _(t: Tables):
    return D.id_candidates(t.customer, ids=["c_custkey", "c_nationkey"])


@query("d7_time_candidates", """
SELECT 'ts' AS "column", 1.0 AS parse_rate, min(ts) AS min_time, max(ts) AS max_time, count(DISTINCT ts) AS n_unique, false AS name_hint FROM events
UNION ALL SELECT 'event_day', 1.0, min(date_trunc('day', ts)), max(date_trunc('day', ts)), count(DISTINCT date_trunc('day', ts)), false FROM events
UNION ALL SELECT 'ship_date', 0.0, NULL, NULL, 0, true""", {"parse_rate": 6})
def _(t: Tables):
    e = t.events.withColumns({"event_day": F.date_format("ts", "yyyy-MM-dd"), "ship_date": F.concat(F.lit("week "), F.col("event_type"))})
    return D.time_candidates(e).drop("position")


@query("d8_measure_candidates", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, stddev_pop({c}) AS std_pop FROM lineitem" for c in NUMERIC), {"std_pop": 4})
def _(t: Tables):
    base = t.lineitem.withColumn("flat", F.lit(3.0))
    return D.measure_candidates(D.numeric_profile(base, [*NUMERIC, "flat"]))


@query("d9_label_candidates", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS cardinality, max(n) / sum(n) AS top_share FROM (SELECT count(*) AS n FROM orders GROUP BY {c})" for c in ("o_orderstatus", "o_orderpriority")),
    {"top_share": 6})
def _(t: Tables):
    return D.label_candidates(t.orders, D.categorical_columns(t.orders))


LI = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query("d10_duplicate_rates", " UNION ALL ".join(
    f"SELECT '{k}' AS keys, count(*) AS n_rows, count(*) - count(DISTINCT ({c})) AS n_duplicates, 1 - count(DISTINCT ({c})) / count(*) AS dup_rate FROM lineitem"
    for k, c in (("*", LI), ("l_orderkey", "l_orderkey, 1"), ("l_partkey", "l_partkey, 1"), ("l_suppkey", "l_suppkey, 1"), ("l_orderkey,l_partkey", "l_orderkey, l_partkey"))),
    {"dup_rate": 6})
def _(t: Tables):
    return D.duplicate_rates(t.lineitem, ["l_orderkey", "l_partkey", "l_suppkey"])


@query("d11_encoding_consistency", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(sum(raw) AS BIGINT) AS raw_level_count, count(*) AS normalized_level_count, "
    f"avg(CASE WHEN form IN ('0','1','y','n','yes','no','true','false','t','f') THEN 1.0 ELSE 0 END) AS boolish_level_share, sum(raw) > count(*) AS fragmented "
    f"FROM (SELECT lower({strip_sql(c)}) AS form, count(DISTINCT {c}) AS raw FROM ({MESSY_SQL}) GROUP BY 1)" for c in ("source", "lang")),
    {"boolish_level_share": 6})
def _(t: Tables):
    return D.encoding_consistency(messy(t), ["source", "lang"])


@query("d12_uninformative", """
SELECT 'constant' AS "column", 'one_value' AS reason, 0.0 AS missing_rate UNION ALL SELECT 'empty', 'mostly_empty', 1.0
UNION ALL SELECT 'empty', 'one_value', 1.0 UNION ALL SELECT 'rare', 'mostly_empty', avg(CASE WHEN value < 60 THEN 1.0 ELSE 0 END) FROM events
HAVING avg(CASE WHEN value < 60 THEN 1.0 ELSE 0 END) >= 0.95""", {"missing_rate": 6})
def _(t: Tables):
    v = F.col("value")
    wide = t.events.withColumns({"constant": F.lit("x"), "empty": F.when(v < -1e18, v), "rare": F.when(v >= 60, v)})
    return D.uninformative(wide)


def _pairs_sql(table: str, columns) -> str:
    out = []
    for i, a in enumerate(columns):
        for b in columns[i + 1:]:
            out.append(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM {table}")
    return " UNION ALL ".join(out)


@query("d13_top_correlations", f"SELECT * FROM ({_pairs_sql('lineitem', NUMERIC + ('l_linenumber',))}) ORDER BY abs(corr) DESC, a, b LIMIT 8", {"corr": 6})
def _(t: Tables):
    return D.top_correlations(t.lineitem, [*NUMERIC, "l_linenumber"])


@query("d14_quality_flags", f"""
SELECT CAST(1 AS INTEGER) AS rank, 'missingness' AS code, 'o_orderpriority' AS "column", avg(CASE WHEN o_orderpriority IS NULL THEN 1.0 ELSE 0 END) AS value
FROM ({ORDER_GAPS_SQL}) HAVING avg(CASE WHEN o_orderpriority IS NULL THEN 1.0 ELSE 0 END) >= 0.10
UNION ALL SELECT 3, 'time_parse_risk', 'note_date', 0.0
UNION ALL SELECT 4, 'encoding_fragmentation', 'status_text', NULL""", {"value": 6})
def _(t: Tables):
    status = F.when(F.col("o_custkey") < 100, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))
    o = with_order_gaps(t.orders).withColumns({"note_date": F.lit("not yet"), "status_text": status})
    return D.quality_flags(
        D.missing_rates(o), D.duplicate_rates(o, ["o_orderkey"]), D.time_candidates(o),
        D.encoding_consistency(o, ["o_orderstatus", "status_text"]),
    )

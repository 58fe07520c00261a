"""Queries of sections 2.1-2.3: sources, columns, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions.numbers import finite
from tabulon.operators import columns as C
from tabulon.operators.predicates import Condition, complete_rows, known_columns, where_all, where_guarded, where_plain
from tabulon.operators.profile import numeric_profile, uninformative
from tabulon.plans.catalog.base import GAPS_SQL, Tables, query, strip_sql, with_gaps
from tabulon.plans.registry import monthly_price_by_flag
from tabulon.session import new_path
from tabulon.sources import readers, writers


@query("z4_monthly_price_by_flag", """
SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS time_bucket, l_returnflag,
       avg(l_extendedprice) AS mean_l_extendedprice, count(*) AS n_records
FROM lineitem WHERE l_discount >= 0.02 GROUP BY 1, 2""", {"mean_l_extendedprice": 6})
def _(t: Tables):
    return monthly_price_by_flag(t.lineitem)


@query("s1_csv_scan", "SELECT p_partkey, p_name, p_brand, p_type, p_size, CASE WHEN p_size > 25 THEN NULL ELSE p_retailprice END AS p_retailprice FROM part")
def _(t: Tables):
    """Every part as a text line; the dearer half lacks its last field, and each part has an over-long twin."""
    path = new_path(t.spark, "part-csv")
    part = t.part
    good = F.concat_ws(",", *[F.when((F.col("p_size") <= 25) | F.lit(c != "p_retailprice"), F.col(c).cast("string")) for c in part.columns])
    bad = F.concat_ws(",", *[F.col(c).cast("string") for c in part.columns], F.lit("x"), F.lit("y"))
    lines = part.select(F.explode(F.array(good, bad)).alias("value"))
    lines.write.text(path)
    return readers.read_csv(t.spark, path, part.schema, header=False)


@query("s2_document_scan", """
SELECT CAST(sum(length(text) + 1) AS BIGINT) AS n_chars,
       CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines FROM documents""")
def _(t: Tables):
    """All documents written as text files of at most 50 texts each and scanned file by file."""
    path = new_path(t.spark, "notes")
    t.documents.select("text").write.option("maxRecordsPerFile", 50).text(path)
    files = readers.read_documents(t.spark, path)
    return files.agg(
        F.sum(F.length("text")).alias("n_chars"), F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("n_lines")
    )


@query("s3_json_lines_scan", "SELECT event_id, user_id, event_type, value FROM events")
def _(t: Tables):
    """All events as JSON lines with a blank line after each, scanned back."""
    path = new_path(t.spark, "events-jsonl")
    line = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    t.events.select(F.explode(F.array(line, F.lit("  "))).alias("value")).write.text(path)
    rows = readers.read_json_lines(t.spark, path, "event_id bigint, user_id bigint, event_type string, value double")
    return rows.select("record.*")


@query("s4_content_hash", "SELECT doc_id, sha256(text) AS source_id FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", readers.content_hash("text").alias("source_id"))


CHUNKS_SQL = """
SELECT source_rank, source_path, CAST(row_number() OVER (PARTITION BY source_rank, source_path ORDER BY start) - 1 AS INTEGER) AS chunk_no, substr(text, start + 1, 1200) AS text
FROM (SELECT source_rank, source_path, text, unnest(CASE WHEN length(text) <= 1200 THEN [0] ELSE range(0, length(text) - 150, 1050) END) AS start
      FROM (SELECT 0 AS source_rank, CAST(doc_id AS VARCHAR) AS source_path, replace(text, chr(13) || chr(10), chr(10)) AS text FROM documents
            UNION ALL SELECT 1, CAST(item_id AS VARCHAR), replace(text, chr(13) || chr(10), chr(10)) FROM benchmark)
      WHERE length(text) > 1200 OR {blank} <> '')""".format(blank=strip_sql("text"))


@query("s5_source_union", f"""
SELECT source_rank, source_path, chunk_no, sha256(text) AS text_hash
FROM ({CHUNKS_SQL})""")
def _(t: Tables):
    def chunks(df, key, kind):
        return readers.document_chunks(df.select(F.col(key).cast("string").alias("source_id"), F.col(key).cast("string").alias("source_path"), "text"), kind)

    both = readers.combine_sources([chunks(t.documents, "doc_id", "txt"), chunks(t.benchmark, "item_id", "jsonl")])
    return both.select("source_rank", "source_path", "chunk_no", F.sha2("text", 256).alias("text_hash"))


@query("s6_payload_sink", """
SELECT '{"text":"customer","artifacts":{"images":[]},"tables":{"row":{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}}}' AS payload FROM customer""")
def _(t: Tables):
    path = new_path(t.spark, "payload")
    writers.write_payload(writers.as_payload(t.customer.select("c_custkey", "c_mktsegment"), "customer"), path)
    return t.spark.read.text(path).withColumnRenamed("value", "payload")


@query("s7_table_sink", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS mean_quantity FROM lineitem GROUP BY 1, 2")
def _(t: Tables):
    path = new_path(t.spark, "table")
    rates = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean_quantity"))
    writers.write_table(rates, path)
    return t.spark.read.parquet(path)


@query("p1_select_existing", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t: Tables):
    return C.select_existing(t.orders, ["o_orderkey", "no_such_column", "o_totalprice"])


@query("p2_table_order", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def _(t: Tables):
    return C.in_table_order(t.customer, ["c_mktsegment", "c_custkey", "c_acctbal", "c_custkey"])


@query("p3_drop_uninformative", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def _(t: Tables):
    """Two useless columns added, found by the profile and dropped again."""
    wide = t.events.withColumn("constant", F.lit("x")).withColumn("empty", F.when(F.col("value") < -1e18, F.col("value")))
    return C.drop_uninformative(wide, uninformative(wide))


@query("p4_metric_first", "SELECT l_returnflag, l_shipdate, l_discount, l_quantity, l_tax FROM lineitem")
def _(t: Tables):
    names = ["l_quantity", "l_returnflag", "l_tax", "l_discount", "l_shipdate"]
    return t.lineitem.select(*C.metric_first(t.lineitem, names, "l_discount"))


@query("p5_ensure_metric", "SELECT l_quantity, l_discount, l_tax FROM lineitem")
def _(t: Tables):
    names = C.ensure_metric(["l_quantity", "l_orderkey", "l_tax"], "l_discount", 3, ids=["l_orderkey"], times=[])
    return t.lineitem.select(*names)


@query("p6_rank_numeric", """
SELECT column_name AS "column", is_metric, score, missing_rate, std FROM (
 SELECT 'l_quantity' AS column_name, 0 AS is_metric, 0.0 AS score, avg(CASE WHEN l_quantity IS NULL THEN 1.0 ELSE 0 END) AS missing_rate, stddev_samp(l_quantity) AS std FROM (%(g)s)
 UNION ALL SELECT 'l_discount', 1, 0.0, 0.0, stddev_samp(l_discount) FROM lineitem
 UNION ALL SELECT 'l_tax', 0, 2.5, 0.0, stddev_samp(l_tax) FROM lineitem
 UNION ALL SELECT 'l_extendedprice', 0, 0.0, 0.0, stddev_samp(l_extendedprice) FROM lineitem)""" % {"g": GAPS_SQL},
       {"missing_rate": 6, "std": 4, "score": 2})
def _(t: Tables):
    stats = numeric_profile(with_gaps(t.lineitem), ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]).select("column", "missing_rate", "std")
    return C.rank_numeric(stats, "l_discount", {"l_tax": 2.5}).select("column", "is_metric", "score", "missing_rate", "std")


@query("p7_feature_columns", "SELECT o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def _(t: Tables):
    names = C.feature_columns(t.orders, t.orders.columns, ids=["o_orderkey", "o_custkey"], times=["o_orderdate"])
    return t.orders.select(*names)


@query("p8_usable_columns", "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem")
def _(t: Tables):
    ids = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return t.lineitem.select(*C.usable_numeric(t.lineitem, ids), *C.usable_labels(t.lineitem, ids))


@query("p9_derived_columns", "SELECT l_orderkey AS order_id, l_linenumber, l_extendedprice * (1 - l_discount) AS net_price FROM lineitem", {"net_price": 4})
def _(t: Tables):
    return t.lineitem.withColumns({"net_price": F.col("l_extendedprice") * (1 - F.col("l_discount"))}).withColumnRenamed(
        "l_orderkey", "order_id"
    ).select("order_id", "l_linenumber", "net_price")


def _count(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("f1_equals", "SELECT * FROM orders WHERE trim(o_orderpriority) = '1-URGENT'")
def _(t: Tables):
    return where_all(t.orders, [Condition("o_orderpriority", "==", [" 1-URGENT "])])


@query("f1_equals_null", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '5-LOW'""")
def _(t: Tables):
    gaps = t.orders.withColumn("p", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))
    return where_all(gaps, [Condition("p", "==", [])]).select("o_orderkey", "o_custkey")


@query("f2_equals_list", "SELECT * FROM orders WHERE trim(o_orderstatus) IN ('F', 'P')")
def _(t: Tables):
    return where_all(t.orders, [Condition("o_orderstatus", "==", ["F", " P"])])


@query("f3_not_equals", f"SELECT l_orderkey, l_linenumber, l_quantity FROM ({GAPS_SQL}) WHERE (l_quantity IS NULL OR l_quantity <> 10) AND l_returnflag <> 'R'")
def _(t: Tables):
    kept = where_all(with_gaps(t.lineitem), [Condition("l_quantity", "!=", 10), Condition("l_returnflag", "!=", " R")])
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query("f4_not_null_not_in", """
SELECT o_orderkey, p FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS p FROM orders)
WHERE o_orderstatus IS NOT NULL AND (p IS NULL OR p NOT IN ('1-URGENT', '5-LOW'))""")
def _(t: Tables):
    gaps = t.orders.withColumn("p", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")))
    kept = where_all(gaps, [Condition("o_orderstatus", "!=", None), Condition("p", "!=", ["1-URGENT", "5-LOW"])])
    return kept.select("o_orderkey", "p")


@query("f5_thresholds", """
SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem
WHERE CAST(CAST(l_quantity AS VARCHAR) AS DOUBLE) > 20 AND l_tax <= 0.04 AND l_shipdate >= TIMESTAMP '1997-01-01'""")
def _(t: Tables):
    text = t.lineitem.withColumn("q", F.col("l_quantity").cast("string"))
    kept = where_all(text, [Condition("q", ">", "20"), Condition("l_tax", "<=", 0.04), Condition("l_shipdate", ">=", "1997-01-01")])
    return kept.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")


@query("f6_in", "SELECT * FROM part WHERE trim(p_brand) IN ('Brand#1', 'Brand#12') AND p_size IN (5, 10, 15)")
def _(t: Tables):
    return where_all(t.part, [Condition("p_brand", "in", ["Brand#1", "Brand#12"]), Condition("p_size", "in", [5, 10, 15])])


@query("f7_contains", "SELECT * FROM part WHERE regexp_matches(p_name, '(?i)RING') OR regexp_matches(p_name, '(?i)^red')")
def _(t: Tables):
    return where_all(t.part, [Condition("p_name", "contains", ["RING", "^red"])])


@query("f8_guarded_filters", "SELECT * FROM lineitem WHERE l_returnflag = 'A' AND l_discount >= 0.05")
def _(t: Tables):
    """The impossible quantity, the unknown column and the clash with the first filter are skipped."""
    return where_guarded(t.lineitem, [
        Condition("l_returnflag", "==", "A"), Condition("l_quantity", ">", 99), Condition("nope", "==", 1),
        Condition("l_returnflag", "==", "R"), Condition("l_discount", ">=", 0.05),
    ])[0]


@query("f9_schema_guard", "SELECT * FROM orders WHERE o_totalprice > 100000")
def _(t: Tables):
    return where_all(t.orders, known_columns(t.orders, [Condition("gone", "==", 1), Condition("o_totalprice", ">", 100000)]))


@query("f10_plain_filters", "SELECT * FROM orders WHERE o_orderstatus = 'F' AND contains(o_orderpriority, 'HIGH') AND o_totalprice < 300000")
def _(t: Tables):
    return where_plain(t.orders, [
        Condition("o_orderstatus", "==", "F"), Condition("o_orderpriority", "contains", "HIGH"),
        Condition("o_orderstatus", "in", "F"), Condition("o_totalprice", "<", 300000),
    ])


@query("f11_keep_baseline", "SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1998-01-01'")
def _(t: Tables):
    return where_guarded(t.lineitem, [
        Condition("l_extendedprice", ">", 50000), Condition("l_returnflag", "==", "R"), Condition("l_shipdate", ">=", "1998-01-01"),
    ], preserve_baseline=True)[0]


@query("f12_null_range_finite", f"""
SELECT l_orderkey, l_linenumber, l_quantity FROM ({GAPS_SQL}) WHERE l_quantity IS NOT NULL AND l_quantity BETWEEN 10 AND 20 AND l_discount > 0""")
def _(t: Tables):
    """Price per discount is infinite or NaN where the discount is zero."""
    odd = with_gaps(t.lineitem).withColumn(
        "per_discount", finite(F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_extendedprice") / F.col("l_discount")))
    )
    kept = complete_rows(odd, ["l_quantity", "per_discount"]).filter(F.col("l_quantity").between(10, 20))
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query("f13_paired_rows", f"""
SELECT l_returnflag, count(*) AS n FROM ({GAPS_SQL}) WHERE l_quantity IS NOT NULL AND (CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END) IS NOT NULL GROUP BY 1""")
def _(t: Tables):
    gaps = with_gaps(t.lineitem).withColumn("l_tax", F.when(F.col("l_tax") != 0, F.col("l_tax")))
    return _count(complete_rows(gaps, ["l_quantity", "l_tax"]), "l_returnflag")

"""Registration of queries: a Spark callable and, where SQL can say it, the same answer in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulon.functions.text import WHITESPACE
from tabulon.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of one folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


def query(name: str, sql: str | None = None, digits: dict[str, int] | None = None):
    """Register ``fn(tables) -> DataFrame``. ``digits`` rounds the named columns on both sides."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = fn(Tables(spark, folder))
            if digits:
                out = out.withColumns({c: F.round(F.col(c), d) + F.lit(0.0) for c, d in digits.items()})
            return out

        QUERIES[name] = run
        if sql is not None:
            text = sql.strip()
            if digits:
                changed = ", ".join(f'round("{c}", {d}) + 0.0 AS "{c}"' for c, d in digits.items())
                text = f"SELECT * REPLACE ({changed}) FROM (\n{text}\n)"
            ORACLES[name] = text
        return fn

    return wrap


def strip_sql(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def in_sql(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


# lineitem with gaps: the seventh line of an order has no quantity.
GAPS_SQL = "SELECT * REPLACE (CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS l_quantity) FROM lineitem"


def with_gaps(lineitem: DataFrame) -> DataFrame:
    return lineitem.withColumn("l_quantity", F.when(F.col("l_linenumber") != 7, F.col("l_quantity")))


# orders joined to nothing, with the lowest priority unknown.
ORDER_GAPS_SQL = "SELECT * REPLACE (CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS o_orderpriority) FROM orders"


def with_order_gaps(orders: DataFrame) -> DataFrame:
    return orders.withColumn("o_orderpriority", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))


# Flat table: one row per order line with order and part attributes.
FLAT_SQL = (
    "SELECT l.*, o.o_orderstatus, o.o_orderpriority, p.p_brand, p.p_type, p.p_size "
    "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey"
)


def flat(t: Tables, lines: DataFrame | None = None) -> DataFrame:
    """The lines (default: all of lineitem) with attributes of their order and part."""
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    p = t.part.select("p_partkey", "p_brand", "p_type", "p_size")
    joined = (t.lineitem if lines is None else lines).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return joined.drop("o_orderkey", "p_partkey")

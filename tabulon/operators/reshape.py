"""Set operations and reshaping U1-U10, comparison joins J3-J7."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.numbers import number, one_row
from tabulon.functions.running import running
from tabulon.functions.text import strip
from tabulon.operators.aggregate import value_counts


#: Groups in one bitmap of Spark's bitmap functions.
BITMAP_BITS = 32_768


def union_all(frames: list[DataFrame]) -> DataFrame:
    """U1."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def missing_ids(df: DataFrame, group: str, key: str) -> DataFrame:
    """Per group the ids that other groups have and it has not, one row each.

    Groups are numbered, and each id has a bitmap of its groups for every 32,768 numbers. Bits are counted per id, which
    settles the ids that all groups have; for the others the bits that are not set become rows, so no more is made than
    the result holds, and no list of all groups. A null group is a group, null ids are none.
    """
    groups = running(df.select(F.col(f"`{group}`").alias("__group")).distinct(), [F.col("__group")], number="__no")
    n_groups = groups.count()
    pairs = df.filter(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{group}`").alias("__g"), F.col(f"`{key}`").alias("__id")).distinct()
    numbered = pairs.join(groups, F.col("__g").eqNullSafe(F.col("__group"))).select("__id", "__no")
    bits = numbered.groupBy("__id", F.bitmap_bucket_number("__no").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__no")).alias("__have"))
    lacking = bits.groupBy("__id").agg(F.sum(F.bitmap_count("__have")).alias("n")).filter(F.col("n") < n_groups).select("__id")
    buckets = F.explode(F.sequence(F.lit(1), F.lit(max(1, -(-n_groups // BITMAP_BITS)))).cast("array<bigint>"))
    kept = lacking.withColumn("__bucket", buckets).join(bits, ["__id", "__bucket"], "left")
    first = (F.col("__bucket") - 1) * BITMAP_BITS
    places = F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(BITMAP_BITS - 1), n_groups - 1 - first))
    byte = lambda at: F.conv(F.hex(F.substring("__have", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    unset = F.filter(places, lambda at: F.col("__have").isNull() | (F.getbit(byte(at), (at % 8).cast("int")) == 0))
    missing = kept.select("__id", F.explode(unset).alias("__at"), first.alias("__first")).select("__id", (F.col("__first") + F.col("__at") + 1).alias("__no"))
    return missing.join(groups, "__no").select(F.col("__group").alias(group), F.col("__id").alias(key))


def duplicate_ids(df: DataFrame, group: str, key: str) -> DataFrame:
    """Ids that occur more than once in a group, one row each."""
    return df.filter(F.col(key).isNotNull()).groupBy(group, key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def id_report(df: DataFrame, group: str, key: str) -> DataFrame:
    """Per group its rows, distinct ids, repeated ids and missing ids, as counts."""
    per_id = df.groupBy(group, key).agg(F.count(F.lit(1)).alias("n"))
    base = per_id.groupBy(group).agg(
        F.sum("n").alias("n_rows"), F.count(key).alias("n_unique_ids"),
        F.count_if((F.col("n") > 1) & F.col(key).isNotNull()).alias("n_duplicate_ids"),
    )
    total = one_row(df.agg(F.count_distinct(key).alias("n")))["n"]
    return base.withColumn("n_missing_ids", total - F.col("n_unique_ids"))


def same_set(a: Column, b: Column) -> Column:
    """Equal as sets."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def subset(a: Column, b: Column) -> Column:
    """Every element of a is in b."""
    return F.size(F.array_except(a, b)) == 0


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "system", value: str = "score") -> DataFrame:
    """Wide to long; texts that are no numbers are dropped."""
    wide = df.select(*ids, *[number(df, v).alias(v) for v in values])
    return wide.unpivot(ids, values, name, value).filter(F.col(value).isNotNull())


def pivot_mean(df: DataFrame, index: list[str], column: str, value: str, order: list) -> DataFrame:
    """Long to wide with means, columns in the given order, so no pass to find the values."""
    return df.groupBy(*index).pivot(column, order).agg(F.avg(value))


def row_mean(df: DataFrame, columns: list[str], digits: int = 2) -> Column:
    """U8: mean of the columns that are set, rounded."""
    xs = [number(df, c) for c in columns]
    total = reduce(Column.__add__, [F.coalesce(x, F.lit(0.0)) for x in xs])
    n = reduce(Column.__add__, [x.isNotNull().cast("int") for x in xs])
    return F.round(F.try_divide(total, n.cast("double")), digits)


def row_min(columns: list[str]) -> Column:
    """Smallest of the columns, null ones left out."""
    return F.least(*[F.col(f"`{c}`") for c in columns]) if len(columns) > 1 else F.col(columns[0])


def one_hot(df: DataFrame, column: str, top: int = 20, prefix: str | None = None) -> DataFrame:
    """0/1 columns for the largest levels and one for the rest; at most ``top`` names reach the driver."""
    v = F.coalesce(strip(F.col(f"`{column}`").cast("string")), F.lit("(missing)"))
    base = df.withColumn("__v", v)
    kept = [r["value"] for r in value_counts(base, "__v").orderBy(F.col("n").desc(), "value").limit(top).collect()]
    p = prefix or column
    named = {f"{p}_{k}": (F.col("__v") == k).cast("int") for k in kept}
    named[f"{p}_(other)"] = (~F.col("__v").isin(*kept)).cast("int")
    return base.withColumns(named).drop("__v")


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    """The right side of a many-to-one join has one row per key."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    if repeated:
        raise ValueError(f"keys {keys} are not unique on the right side")


def join_baseline(variants: DataFrame, base: DataFrame, keys: list[str], fields: list[str], check: bool = True) -> DataFrame:
    """Variant rows with the fields of their baseline row as ``<field>_base``."""
    if check:
        assert_unique(base, keys)
    right = base.select(*keys, *[F.col(f).alias(f"{f}_base") for f in fields], F.lit(True).alias("has_base"))
    return variants.join(right, keys, "left").withColumn("has_base", F.coalesce("has_base", F.lit(False)))


def compare_counts(a: DataFrame, b: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Two count tables side by side, absent values as zero."""
    left = a.select(key, F.col(n).alias("n_a"))
    right = b.select(F.col(key).alias("__k"), F.col(n).alias("n_b"))
    return left.join(right, F.col(key).eqNullSafe(F.col("__k")), "full_outer").select(
        F.coalesce(F.col(key), F.col("__k")).alias(key), F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"),
    )

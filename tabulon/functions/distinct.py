"""Distinct values and repeats without their texts: fingerprints of 128 bits, and sketches as a gate.

Two values are taken as equal if two 64-bit hashes with different seeds are, so what is shuffled doesn't grow with the
length of texts. Among 10^12 different values the odds that any two are taken as one are below 10^-14.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SEEDS = (1, 2)
#: A sketch of 2^12 registers has a standard error of 1.6 %; a column is out only if it is six errors above the bound.
REGISTERS_LOG2 = 12
SLACK = 1.1


def fingerprint(values: list[Column]) -> list[Column]:
    """Two hashes of the values; which of them are null is part of it, as hashing passes over nulls."""
    empty = [v.isNull() for v in values]
    return [F.xxhash64(F.lit(seed), *values, *empty) for seed in SEEDS]


def counts_by_value(df: DataFrame, columns: dict[str, Column], extra: dict[str, dict[str, Column]] | None = None) -> DataFrame:
    """(column, value, n) for every distinct value of several columns from one pass; ``value`` is a hash, null for null.

    ``extra`` names further numbers per column that are the same for equal values; they come along.
    """
    names = list(columns)
    more = sorted(next(iter(extra.values()))) if extra else []
    parts = []
    for i, name in enumerate(names):
        first, second = (F.when(columns[name].isNotNull(), h) for h in fingerprint([columns[name]]))
        parts.append(F.struct(F.lit(i).alias("i"), first.alias("value"), second.alias("second"), *[extra[name][m].alias(m) for m in more]))
    counts = df.select(F.inline(F.array(*parts))).groupBy("i", "value", "second").agg(F.count(F.lit(1)).alias("n"), *[F.min(m).alias(m) for m in more])
    return counts.withColumn("column", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1)).drop("i", "second")


def exact_distinct(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(column, n_distinct, n): distinct and all values that aren't null, one row per column, from one pass."""
    counts = counts_by_value(df, columns)
    found = counts.groupBy("column").agg(F.count("value").alias("n_distinct"), F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("n"))
    names = df.sparkSession.sql("SELECT 1 AS one").select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    return names.join(found, "column", "left").select("column", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), F.coalesce("n", F.lit(0)).alias("n"))


def estimates(df: DataFrame, columns: dict[str, Column], facts: list[Column] | None = None):
    """One row with the estimated number of distinct values of each column, from mergeable sketches of fixed size."""
    sketches = [
        F.hll_sketch_estimate(F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v)), REGISTERS_LOG2)).alias(c) for c, v in columns.items()
    ]
    return df.agg(*sketches, *(facts or [])).first()


def distinct_up_to(df: DataFrame, columns: dict[str, Column], most: int) -> dict[str, int]:
    """The exact number of distinct values of each column that has at most ``most``; others are left out.

    One pass of sketches drops columns of clearly more values. Only the rest, which have few, are counted by value.
    """
    if not columns:
        return {}
    row = estimates(df, columns)
    near = {c: v for c, v in columns.items() if (row[c] or 0) <= most * SLACK + 1}
    if not near:
        return {}
    found = {r["column"]: r["n_distinct"] for r in exact_distinct(df, near).collect()}
    return {c: found[c] for c in columns if c in found and found[c] <= most}

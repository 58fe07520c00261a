"""Column profile D1-D14 as small long tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from tabulon.functions import roles
from tabulon.functions.distinct import counts_by_value, distinct_up_to, estimates, exact_distinct, fingerprint
from tabulon.functions.numbers import at_most, correlations, is_numeric, is_time, number, ratio, to_long
from tabulon.functions.text import normal
from tabulon.operators.aggregate import as_time, number_stats
from tabulon.operators.clean import (
    duplicate_share, level_counts, level_facts, read_time, text_columns,
)

# Texts that code a yes/no answer.
BOOLEAN_LEVELS = ("0", "1", "y", "n", "yes", "no", "true", "false", "t", "f")


def row_sample(df: DataFrame, key: list[str], share: float, seed: int = 0) -> DataFrame:
    """A repeatable sample by a hash of the row key; the same rows whatever the partitioning."""
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in key]), F.lit(1_000_000)) < int(share * 1_000_000))


def missing_rates(df: DataFrame) -> DataFrame:
    """One row per column, one pass."""
    wide = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in df.columns])
    return to_long(wide, [], {c: F.col(f"`{c}`") for c in df.columns}, "column", "missing_rate")


def row_missingness(df: DataFrame) -> DataFrame:
    """Quantiles of the nulls per row; there are at most as many values as columns."""
    n = sum((F.col(f"`{c}`").isNull().cast("int") for c in df.columns), F.lit(0))
    freq = df.groupBy(n.cast("double").alias("v")).agg(F.count(F.lit(1)).alias("f"))
    return freq.agg(
        F.percentile("v", F.lit(0.5), F.col("f")).cast("bigint").alias("p50"),
        F.percentile("v", F.lit(0.9), F.col("f")).cast("bigint").alias("p90"),
        F.max("v").cast("bigint").alias("max"),
    )


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """D3: count, mean, std, min, p05, median, p95, max per numeric column."""
    names = columns or roles.numeric_columns(df)
    wide = number_stats(df, names, [0.05, 0.5, 0.95])
    rows = {
        c: F.struct(
            F.col(f"{c}__n").alias("n"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"),
            F.col(f"{c}__min").alias("min"), F.col(f"{c}__q")[0].alias("p05"), F.col(f"{c}__q")[1].alias("median"),
            F.col(f"{c}__q")[2].alias("p95"), F.col(f"{c}__max").alias("max"),
            ratio(F.col("n_total") - F.col(f"{c}__n"), F.col("n_total"), 0.0).alias("missing_rate"),
            F.col(f"{c}__std_pop").alias("std_pop"),
        )
        for c in names
    }
    return to_long(wide, [], rows, "column", "s").select("column", "s.*").filter("n > 0")


def categorical_columns(df: DataFrame, max_levels: int = 200, limit: int | None = None) -> list[str]:
    """Columns that are neither numeric nor time and have few levels; only those with few are counted."""
    names = [f.name for f in df.schema if not is_numeric(f) and not is_time(f)]
    levels = distinct_up_to(df, {c: F.col(f"`{c}`").cast("string") for c in names}, max_levels)
    return [c for c in names if c in levels][:limit]


def top_values(df: DataFrame, columns: list[str], k: int | None = 10) -> DataFrame:
    """The k most frequent values per column, null included."""
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    ranked = level_counts(df, columns).withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def uniqueness(df: DataFrame, columns: list[str] | None = None, approximate: float | None = None) -> DataFrame:
    """Distinct values over non-null values per column."""
    names = columns or df.columns
    if approximate is None:
        counts = exact_distinct(df, {c: F.col(f"`{c}`") for c in names})
        return counts.select("column", ratio(F.col("n_distinct"), F.col("n"), 0.0).alias("uniqueness_ratio"))
    aggs = []
    for c in names:
        x = F.col(f"`{c}`")
        aggs += [F.approx_count_distinct(x, approximate).alias(f"{c}__d"), F.count(x).alias(f"{c}__n")]
    wide = df.agg(*aggs)
    rows = {c: ratio(F.col(f"{c}__d"), F.col(f"{c}__n"), 0.0) for c in names}
    return to_long(wide, [], rows, "column", "uniqueness_ratio")


def first_rows(df: DataFrame, n: int | None, *order) -> DataFrame:
    """In this order, all rows or the first ``n``."""
    ordered = df.orderBy(*order)
    return ordered if n is None else ordered.limit(n)


def id_candidates(df: DataFrame, ids: list[str] | None = None, floor: float = 0.8, k: int | None = None) -> DataFrame:
    """Id-like columns that are nearly unique; only those that may be by their sketch are counted."""
    names = ids if ids is not None else [c for c in df.columns if roles.key_like(c)]
    cols = {c: F.col(f"`{c}`") for c in names}
    if cols:
        row = estimates(df, cols, [F.count(x).alias(f"{c}__n") for c, x in cols.items()])
        names = [c for c in names if row[f"{c}__n"] and row[c] >= floor * 0.9 * row[f"{c}__n"]]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, uniqueness_ratio double")
    found = uniqueness(df, names).filter(F.col("uniqueness_ratio") >= floor)
    return first_rows(found, k, F.col("uniqueness_ratio").desc(), "column")


def time_candidates(df: DataFrame, times: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Time columns by type, by at least 90% readable texts, or by name, with their coverage."""
    names, aggs, readings = [], [], {}
    hinted = {c: (c in times if times is not None else roles.time_like(c)) for c in df.columns}
    for f in df.schema:
        if is_numeric(f) and not hinted[f.name]:
            continue
        x = F.col(f"`{f.name}`")
        if is_time(f):
            t, rate = as_time(df, f.name), F.lit(1.0)
        elif f.name in text_columns(df):
            t = read_time(x)
            rate = ratio(F.count(t), F.count(x), 0.0)
        else:
            t, rate = F.lit(None).cast("timestamp_ntz"), F.lit(0.0)
        names.append(f.name)
        readings[f.name] = t
        aggs.append(F.struct(
            rate.alias("parse_rate"), F.min(t).alias("min_time"), F.max(t).alias("max_time"),
            F.lit(hinted[f.name]).alias("name_hint"), F.lit(df.columns.index(f.name)).alias("position"),
        ).alias(f.name))
    kinds = "column string, parse_rate double, min_time timestamp_ntz, max_time timestamp_ntz, name_hint boolean, position int"
    found = []
    if names:
        row = df.agg(*aggs).first()  # a few facts per column; only columns that stay are counted by value
        found = [(c, *row[c]) for c in names if (row[c]["parse_rate"] or 0.0) >= 0.9 or row[c]["name_hint"]]
    out = df.sparkSession.createDataFrame(found, kinds)
    unique = exact_distinct(df, {c: readings[c] for c, *_ in found}).select("column", F.col("n_distinct").alias("n_unique")) if found else None
    out = out.join(unique, "column") if found else out.withColumn("n_unique", F.lit(0).cast("bigint"))
    out = out.select("column", "parse_rate", "min_time", "max_time", "n_unique", "name_hint", "position")
    return first_rows(out, limit, "position")


def measure_candidates(stats: DataFrame, limit: int | None = None) -> DataFrame:
    """Numeric columns with at least five values and some spread, from D3."""
    return first_rows(stats.filter((F.col("n") >= 5) & (F.col("std_pop") > 0)).select("column", "n", "std_pop"), limit, "column")


def label_candidates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with 2-200 levels and the share of the top one; only columns with few levels are counted."""
    few = distinct_up_to(df, {c: F.col(f"`{c}`") for c in columns}, 200)
    if not few:
        return df.sparkSession.createDataFrame([], "column string, cardinality bigint, top_share double")
    return level_facts(df, list(few)).filter(
        (F.col("n_distinct") >= 2) & (F.col("n_distinct") <= 200)
    ).select("column", F.col("n_distinct").alias("cardinality"), "top_share")


def duplicate_rates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Whole rows, each key, the first two keys together."""
    sets = [("*", df.columns)] + [(k, [k]) for k in keys]
    if len(keys) >= 2:
        sets.append((",".join(keys[:2]), keys[:2]))
    out = None
    for name, cols in sets:
        part = duplicate_share(df, cols).select(F.lit(name).alias("keys"), "n_rows", "n_duplicates", "dup_rate")
        out = part if out is None else out.unionByName(part)
    return out


def encoding_consistency(df: DataFrame, columns: list[str]) -> DataFrame:
    """Raw and normalised level counts per text column, from fingerprints of the texts and of their forms."""
    texts = {c: F.col(f"`{c}`").cast("string") for c in columns}
    forms = {}
    for c in columns:
        form = normal(c)
        a, b = fingerprint([form])
        forms[c] = {"form": a, "other": b, "boolish": form.isin(*BOOLEAN_LEVELS).cast("int")}
    levels = counts_by_value(df, texts, forms).filter("value is not null")
    by_form = levels.groupBy("column", "form", "other").agg(F.count(F.lit(1)).alias("raw"), F.max("boolish").alias("boolish"))
    return by_form.groupBy("column").agg(
        F.sum("raw").alias("raw_level_count"), F.count(F.lit(1)).alias("normalized_level_count"),
        F.avg(F.col("boolish").cast("double")).alias("boolish_level_share"),
    ).withColumn("fragmented", F.col("raw_level_count") > F.col("normalized_level_count"))


def uninformative(df: DataFrame) -> DataFrame:
    """Mostly empty (95%), at most one value, or one text value with 99.5%; one row per finding.

    Numbers and times need no distinct count: one value means min = max. Only texts are counted.
    """
    texts = text_columns(df)
    others = [c for c in df.columns if c not in texts]
    parts = []
    if others:
        wide = df.agg(*[
            F.struct(
                F.avg(F.col(f"`{c}`").isNull().cast("double")).alias("missing_rate"),
                F.min(F.col(f"`{c}`")).eqNullSafe(F.max(F.col(f"`{c}`"))).alias("constant"),
            ).alias(c)
            for c in others
        ])
        long = to_long(wide, [], {c: F.col(f"`{c}`") for c in others}, "column", "s")
        parts.append(long.select("column", F.col("s.missing_rate").alias("missing_rate"), F.when(F.col("s.constant"), F.lit("one_value")).alias("reason")))
    if texts:
        s = level_facts(df, texts)
        reason = F.when(F.col("n_distinct") <= 1, F.lit("one_value")).when(F.col("top_share") >= 0.995, F.lit("top_share"))
        parts.append(s.select("column", "missing_rate", reason.alias("reason")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    reasons = F.array_compact(F.array(F.when(F.col("missing_rate") >= 0.95, F.lit("mostly_empty")), F.col("reason")))
    return both.select("column", F.explode(reasons).alias("reason"), "missing_rate")


def top_correlations(df: DataFrame, columns: list[str], k: int | None = 8, max_columns: int | None = None) -> DataFrame:
    """The pairs with the largest |r|, all from one pass."""
    names = columns[:max_columns]
    pairs = list(combinations(names, 2))
    rs = correlations(df, [(number(df, a), number(df, b)) for a, b in pairs])
    wide = df.agg(*[r.alias(f"r{i}") for i, r in enumerate(rs)])
    rows = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("corr")) for i, (a, b) in enumerate(pairs)
    ])
    return at_most(wide.select(F.inline(rows)).filter("corr is not null").orderBy(F.abs("corr").desc(), "a", "b"), k)


def quality_flags(missing: DataFrame, duplicates: DataFrame, times: DataFrame, encoding: DataFrame) -> DataFrame:
    """Flags from D2, D10, D7 and D11, gravest kind first."""
    def flag(df: DataFrame, rank: int, code: str, column, value) -> DataFrame:
        return df.select(F.lit(rank).alias("rank"), F.lit(code).alias("code"), column.alias("column"), value.alias("value"))

    gaps = missing.filter("missing_rate >= 0.10")
    rows = duplicates.filter("keys = '*' and dup_rate >= 0.10")
    weak = times.filter("parse_rate < 0.9 and name_hint")
    mixed = encoding.filter("fragmented")
    none = F.lit(None).cast("double")
    out = (
        flag(gaps, 1, "missingness", F.col("column"), F.col("missing_rate"))
        .unionByName(flag(rows, 2, "duplicates", F.lit(None).cast("string"), F.col("dup_rate")))
        .unionByName(flag(weak, 3, "time_parse_risk", F.col("column"), F.col("parse_rate")))
        .unionByName(flag(mixed, 4, "encoding_fragmentation", F.col("column"), none))
    )
    return out.orderBy("rank", F.col("value").desc_nulls_last(), "column")

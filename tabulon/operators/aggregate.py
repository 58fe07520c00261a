"""Group and time-bucket aggregation A1-A14, sorting and limits T1-T3."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulon.functions.distinct import exact_distinct
from tabulon.functions.numbers import at_most, is_time, number, one_row, sample_std, to_long
from tabulon.functions.quantiles import join_on_keys, quantiles
from tabulon.functions.text import strip

GRAINS = ("day", "week", "month", "quarter", "year")
AGGREGATES = ("count", "sum", "mean", "median", "min", "max")


@dataclass(frozen=True)
class Metric:
    name: str
    column: str | None
    agg: str


@dataclass(frozen=True)
class Plan:
    groups: list[str] = field(default_factory=list)
    metrics: list[Metric] = field(default_factory=list)
    time_column: str | None = None
    grain: str | None = None
    sort_by: str | None = None
    descending: bool = False
    limit: int | None = None


def as_time(df: DataFrame, name: str) -> Column:
    """A column as timestamp without zone; unreadable text is null."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return c.try_cast("timestamp_ntz")
    if is_time(df.schema[name]):
        return c.cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def bucket_start(c: Column, grain: str) -> Column:
    """A3: start of the day, week (Monday), month, quarter or year."""
    if grain not in GRAINS:
        raise ValueError(f"unknown grain: {grain}")
    return F.date_trunc(grain, c).cast("timestamp_ntz")


def with_bucket(df: DataFrame, time_column: str, grain: str, name: str = "time_bucket") -> DataFrame:
    return df.withColumn(name, bucket_start(as_time(df, time_column), grain))


def _keys(df: DataFrame, plan: Plan) -> tuple[DataFrame, list[str]]:
    groups = list(dict.fromkeys(g for g in plan.groups if g in df.columns))
    if plan.time_column in df.columns and plan.grain in GRAINS:
        groups = [g for g in groups if g not in (plan.time_column, "time_bucket")]
        return with_bucket(df, plan.time_column, plan.grain), ["time_bucket"] + groups
    return df, groups


def _aggregated(df: DataFrame, keys: list[str], metrics: list[Metric], count_rows: bool) -> DataFrame:
    """All metrics but medians in one pass; medians by selection, joined back on the keys."""
    usable = [
        m for m in metrics
        if m.agg in AGGREGATES and ((m.agg == "count" and count_rows) or m.column in df.columns)
    ]
    medians = [m for m in usable if m.agg == "median"]
    aggs = []
    for m in usable:
        if m.agg == "count":
            aggs.append(F.count(F.lit(1) if count_rows else F.col(f"`{m.column}`")).alias(m.name))
            continue
        x = number(df, m.column)
        if m.agg == "sum":
            aggs.append(F.coalesce(F.sum(x), F.lit(0.0)).alias(m.name))
        elif m.agg == "mean":
            aggs.append(F.avg(x).alias(m.name))
        elif m.agg in ("min", "max"):
            aggs.append((F.min(x) if m.agg == "min" else F.max(x)).alias(m.name))
    if not usable:
        return df
    grouped = df.groupBy(*keys)
    out = grouped.agg(*aggs) if aggs else df.select(*keys).distinct()
    if medians:
        middle = quantiles(df, sorted({m.column for m in medians}), [0.5], keys)
        middle = middle.select(*keys, *[F.col(m.column)[0].alias(m.name) for m in medians])
        out = join_on_keys(out, middle, keys, "left")
    return out.select(*keys, *[m.name for m in usable])


def aggregate(df: DataFrame, plan: Plan, add_support: bool = True) -> DataFrame:
    """Group by optional time bucket and groups, null keys kept, then sort and limit.

    ``count`` is the row count; ``n_records`` is added when no count was asked for.
    """
    base, keys = _keys(df, plan)
    metrics = list(plan.metrics)
    if add_support and not any(m.agg == "count" for m in metrics):
        metrics.append(Metric("n_records", None, "count"))
    if not keys:
        return df
    out = _aggregated(base, keys, metrics, count_rows=True)
    return sort_and_limit(out, plan.sort_by, plan.descending, plan.limit)


def aggregate_plain(df: DataFrame, groups: list[str], metrics: list[tuple], time_column: str | None = None, grain: str = "week") -> DataFrame:
    """A2: second dialect. ``metrics`` are (column, agg) or (column, agg, name); count skips nulls."""
    named = [Metric(m[2] if len(m) > 2 else f"{m[1]}_{m[0]}", m[0], m[1]) for m in metrics]
    keys = [g for g in groups if g in df.columns]
    if time_column in df.columns:
        bucket = f"{time_column}_{grain}"
        df = with_bucket(df, time_column, grain, bucket)
        keys = [bucket] + [g for g in keys if g != bucket]
    if not keys or not named:
        return df
    return _aggregated(df, keys, named, count_rows=False)


def sort_and_limit(df: DataFrame, sort_by: str | None = None, descending: bool = False, limit: int | None = None) -> DataFrame:
    """Nulls last either way; remaining columns break ties before a limit."""
    if sort_by not in df.columns:
        sort_by, descending = ("time_bucket", False) if "time_bucket" in df.columns else (None, False)
    if sort_by is None and not limit:
        return df
    order = []
    if sort_by is not None:
        c = F.col(f"`{sort_by}`")
        order.append(c.desc_nulls_last() if descending else c.asc_nulls_last())
    if limit:
        order += [F.col(f"`{c}`").asc_nulls_last() for c in df.columns if c != sort_by]
    df = df.orderBy(*order)
    return df.limit(limit) if limit else df


def support_counts(df: DataFrame, groups: list[str], time_column: str | None = None, grain: str | None = None) -> DataFrame:
    """A5: rows per bucket and group."""
    base, keys = _keys(df, Plan(groups=groups, time_column=time_column, grain=grain))
    if not keys:
        raise ValueError("support needs a time column or a group")
    return base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_records"))


def support_totals(counts: DataFrame) -> DataFrame:
    """A5: number of groups and of records."""
    return counts.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n_records").alias("total_records"))


def support_quality(counts: DataFrame, n: str = "n_records") -> DataFrame:
    """How many points, how small, how many below 5 and 10.

    Distinct counts are few, so the quantiles are taken over (count, frequency) pairs.
    """
    freq = counts.filter(F.col(n).isNotNull()).groupBy(F.col(n).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("f"))
    return freq.agg(
        F.sum("f").alias("n_points"),
        F.min("v").cast("bigint").alias("min_n"),
        F.percentile("v", F.lit(0.1), F.col("f")).alias("p10_n"),
        F.percentile("v", F.lit(0.5), F.col("f")).alias("median_n"),
        F.coalesce(F.sum(F.when(F.col("v") < 5, F.col("f"))), F.lit(0)).alias("low_n_lt5"),
        F.coalesce(F.sum(F.when(F.col("v") < 10, F.col("f"))), F.lit(0)).alias("low_n_lt10"),
    )


def support_extremes(counts: DataFrame, k: int = 3, n: str = "n_records") -> DataFrame:
    """The k buckets with least and with most support."""
    keys = [F.col(f"`{c}`").asc_nulls_last() for c in counts.columns if c != n]
    valid = counts.filter(F.col(n).isNotNull())
    low = valid.orderBy(F.col(n).asc(), *keys).limit(k).withColumn("side", F.lit("lowest"))
    high = valid.orderBy(F.col(n).desc(), *keys).limit(k).withColumn("side", F.lit("highest"))
    return low.unionByName(high)


def number_stats(df: DataFrame, columns: list[str], probs: list[float], keys: list[str] | None = None) -> DataFrame:
    """One wide pass of moments and quantiles by selection, per key: ``<col>__n, __mean, ..., __q``."""
    keys = keys or []
    aggs = []
    for c in columns:
        x = number(df, c)
        aggs += [
            F.count(x).alias(f"{c}__n"), F.avg(x).alias(f"{c}__mean"), sample_std(x).alias(f"{c}__std"),
            F.stddev_pop(x).alias(f"{c}__std_pop"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"),
        ]
    aggs.append(F.count(F.lit(1)).alias("n_total"))
    if not probs:
        return df.groupBy(*keys).agg(*aggs)
    named = {c: f"{c}__q" for c in columns}
    moments = df.groupBy(*keys).agg(*aggs)
    q = quantiles(df, columns, probs, keys).withColumnsRenamed(named)
    if keys:
        return join_on_keys(moments, q, keys, "left")
    one = one_row(q)
    return moments.select("*", *[one[n].alias(n) for n in named.values()])


def global_stats(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """One row per column with moments and the named quantiles (p05, p50, ...)."""
    wide = number_stats(df, columns, probs)
    parts = {
        c: F.struct(
            *[F.col(f"{c}__{s}").alias(s) for s in ("n", "mean", "std", "std_pop", "min", "max")],
            *[F.col(f"{c}__q")[i].alias(f"p{round(p * 100):02d}") for i, p in enumerate(probs)],
        )
        for c in columns
    }
    return to_long(wide, [], parts, "column", "s").select("column", "s.*")


def distinct_counts(df: DataFrame, columns: list[str], approximate: float | None = None) -> DataFrame:
    """One row per column, nulls not counted; optionally the sketch with that relative error.

    All columns are counted from one pass over fingerprints of their values.
    """
    if approximate is None:
        return exact_distinct(df, {c: F.col(f"`{c}`") for c in columns}).select("column", "n_distinct")
    aggs = [F.approx_count_distinct(F.col(f"`{c}`"), approximate).alias(c) for c in columns]
    return to_long(df.agg(*aggs), [], {c: F.col(f"`{c}`") for c in columns}, "column", "n_distinct")


def value_counts(df: DataFrame, column: str, top: int | None = None, with_null: bool = True, other: str = "(other)") -> DataFrame:
    """A10: value, count and share; beyond ``top`` levels the rest is one line.

    Only the ``top`` kept levels are joined back, by rank and not by a name that could collide.
    """
    c = F.col(f"`{column}`")
    v = strip(c) if isinstance(df.schema[column].dataType, T.StringType) else c.cast("string")
    counts = df.groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if not with_null:
        counts = counts.filter(F.col("value").isNotNull())
    if top is not None:
        kept = counts.orderBy(F.col("n").desc(), F.col("value").asc_nulls_last()).limit(top)
        total = one_row(counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("levels")))
        rest = kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shown")).select(
            F.lit(other).alias("value"), (total["n"] - F.col("shown")).alias("n"), total["levels"].alias("levels"),
        ).filter(F.col("levels") > top).drop("levels")
        counts = kept.unionByName(rest)
    whole = one_row(counts.agg(F.sum("n").alias("n")))
    return counts.select("value", "n", (F.col("n") / whole["n"]).alias("share"))


def weighted_mean(df: DataFrame, value: str, weight: str, keys: list[str] | None = None) -> DataFrame:
    """sum(w*y)/sum(w), null where the weights add up to nothing; missing weights count zero."""
    y = number(df, value)
    w = F.coalesce(number(df, weight), F.lit(0.0))
    return df.filter(y.isNotNull()).groupBy(*(keys or [])).agg(
        F.try_divide(F.sum(w * y), F.sum(w)).alias("weighted_mean"), F.sum(w).alias("support")
    )


def rate_table(df: DataFrame, keys: list[str], value: Column, name: str = "rate") -> DataFrame:
    """Mean and size per group."""
    return df.groupBy(*keys).agg(F.avg(value.cast("double")).alias(name), F.count(F.lit(1)).alias("n"))


def first_last(df: DataFrame, time: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """Value at the first and last time and their difference; equal times fall back on the value."""
    y = number(df, value)
    order = F.struct(F.col(f"`{time}`"), y)
    valid = df.filter(F.col(f"`{time}`").isNotNull() & y.isNotNull())
    return valid.groupBy(*(keys or [])).agg(
        F.min_by(y, order).alias("start"), F.max_by(y, order).alias("end"),
        (F.max_by(y, order) - F.min_by(y, order)).alias("delta"),
    )


def top_groups_by_mean(df: DataFrame, group: str, value: str, k: int | None = 20) -> DataFrame:
    """Groups (null included) with the highest mean, label as second sort key."""
    c = F.col(f"`{group}`")
    label = strip(c) if isinstance(df.schema[group].dataType, T.StringType) else c.cast("string")
    means = df.groupBy(label.alias("value")).agg(F.avg(number(df, value)).alias("mean"), F.count(F.lit(1)).alias("n"))
    return at_most(means.orderBy(F.col("mean").desc_nulls_last(), F.col("value").asc_nulls_last()), k)

"""Time-series features and trend tables W1-W10.

A series is a frame with key columns (possibly none), one row per time bucket. Windows partition by
the key, so a partition is as long as the calendar at the chosen grain, not as long as the raw table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulon.functions.numbers import number, one_row
from tabulon.functions.quantiles import join_on_keys, quantiles
from tabulon.functions.running import running
from tabulon.functions.text import strip
from tabulon.operators.aggregate import as_time, bucket_start
from tabulon.operators.clean import text_columns

LAGS = (1, 2, 3, 4, 6, 8, 12)
WINDOWS = (3, 6, 12)


def build_series(df: DataFrame, keys: list[str], time: str, value: str, grain: str, how: str = "sum") -> DataFrame:
    """One row per key and bucket, also when the raw times repeat."""
    x = number(df, value)
    agg = {"sum": F.coalesce(F.sum(x), F.lit(0.0)), "mean": F.avg(x), "count": F.count(x).cast("double")}[how]
    return (
        df.groupBy(*keys, bucket_start(as_time(df, time), grain).alias("t"))
        .agg(agg.alias("y"), F.count(F.lit(1)).alias("n_records"))
        .filter("t is not null")
    )


def _order(keys: list[str], time: str) -> Window:
    return Window.partitionBy(*keys).orderBy(time)


def lag_features(series: DataFrame, keys: list[str], time: str = "t", value: str = "y", lags=LAGS) -> DataFrame:
    """Earlier values by row position."""
    w = _order(keys, time)
    return series.withColumns({f"lag_{n}": F.lag(value, n).over(w) for n in lags})


def rolling_features(series: DataFrame, keys: list[str], time: str = "t", value: str = "y", windows=WINDOWS) -> DataFrame:
    """Mean and sample deviation over the previous rows; null until the window is full."""
    out = {}
    for n in windows:
        w = _order(keys, time).rowsBetween(-n, -1)
        full = F.count(value).over(w) == n
        out[f"roll_mean_{n}"] = F.when(full, F.avg(value).over(w))
        out[f"roll_std_{n}"] = F.when(full, F.stddev_samp(value).over(w))
    return series.withColumns(out)


def feature_names(lags=LAGS, windows=WINDOWS) -> list[str]:
    return [f"lag_{n}" for n in lags] + [f"roll_{s}_{n}" for n in windows for s in ("mean", "std")]


def supervised(series: DataFrame, keys: list[str], time: str = "t", value: str = "y") -> DataFrame:
    """Rows whose features and value are all set."""
    both = rolling_features(lag_features(series, keys, time, value), keys, time, value)
    return both.dropna(subset=feature_names() + [value])


def chronological_split(table: DataFrame, keys: list[str], time: str = "t", share: float = 0.8, floor: int = 10) -> DataFrame:
    """The first ``max(10, int(0.8 n))`` rows of each series are for training."""
    w = _order(keys, time)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    cut = F.greatest(F.lit(floor), F.floor(n * share).cast("int"))
    return table.withColumn("position", F.row_number().over(w)).withColumn("is_train", F.col("position") <= cut)


def cumulative_share(table: DataFrame, share: str, rank: str) -> DataFrame:
    """Running total of a ranked list of any length (Pareto line); sums per range of ranks, then offsets."""
    return running(table, [F.col(rank)], {f"cum_{share}": share})


def recent_slope(series: DataFrame, keys: list[str], time: str = "t", value: str = "y", window: int = 10) -> DataFrame:
    """Least-squares slope of the last points without far outliers, capped at 2.5 deviations."""
    last = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    part = Window.partitionBy(*keys)
    recent = (
        series.filter(F.col(value).isNotNull())
        .withColumn("rn", F.row_number().over(last)).filter(F.col("rn") <= window)
        .withColumn("w", F.count(F.lit(1)).over(part))
        .withColumn("x", (F.col("w") - F.col("rn")).cast("double"))
        .withColumn("med", F.median(value).over(part))
        .withColumn("mad", F.median(F.abs(F.col(value) - F.col("med"))).over(part))
        .withColumn("near", F.coalesce(F.abs(F.try_divide(0.6745 * (F.col(value) - F.col("med")), F.col("mad"))) <= 4.0, F.lit(True)))
        .withColumn("n_near", F.count_if("near").over(part))
        .filter(F.col("near") | (F.col("n_near") < 3))
    )
    fit = recent.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(F.col(value), F.col("x")).alias("raw"), F.stddev_pop(value).alias("sd"),
    )
    cap = 2.5 * F.col("sd")
    slope = F.when(F.col("sd") > 0, F.greatest(-cap, F.least(cap, F.col("raw")))).otherwise(F.col("raw"))
    return fit.select(*keys, F.when(F.col("n") < 3, F.lit(0.0)).otherwise(F.coalesce(slope, F.lit(0.0))).alias("slope"))


def _step(start: Column, grain: str, n: Column) -> Column:
    if grain in ("month", "quarter", "year"):
        months = {"month": 1, "quarter": 3, "year": 12}[grain]
        return F.timestamp_add("MONTH", n * months, start).cast("timestamp_ntz")
    return F.timestamp_add("DAY", n * (7 if grain == "week" else 1), start).cast("timestamp_ntz")


def future_calendar(series: DataFrame, keys: list[str], grain: str, horizon: int, time: str = "t") -> DataFrame:
    """The next period starts after the last point of each series."""
    last = series.groupBy(*keys).agg(F.max(time).alias("last_t"))
    steps = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.withColumn("t", _step(bucket_start(F.col("last_t"), grain), grain, F.col("step")))


def scaled_support(table: DataFrame, n: str = "n_records", low: float = 25.0, high: float = 180.0, keys: list[str] | None = None) -> DataFrame:
    """Counts mapped to a range by min and max (per series if keys are given); constant to the middle."""
    x = F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    if keys:
        w = Window.partitionBy(*keys)
        lo, hi = F.min(x).over(w), F.max(x).over(w)
    else:
        ends = one_row(table.agg(F.min(x).alias("lo"), F.max(x).alias("hi")))
        lo, hi = ends["lo"], ends["hi"]
    size = F.when(hi <= lo, F.lit(0.5 * (low + high))).otherwise(low + F.try_divide((x - lo) * (high - low), hi - lo))
    return table.withColumn("scaled", size)


def trend_table(df: DataFrame, time: str, value: str, group: str | None = None) -> DataFrame:
    """Rows with a valid time, in time order, the group label trimmed."""
    cols = [as_time(df, time).alias(time), F.col(f"`{value}`")]
    order = [time]
    if group and group in df.columns:
        cols.append((strip(group) if group in text_columns(df) else F.col(f"`{group}`")).alias(group))
        order.append(group)
    if "n_records" in df.columns:
        cols.append(F.col("n_records"))
    return df.select(*cols).filter(F.col(time).isNotNull()).orderBy(*order)


def trend_stats(df: DataFrame, time: str, value: str, groups: list[str] | None = None) -> DataFrame:
    """Points, mean, extremes, start, end, change, median, p05, p95; overall and per group.

    One pass makes a mergeable summary per group; the overall row is the sum of these summaries.
    """
    base = df.select(*(groups or []), as_time(df, time).alias(time), number(df, value).alias("y")).filter(
        F.col(time).isNotNull() & F.col("y").isNotNull()
    )

    keys, by_time = list(groups or []), F.struct(F.col(time), F.col("y"))
    parts = base.groupBy(*keys).agg(
        F.count("y").alias("n"), F.sum("y").alias("s"), F.min("y").alias("lo"), F.max("y").alias("hi"),
        F.min(by_time).alias("first"), F.max(by_time).alias("last"),
    )
    whole = parts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.min("first").alias("first"), F.max("last").alias("last"),
    )

    def table(summary: DataFrame, scope: str, label: Column) -> DataFrame:
        start, end = F.col("first.y"), F.col("last.y")
        return summary.select(
            F.lit(scope).alias("scope"), label.alias("series"), F.col("n").alias("n_points"), F.try_divide("s", F.col("n").cast("double")).alias("mean"),
            F.col("lo").alias("min"), F.col("hi").alias("max"), start.alias("start"), end.alias("end"), (end - start).alias("delta"),
            F.col(f"first.{time}").alias("x_start"), F.col(f"last.{time}").alias("x_end"),
            F.col("q")[0].alias("p05"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p95"),
        )

    probs = [0.05, 0.5, 0.95]
    q = one_row(quantiles(base, ["y"], probs).withColumnRenamed("y", "q"))["q"]
    out = table(whole.withColumn("q", q), "global", F.lit("(all)"))
    if not keys:
        return out
    named = F.concat_ws(" | ", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("(missing)")) for k in keys])
    each = join_on_keys(parts, quantiles(base, ["y"], probs, keys).withColumnRenamed("y", "q"), keys)
    return out.unionByName(table(each, "group", named))

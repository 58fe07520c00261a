"""Result checks V1-V6 and support joins J1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from tabulon.functions.numbers import known, number, one_row
from tabulon.functions.quantiles import quantiles
from tabulon.functions import roles
from tabulon.operators.aggregate import number_stats
from tabulon.operators.clean import duplicate_share

# Thresholds of the checks.
ROBUST_Z = 3.5
DUPLICATE_WARN = 0.15
MIN_SUPPORT = 5


def robust_outliers(df: DataFrame, column: str, z: float = ROBUST_Z) -> DataFrame:
    """V1: rows with |0.6745 (x - median) / MAD| above the limit; none when the MAD is zero."""
    x = number(df, column)
    m = known(quantiles(df, [column], [0.5]))[column][0]
    away = df.select(F.abs(x - m).alias("d"))
    mad = known(quantiles(away, ["d"], [0.5]))["d"][0]
    return df.withColumn("robust_z", F.try_divide(0.6745 * (x - m), mad)).filter(F.abs("robust_z") > z)


def time_duplicates(df: DataFrame, time: str) -> DataFrame:
    """V2: share of repeated time keys and whether it is too high."""
    return duplicate_share(df, [time]).select("n_rows", "dup_rate", (F.col("dup_rate") > DUPLICATE_WARN).alias("warn"))


def join_support(df: DataFrame, counts: DataFrame) -> DataFrame:
    """The support of each row's bucket, joined on time_bucket and all shared columns.

    The planner chooses the join by the size of ``counts``; null keys match.
    """
    shared = [c for c in df.columns if c in counts.columns and c not in ("n_records", "time_bucket")]
    keys = ["time_bucket"] if "time_bucket" in df.columns and "time_bucket" in counts.columns else []
    keys += shared
    if not keys:
        return df.withColumn("n_records", F.lit(None).cast("bigint"))
    right = counts.groupBy(*keys).agg(F.sum("n_records").alias("n_records"))
    named = right.select(*[F.col(f"`{k}`").alias(f"__r_{k}") for k in keys], "n_records")
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(named[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return df.join(named, cond, "left").drop(*[f"__r_{k}" for k in keys])


def low_support(df: DataFrame, counts: DataFrame | None = None, floor: int = MIN_SUPPORT) -> DataFrame:
    """V3: share of buckets below the floor, missing support counted as zero, with its source."""
    own = next((c for c in roles.SUPPORT_COLUMNS if c in df.columns), None)
    if own is not None:
        base, source, n = df, f"table:{own}", number(df, own)
    elif counts is not None:
        base = join_support(df, counts)
        source, n = "joined", number(base, "n_records")
    else:
        raise ValueError("no support column and no counts")
    return base.agg(
        F.count(F.lit(1)).alias("n_buckets"), F.avg((F.coalesce(n, F.lit(0.0)) < floor).cast("double")).alias("low_share")
    ).withColumn("source", F.lit(source))


def basic_stats(df: DataFrame, column: str) -> DataFrame:
    """V4: moments with population deviation and quantiles; p99 is the maximum below 20 values."""
    s = number_stats(df, [column], [0.05, 0.25, 0.5, 0.75, 0.95, 0.99])
    q = F.col(f"{column}__q")
    n = F.col(f"{column}__n")
    return s.select(
        F.lit(column).alias("column"), n.alias("n"), F.col(f"{column}__mean").alias("mean"), q[2].alias("median"),
        F.col(f"{column}__std_pop").alias("std"), F.col(f"{column}__min").alias("min"), q[0].alias("p05"), q[4].alias("p95"),
        F.when(n >= 20, q[5]).otherwise(F.col(f"{column}__max")).alias("p99"), F.col(f"{column}__max").alias("max"),
        q[1].alias("q1"), q[3].alias("q3"), (q[3] - q[1]).alias("iqr"),
    )


# Order of the severities.
SEVERITIES = ("ok", "warn", "block")


def findings(df: DataFrame, time: str, column: str, counts: DataFrame | None = None, diagnostic: bool = False) -> DataFrame:
    """V5: one row per check that fired, with its evidence as a number, and the overall status."""
    def row(part: DataFrame, code: str, value, fired) -> DataFrame:
        return part.filter(fired).select(F.lit(code).alias("code"), F.lit("warn").alias("severity"), value.cast("double").alias("value"))

    out = row(time_duplicates(df, time), "time_duplicates", F.col("dup_rate"), F.col("warn"))
    n_out = robust_outliers(df, column).agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(row(n_out, "series_outliers", F.col("n"), F.col("n") > 0))
    if counts is not None or any(c in df.columns for c in roles.SUPPORT_COLUMNS):
        low = low_support(df, counts)
        out = out.unionByName(row(low, "low_bucket_support", F.col("low_share"), F.col("low_share") > 0))
    if diagnostic and roles.looks_aggregated(df):
        flag = df.sparkSession.range(1).select(F.lit(1.0).alias("v"))
        out = out.unionByName(row(flag, "aggregated_input_for_diagnostic", F.col("v"), F.lit(True)))
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    worst = one_row(out.agg(F.coalesce(F.max(rank), F.lit(1)).cast("int").alias("r")))["r"]
    status = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), worst)
    none = df.sparkSession.range(1).select(
        F.lit("(status)").alias("code"), status.alias("severity"), F.lit(None).cast("double").alias("value")
    )
    return out.unionByName(none)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """V6: count rows while an action runs anyway; read ``observation.get`` after it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def step_delta(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """V6: rows and columns before and after a step, as a one-row table."""
    b = one_row(before.agg(F.count(F.lit(1)).alias("n")))["n"]
    return after.agg(F.count(F.lit(1)).alias("rows_after")).select(
        F.lit(name).alias("step"), b.alias("rows_before"), "rows_after",
        F.lit(len(before.columns)).alias("cols_before"), F.lit(len(after.columns)).alias("cols_after"),
    )

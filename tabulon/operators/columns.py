"""Column selection P1-P10. Rules on names and types run on the schema alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabulon.functions import roles
from tabulon.functions.distinct import distinct_up_to
from tabulon.functions.numbers import is_label, is_numeric


def select_existing(df: DataFrame, names: list[str], width: int | None = None) -> DataFrame:
    """The named columns that exist, else all or the first ``width``."""
    found = [n for n in names if n in df.columns]
    return df.select(*[f"`{n}`" for n in (found or df.columns[:width])])


def in_table_order(df: DataFrame, names: list[str]) -> DataFrame:
    """Existing names once each, in the order of the table."""
    wanted = set(names)
    found = [n for n in df.columns if n in wanted]
    return df.select(*[f"`{n}`" for n in found]) if found else df


def drop_uninformative(df: DataFrame, flags: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Without the columns that D12 flags (one row per column), unless named in ``keep``.

    Only column names come back to the driver, at most one per column of the table.
    """
    gone = {r["column"] for r in flags.select("column").distinct().collect()} - set(keep or [])
    left = [c for c in df.columns if c not in gone]
    return df.select(*[f"`{c}`" for c in left]) if left else df


def metric_first(df: DataFrame, names: list[str], metric: str | None) -> list[str]:
    """Non-numeric columns, then the metric, then the other numeric ones."""
    numeric = [c for c in names if c in df.columns and is_numeric(df.schema[c])]
    if metric not in names or metric not in numeric:
        return names
    others = [c for c in names if c not in numeric]
    return others + [metric] + [c for c in numeric if c != metric]


def ensure_metric(names: list[str], metric: str, width: int, ids: list[str] | None = None, times: list[str] | None = None) -> list[str]:
    """P5: the metric inside a capped list; an id-like column goes first, then a time-like, else the last."""
    if metric in names:
        return names
    if len(names) < width:
        return names + [metric]
    by_id = [i for i, c in enumerate(names) if (c in ids if ids is not None else roles.key_like(c))]
    by_time = [i for i, c in enumerate(names) if (c in times if times is not None else roles.time_like(c))]
    spot = (by_id or by_time or [len(names) - 1])[0]
    return names[:spot] + [metric] + names[spot + 1:]


def rank_numeric(stats: DataFrame, metric: str | None = None, scores: dict[str, float] | None = None) -> DataFrame:
    """Numeric columns by metric, score, missing rate, spread, name.

    ``stats`` has one row per column: column, missing_rate, std.
    """
    score = F.lit(0.0)
    for name, value in (scores or {}).items():
        score = F.when(F.col("column") == name, F.lit(float(value))).otherwise(score)
    return (
        stats.withColumn("is_metric", (F.col("column") == (metric or "")).cast("int"))
        .withColumn("score", score)
        .orderBy(
            F.col("is_metric").desc(), F.col("score").desc(), F.col("missing_rate").asc(),
            F.coalesce(F.col("std"), F.lit(0.0)).desc(), F.col("column").asc(),
        )
    )


def feature_columns(
    df: DataFrame, names: list[str], ids: list[str] | None = None, times: list[str] | None = None,
    need_time: bool = False, many_features: bool = False, mentioned: list[str] | None = None,
) -> list[str]:
    """Names without id-like columns and, unless needed, without time-like ones."""
    said = set(mentioned or [])
    out = []
    for c in names:
        if c not in df.columns:
            continue
        is_id = c in ids if ids is not None else roles.key_like(c)
        is_time = c in times if times is not None else roles.time_like(c)
        if is_id and c not in said:
            continue
        if not many_features and not need_time and is_time and c not in said:
            continue
        out.append(c)
    return out or [c for c in names if c in df.columns]


def summary_columns(df: DataFrame, ranked: list[str], metric: str | None, group: str | None) -> list[str]:
    """One metric (three if none is named) and at most one group."""
    kept = ranked[: 1 if metric and metric in ranked else 3]
    return kept + ([group] if group and group in df.columns and group not in kept else [])


def usable_numeric(df: DataFrame, ids: list[str] | None = None, limit: int | None = None) -> list[str]:
    """The (first ``limit``) numeric columns that are not id-like."""
    names = [f.name for f in df.schema if is_numeric(f)]
    return [c for c in names if not (c in ids if ids is not None else roles.id_like(c))][:limit]


def usable_labels(
    df: DataFrame, ids: list[str] | None = None, low: int = 2, high: int = 30, limit: int | None = None,
    exclude: list[str] | None = None,
) -> list[str]:
    """The (first ``limit``) text or boolean columns with ``low`` to ``high`` levels; only those with few are counted."""
    names = [
        f.name for f in df.schema
        if is_label(f) and not (f.name in ids if ids is not None else roles.id_like(f.name)) and f.name not in (exclude or [])
    ]
    levels = distinct_up_to(df, {c: F.col(f"`{c}`") for c in names}, high)
    return [c for c in names if c in levels and levels[c] >= low][:limit]


# Name parts that mark a dimension one can act on.
ACTIONABLE = ("resource", "group", "type", "status", "region", "product", "avg_type", "ta_")


def choose_dimension(df: DataFrame, target: str, ids: list[str] | None = None, named: str | None = None) -> str | None:
    """A label column with 2-50 levels; a named one first, then actionable names, then few levels."""
    names = [
        f.name for f in df.schema
        if is_label(f) and f.name != target and not (f.name in ids if ids is not None else roles.id_like(f.name))
    ]
    if named and named in df.columns and named not in names and named != target and is_label(df.schema[named]):
        names.append(named)
    row = distinct_up_to(df, {c: F.col(f"`{c}`") for c in names}, 50)
    fitting = [c for c in names if row.get(c, 0) >= 2]
    if named in fitting:
        return named
    worth = {c: 2 * any(part in c.lower() for part in ACTIONABLE) + (row[c] <= 20) for c in fitting}
    return min(fitting, key=lambda c: (-worth[c], fitting.index(c)), default=None)

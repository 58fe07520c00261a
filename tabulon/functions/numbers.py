"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulon.functions.text import col_of

FRACTIONAL = (T.DoubleType, T.FloatType)


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def is_time(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_label(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.BooleanType))


def number(df: DataFrame, name: str) -> Column:
    """A column as double, with NaN and unreadable text as null."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, FRACTIONAL):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if isinstance(kind, T.StringType):
        return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    return F.lit(None).cast("double")


def finite(c: Column | str) -> Column:
    """NaN and infinities to null."""
    x = col_of(c)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clip(c: Column, low: Column, high: Column) -> Column:
    """Between bounds; null stays null."""
    return F.when(c.isNotNull(), F.greatest(low, F.least(c, high)))


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """a/b, with a fixed answer where b is zero."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if otherwise is None else F.coalesce(out, F.lit(float(otherwise)))


def whole(c: Column | str) -> Column:
    """Near a whole number, with an absolute and a relative tolerance."""
    x = col_of(c)
    return F.abs(x - F.rint(x)) <= 1e-9 + 1e-5 * F.abs(F.rint(x))


def paired_corr(a: Column, b: Column) -> Column:
    """Aggregate: Pearson r over rows where both sides are set; null when a side is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, pairs: list[tuple[Column, Column]]) -> list[Column]:
    """Pearson r of many pairs of columns as aggregates over ``df``, pairwise complete, null if a side is constant.

    A first pass finds the means and which columns have gaps. The second pass then sums products of
    centred values: one sum per pair and one per column, and only for pairs with gaps the sums over
    their common rows. Plain sums are far cheaper than a covariance and two deviations per pair.
    """
    sides: dict[str, Column] = {}
    for pair in pairs:
        for c in pair:
            sides.setdefault(str(c), c)
    keys = list(sides)
    m = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.struct(F.avg(c).alias("mean"), F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"s{i}")
        for i, c in enumerate(sides.values())
    ]).first()
    stats = {k: m[f"s{i}"] for i, k in enumerate(keys)}
    centred = {k: sides[k] - F.lit(float(stats[k]["mean"] or 0.0)) for k in keys}
    out = []
    for a, b in pairs:
        sa, sb = stats[str(a)], stats[str(b)]
        x, y = centred[str(a)], centred[str(b)]
        if sa["lo"] == sa["hi"] or sb["lo"] == sb["hi"]:
            out.append(F.max(F.lit(None).cast("double")))
        elif sa["n"] == sb["n"] == m["n"]:
            out.append(F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))))
        elif str(a) == str(b):
            out.append(F.max(F.lit(1.0)))
        else:
            both = a.isNotNull() & b.isNotNull()
            x, y = F.when(both, x), F.when(both, y)
            n, sx, sy = F.count(x * y), F.sum(x), F.sum(y)
            n = F.when(n > 0, n)
            vx = F.greatest(F.sum(x * x) - sx * sx / n, F.lit(0.0))
            vy = F.greatest(F.sum(y * y) - sy * sy / n, F.lit(0.0))
            flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
            out.append(F.when(~flat, F.try_divide(F.sum(x * y) - sx * sy / n, F.sqrt(vx) * F.sqrt(vy))))
    return out


def sample_std(c: Column) -> Column:
    """Aggregate: standard deviation with n-1, zero for a single value."""
    return F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c))


def one_row(stats: DataFrame) -> Column:
    """A one-row frame as a struct column, evaluated once as a scalar subquery."""
    return stats.select(F.struct(*[F.col(f"`{c}`") for c in stats.columns])).scalar()


def known(stats: DataFrame) -> dict[str, Column]:
    """A one-row frame as literals, for statistics that later expressions use many times.

    One row of numbers reaches the driver; the plans that use it stay flat and can push it down.
    """
    row = stats.first()
    return {f.name: F.lit(row[f.name]).cast(f.dataType) for f in stats.schema}


def at_most(df: DataFrame, k: int | None) -> DataFrame:
    """The first ``k`` rows of an ordered frame, or all."""
    return df if k is None else df.limit(k)


def to_long(df: DataFrame, keys: list[str], columns: dict[str, Column], name: str, value: str) -> DataFrame:
    """Several expressions of one row as (name, value) rows; cheap on one-row statistics."""
    pairs = F.array(*[F.struct(F.lit(k).alias(name), v.alias(value)) for k, v in columns.items()])
    return df.select(*keys, F.inline(pairs))

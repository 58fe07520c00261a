"""Cleaning C1-C12. Guards that need a count use one aggregate pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulon.functions import roles
from tabulon.functions.distinct import counts_by_value, fingerprint
from tabulon.functions.numbers import clip, is_label, is_numeric, number, one_row, ratio, to_long
from tabulon.functions.quantiles import quantiles
from tabulon.functions.text import MISSING_TOKENS, normal, strip
from tabulon.operators.aggregate import as_time

MAX_DROP = 0.10


def text_columns(df: DataFrame, names: list[str] | None = None) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and (names is None or f.name in names)]


def present(df: DataFrame, names: list[str] | None) -> list[str]:
    return [c for c in dict.fromkeys(names or []) if c in df.columns]


def normalize_missing(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Disguised missing tokens to null; other text stays as it is."""
    found = text_columns(df, names)
    return df.withColumns({c: F.when(~normal(c).isin(*MISSING_TOKENS), F.col(f"`{c}`")) for c in found}) if found else df


def strip_text(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """C2."""
    found = text_columns(df, names)
    return df.withColumns({c: strip(c) for c in found}) if found else df


def coerce_numeric(df: DataFrame, names: list[str]) -> DataFrame:
    """Unreadable text to null; numeric columns keep their type."""
    found = [c for c in present(df, names) if not is_numeric(df.schema[c])]
    changed = {c: number(df.withColumn(c, strip(c)) if c in text_columns(df) else df, c) for c in found}
    return df.withColumns({c: strip(c) for c in found if c in text_columns(df)}).withColumns(changed) if found else df


# Date patterns tried after ISO-8601, in this order.
DATE_PATTERNS = ("yyyy/MM/dd", "M/d/yyyy", "d.M.yyyy", "d.M.yyyy HH:mm", "d.M.yyyy HH:mm:ss", "yyyyMMdd")


def read_time(c: Column, patterns: tuple[str, ...] = DATE_PATTERNS) -> Column:
    """ISO-8601 first, then the listed patterns; null when none fits.

    A text without a digit is not tried at all.
    """
    text = strip(c)
    text = F.when(text.rlike("[0-9]"), text)
    tries = [text.try_cast("timestamp_ntz")]
    tries += [F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz") for p in patterns]
    return F.coalesce(*tries)


def parse_times(df: DataFrame, names: list[str], patterns: tuple[str, ...] = DATE_PATTERNS) -> DataFrame:
    """C4."""
    found = present(df, names)
    changed = {c: read_time(F.col(f"`{c}`"), patterns) if c in text_columns(df) else as_time(df, c) for c in found}
    return df.withColumns(changed) if found else df


def impute_median(df: DataFrame, names: list[str], accuracy: int | None = None) -> DataFrame:
    """All medians from one pass; a column without gaps is not changed by it."""
    found = [c for c in present(df, names)]
    if not found:
        return df
    middle = one_row(quantiles(df.select(*[f"`{c}`" for c in found]), found, [0.5], accuracy=accuracy))
    return df.withColumns({c: F.coalesce(number(df, c), middle[c][0]) for c in found})


def column_modes(df: DataFrame, names: list[str]) -> DataFrame:
    """One row per column: its most frequent value, the smaller one on a tie.

    The counts are summed before the shuffle; the winner is a max over (count, value), no window.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in names])
    counts = df.select(F.inline(pairs)).filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(
        F.max("n").alias("n"),
        F.min_by("value", F.struct((-F.col("n")).alias("n"), F.col("value"))).alias("mode"),
    )


def impute_mode(df: DataFrame, names: list[str]) -> DataFrame:
    """C6."""
    found = present(df, names)
    if not found:
        return df
    modes = column_modes(df, found)
    wide = one_row(modes.agg(*[F.max(F.when(F.col("column") == c, F.col("mode"))).alias(c) for c in found]))
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), wide[c].cast(df.schema[c].dataType)) for c in found})


def drop_incomplete(df: DataFrame, names: list[str], max_drop: float = MAX_DROP) -> DataFrame:
    """Rows without a required value go, unless they are more than ``max_drop`` of all."""
    found = present(df, names)
    if not found:
        return df
    gap = F.lit(False)
    for c in found:
        gap = gap | F.col(f"`{c}`").isNull()
    share = one_row(df.agg(F.avg(gap.cast("double")).alias("share")))
    return df.filter(~gap | (share["share"] > max_drop))


def first_per_key(df: DataFrame, subset: list[str], order_by: list[str] | None = None) -> DataFrame:
    """One row per key, the smallest by ``order_by`` and then by all columns.

    A minimum over structs is combined before the shuffle, so a hot key costs one row per task.
    """
    order = [c for c in (order_by or []) if c in df.columns and c not in subset]
    rest = [c for c in df.columns if c not in order and c not in subset]
    if not order and not rest:
        return df.distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in order + rest])
    picked = df.groupBy(*[f"`{c}`" for c in subset]).agg(F.min(row).alias("__row"))
    return picked.select(*[F.col(f"`{c}`") if c in subset else F.col("__row")[c].alias(c) for c in df.columns])


def drop_duplicates(
    df: DataFrame, subset: list[str] | None = None, order_by: list[str] | None = None, force: bool = False,
    max_drop: float = MAX_DROP,
) -> DataFrame:
    """Keep the first row per key; refused when too many rows would go and nobody forces it."""
    if len(df.columns) == 1 and not force and not is_label(df.schema[0]):
        return df
    keys = present(df, subset) or [c for c in df.columns if roles.has_word(c, roles.DEDUP_KEY_WORDS)]
    if not keys:
        if not (force and len(df.columns) >= 2):
            return df
        keys = df.columns
    if not force:
        share = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
            F.sum("n").alias("rows"), F.count(F.lit(1)).alias("kept")
        ).first()
        if share["rows"] and (share["rows"] - share["kept"]) / share["rows"] > max_drop:
            return df
    return first_per_key(df, keys, order_by)


def clip_outliers(df: DataFrame, name: str, k: float = 1.5, accuracy: int | None = None) -> DataFrame:
    """Values outside the IQR fences moved onto them; nothing happens when the IQR is zero."""
    if name not in df.columns:
        return df
    x = number(df, name)
    q = one_row(quantiles(df.select(f"`{name}`"), [name], [0.25, 0.75], accuracy=accuracy))[name]
    spread = q[1] - q[0]
    return df.withColumn(
        name, F.when(spread > 0, clip(x, q[0] - k * spread, q[1] + k * spread)).otherwise(x)
    )


def key_candidates(df: DataFrame) -> list[str]:
    """Columns named like a key."""
    return [c for c in df.columns if roles.has_word(c, roles.DEDUP_KEY_WORDS)]


def duplicate_share(df: DataFrame, keys: list[str]) -> DataFrame:
    """Share of rows that repeat an earlier row on the keys; null is a value.

    Rows are counted by the fingerprint of their keys, so a long text costs 16 bytes; counts are summed before the
    shuffle, so a hot key does not weigh on one task.
    """
    first, second = fingerprint([F.col(f"`{k}`") for k in keys])
    counts = df.groupBy(first.alias("__h1"), second.alias("__h2")).agg(F.count(F.lit(1)).alias("__n"), F.lit(1).alias("__g"))
    return counts.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"),
        (F.coalesce(F.sum("__n"), F.lit(0)) - F.coalesce(F.sum("__g"), F.lit(0))).alias("n_duplicates"),
    ).withColumn("dup_rate", ratio(F.col("n_duplicates"), F.col("n_rows"), 0.0))


def outlier_rates(df: DataFrame, columns: list[str], k: float = 1.5, min_n: int = 20, accuracy: int | None = None) -> DataFrame:
    """Share outside the IQR fences per column; null with fewer than 20 values or no spread."""
    base = df.select(*[number(df, c).alias(c) for c in columns])
    q = one_row(quantiles(df.select(*[f"`{c}`" for c in columns]), columns, [0.25, 0.75], accuracy=accuracy))
    aggs = []
    for c in columns:
        lo = q[c][0] - k * (q[c][1] - q[c][0])
        hi = q[c][1] + k * (q[c][1] - q[c][0])
        x = F.col(f"`{c}`")
        aggs.append(F.struct(
            F.count(x).alias("n"), F.count_if((x < lo) | (x > hi)).alias("out"),
            F.max(q[c][1] - q[c][0]).alias("iqr"),
        ).alias(c))
    wide = base.agg(*aggs)
    return to_long(wide, [], {c: F.col(f"`{c}`") for c in columns}, "column", "s").select(
        "column",
        F.when((F.col("s.n") >= min_n) & (F.col("s.iqr") != 0), ratio(F.col("s.out"), F.col("s.n"))).alias("outlier_rate"),
    )


def level_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every value (null included) of several columns, one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def level_facts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``level_summary`` of several columns, from fingerprints of their values."""
    return level_summary(counts_by_value(df, {c: F.col(f"`{c}`") for c in columns}))


def level_summary(counts: DataFrame) -> DataFrame:
    """Per column: distinct values, rows with a value, missing rows, share of the top value."""
    valid = F.when(F.col("value").isNotNull(), F.col("n"))
    return counts.groupBy("column").agg(
        F.count("value").alias("n_distinct"),
        F.coalesce(F.sum(valid), F.lit(0)).alias("n_valid"),
        F.sum("n").alias("n_rows"),
        F.coalesce(F.max(valid), F.lit(0)).alias("n_top"),
    ).withColumns({
        "top_share": ratio(F.col("n_top"), F.col("n_valid"), 0.0),
        "missing_rate": ratio(F.col("n_rows") - F.col("n_valid"), F.col("n_rows"), 0.0),
        "unique_rate": ratio(F.col("n_distinct"), F.col("n_rows"), 0.0),
    })


def quality_report(df: DataFrame, keys: list[str] | None = None, max_columns: int | None = None) -> DataFrame:
    """C11: (scope, column, measure, value) rows: missing, unique, duplicates, outliers, cardinality."""
    counts = level_facts(df, df.columns)
    base = {"missing_rate": F.col("missing_rate"), "n_unique": F.col("n_distinct").cast("double"), "unique_rate": F.col("unique_rate")}
    out = to_long(counts.withColumn("scope", F.lit("column")), ["scope", "column"], base, "measure", "value")
    labels = text_columns(df)[:max_columns]
    if labels:
        cat = {"cardinality": F.col("n_distinct").cast("double"), "top_share": F.col("top_share")}
        texts = counts.filter(F.col("column").isin(*labels)).withColumn("scope", F.lit("text"))
        out = out.unionByName(to_long(texts, ["scope", "column"], cat, "measure", "value"))
    numeric = roles.numeric_columns(df)[:max_columns]
    if numeric:
        rates = outlier_rates(df, numeric).filter("outlier_rate is not null")
        out = out.unionByName(rates.select(
            F.lit("numeric").alias("scope"), "column", F.lit("outlier_rate_iqr").alias("measure"), F.col("outlier_rate").alias("value")
        ))
    found = present(df, keys) if keys is not None else key_candidates(df)
    dup = duplicate_share(df, df.columns).select("*", F.lit("table").alias("scope"), F.lit("*").alias("column"))
    repeats = {"duplicate_rows": F.col("n_duplicates").cast("double"), "duplicate_rate_all": F.col("dup_rate")}
    out = out.unionByName(to_long(dup, ["scope", "column"], repeats, "measure", "value"))
    if found:
        out = out.unionByName(duplicate_share(df, found).select(
            F.lit("table").alias("scope"), F.lit(",".join(found)).alias("column"),
            F.lit("duplicate_rate_on_keys").alias("measure"), F.col("dup_rate").alias("value"),
        ))
    return out


def worst(report: DataFrame, measure: str, n: int = 10) -> DataFrame:
    """The columns with the highest value of one measure."""
    return report.filter(F.col("measure") == measure).orderBy(F.col("value").desc_nulls_last(), F.col("column")).limit(n)


ACTIONS = {
    "normalize_missing_tokens": lambda df, p: normalize_missing(df, p.get("columns")),
    "strip_strings": lambda df, p: strip_text(df, p.get("columns")),
    "coerce_numeric": lambda df, p: coerce_numeric(df, p.get("columns") or []),
    "parse_datetimes": lambda df, p: parse_times(df, p.get("columns") or []),
    "impute_numeric_median": lambda df, p: impute_median(df, p.get("columns") or []),
    "impute_categorical_mode": lambda df, p: impute_mode(df, p.get("columns") or []),
    "drop_rows_missing_required": lambda df, p: drop_incomplete(df, p.get("columns") or []),
    "drop_duplicates": lambda df, p: drop_duplicates(df, p.get("subset"), p.get("order_by"), p.get("force", False)),
    "clip_outliers_iqr": lambda df, p: clip_outliers(df, p["column"], float(p.get("k", 1.5))),
}


def prepare(df: DataFrame, actions: list[dict]) -> DataFrame:
    """Missing tokens first, then the named actions in order; unknown names are skipped."""
    df = normalize_missing(df)
    for action in actions:
        step = ACTIONS.get(action.get("name", ""))
        if step is not None:
            df = step(df, action.get("params") or {})
    return df

"""Diagnostic analyses N14-N23, T5."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tabulon.functions import roles
from tabulon.functions.numbers import at_most, correlations, known, number, one_row, to_long
from tabulon.functions.quantiles import quantiles
from tabulon.functions.text import driver_label, fixed, signed_percent_points, strip
from tabulon.operators.clean import text_columns
from tabulon.operators.columns import usable_labels
from tabulon.operators.descriptive import binned
from tabulon.session import cut_lineage

SHRINK = 20.0


def _label(df: DataFrame, name: str):
    c = F.col(f"`{name}`")
    return strip(c) if name in text_columns(df) else c.cast("string")


def _dimensions(df: DataFrame, y: str, dims: list[str] | None, ids: list[str] | None) -> list[str]:
    """The named columns, whatever their levels; without names the label columns with 2-30 levels."""
    names = [d for d in dict.fromkeys(dims) if d in df.columns and d != y] if dims else usable_labels(df, ids=ids, exclude=[y])
    if not names:
        raise ValueError("no column to group by")
    return names


def by_dimension(df: DataFrame, dims: list[str], measures: dict, kept: dict | None = None) -> DataFrame:
    """One pass over the table for all dimensions: (feature, value) groups with the given aggregates.

    Rows are multiplied in memory only; partial aggregation leaves one row per group and task to shuffle. ``kept`` are
    the row expressions the aggregates need. The groups are checkpointed, so totals over all rows come from them: every
    row is in one group of each dimension.
    """
    pairs = F.array(*[F.struct(F.lit(d).alias("feature"), _label(df, d).alias("value")) for d in dims])
    rows = df.select(*[c.alias(n) for n, c in (kept or {}).items()], F.inline(pairs))
    return cut_lineage(rows.groupBy("feature", "value").agg(*[a.alias(n) for n, a in measures.items()]))


def totals(groups: DataFrame, dims: list[str], sums: dict) -> dict:
    """Aggregates over all rows, from the groups of one dimension."""
    return known(groups.filter(F.col("feature") == dims[0]).agg(*[a.alias(n) for n, a in sums.items()]))


def shrunk(mean, n, overall, k: float = SHRINK):
    """Group mean pulled to the overall mean: (n*mean + k*overall) / (n + k)."""
    return F.when(n + k > 0, (n * mean + k * overall) / (n + k)).otherwise(mean)


def variance_decomposition(df: DataFrame, y: str, dims: list[str] | None = None, ids: list[str] | None = None, k: float = SHRINK) -> DataFrame:
    """N, mean, shrunk mean and contribution n*(shrunk-overall)^2 per dimension value.

    J2: with a support column its sum replaces the row count, from the same pass.
    """
    yv = number(df, y)
    base = df.filter(yv.isNotNull())
    names = _dimensions(base, y, dims, ids)
    support = roles.support_column(df)
    kept = {"y": yv} | ({"w": number(df, support)} if support and support != y else {})
    measures = {"rows": F.count("y"), "sum_y": F.sum("y")}
    if "w" in kept:
        measures["support"] = F.sum("w")
    groups = by_dimension(base, names, measures, kept)
    groups = groups.withColumn("mean", F.try_divide("sum_y", F.col("rows").cast("double")))
    mu = totals(groups, names, {"mu": F.try_divide(F.sum("sum_y"), F.sum("rows").cast("double"))})["mu"]
    n = F.coalesce(F.col("support"), F.col("rows").cast("double")) if "w" in kept else F.col("rows").cast("double")
    out = groups.select(F.col("feature").alias("dimension"), "value", n.alias("n"), "mean", mu.alias("overall_mean"))
    out = out.withColumn("mean_shrunk", shrunk(F.col("mean"), F.col("n"), F.col("overall_mean"), k))
    gap = F.col("mean_shrunk") - F.col("overall_mean")
    return out.withColumn("contribution", F.col("n") * gap * gap)


def variance_decomposition_aggregated(df: DataFrame, y: str, support: str, dims: list[str], k: float = SHRINK) -> DataFrame:
    """The same on a table of group means: weights from the support, all dimensions as one label."""
    yv, w = number(df, y), F.coalesce(number(df, support), F.lit(0.0))
    base = df.filter(yv.isNotNull())
    mu = one_row(base.agg(F.try_divide(F.sum(w * yv), F.sum(w)).alias("mu")))["mu"]
    label = F.concat_ws(" | ", *[F.coalesce(_label(df, d), F.lit("(missing)")) for d in dims])
    out = base.select(
        F.lit(" & ".join(dims)).alias("dimension"), label.alias("value"), w.alias("n"), yv.alias("mean"), mu.alias("overall_mean")
    ).withColumn("mean_shrunk", shrunk(F.col("mean"), F.col("n"), F.col("overall_mean"), k))
    gap = F.col("mean_shrunk") - F.col("overall_mean")
    return out.withColumn("contribution", F.col("n") * gap * gap).filter("overall_mean is not null")


def pareto(contributions: DataFrame, top: int = 10, min_n: int = 5) -> DataFrame:
    """The largest stable drivers, the rest and the low-support ones, with running shares.

    If every driver is low in support they are ranked anyway. The top list is a distributed top-k;
    only its at most ``top`` + 2 lines are ranked and summed in order. The grouped contributions are
    used four times, so they are checkpointed instead of grouping the table four times.
    """
    valid = cut_lineage(contributions.filter("contribution > 0").select(
        driver_text().alias("driver"), "contribution", "n", (F.col("n") < min_n).alias("low")
    ))
    t = known(valid.agg(
        F.sum("contribution").alias("total"), F.coalesce(F.sum(F.when(F.col("low"), F.col("contribution"))), F.lit(0.0)).alias("low"),
        F.count_if(F.col("low")).alias("n_low"), F.count(F.lit(1)).alias("n"),
    ))
    all_low = t["n"] == t["n_low"]
    best = (
        valid.filter(all_low | ~F.col("low")).orderBy(F.col("contribution").desc(), "driver").limit(top)
        .select("driver", "contribution", F.lit(1).alias("part"))
    )
    shown = best.agg(F.sum("contribution").alias("shown"), F.count(F.lit(1)).alias("k"))
    n_stable = F.when(all_low, t["n"]).otherwise(t["n"] - t["n_low"])
    stable_total = F.when(all_low, t["total"]).otherwise(t["total"] - t["low"])
    other = shown.filter(n_stable > F.col("k")).select(
        F.lit("(other stable drivers)").alias("driver"), (stable_total - F.col("shown")).alias("contribution"), F.lit(2).alias("part")
    )
    low = shown.filter(~all_low & (t["n_low"] > 0)).select(
        F.lit(f"(low-support drivers: n<{min_n})").alias("driver"), t["low"].alias("contribution"), F.lit(3).alias("part")
    )
    lines = best.unionByName(other).unionByName(low).select(
        "driver", F.row_number().over(_ranking()).alias("rank"), (100.0 * F.col("contribution") / t["total"]).alias("share_pct")
    )
    # at most ``top`` lines and two more
    return lines.withColumn("cum_share_pct", F.sum("share_pct").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))


def driver_text():
    return F.concat(F.coalesce("value", F.lit("(missing)")), F.lit(" (n="), F.col("n").cast("bigint").cast("string"), F.lit(")"))


def _ranking():
    return Window.orderBy("part", F.col("contribution").desc(), "driver")


def outlier_bounds(df: DataFrame, y: str, mode: str = "both", k: float = 1.5) -> DataFrame:
    """The bounds in force, one row: fences, else p01/p99; p05/p95 when fewer than 8 of 40+ lie outside."""
    x = number(df, y)
    base = df.select(x.alias("x")).filter("x is not null")
    q = known(quantiles(base, ["x"], [0.01, 0.05, 0.25, 0.75, 0.95, 0.99]))["x"]
    iqr = q[3] - q[2]
    low = F.when(iqr > 0, q[2] - k * iqr).otherwise(q[2])
    high = F.when(iqr > 0, q[3] + k * iqr).otherwise(q[3])
    bad = F.coalesce(low >= high, F.lit(True))
    low, high = F.when(bad, q[0]).otherwise(low), F.when(bad, q[5]).otherwise(high)
    is_out = {"high": F.col("x") > high, "low": F.col("x") < low, "both": (F.col("x") < low) | (F.col("x") > high)}[mode]
    first = base.agg(
        F.count("x").alias("n"), F.count_if(is_out).alias("n_first"), F.max(low).alias("low"), F.max(high).alias("high"),
        F.max(q[0]).alias("p01"), F.max(q[1]).alias("p05"), F.max(q[4]).alias("p95"), F.max(q[5]).alias("p99"),
    )
    widen = (F.col("n_first") < 8) & (F.col("n") >= 40)
    return first.select(
        "n", F.when(widen & F.lit(mode != "high"), F.col("p05")).otherwise(F.col("low")).alias("low"),
        F.when(widen & F.lit(mode != "low"), F.col("p95")).otherwise(F.col("high")).alias("high"),
        widen.alias("widened"), "p01", "p99",
    )


def flag_outliers(df: DataFrame, y: str, mode: str = "both", k: float = 1.5) -> DataFrame:
    """Rows with a value, with ``is_outlier``; no row is filtered for being one."""
    b = known(outlier_bounds(df, y, mode, k))
    x = number(df, y)
    is_out = {"high": x > b["high"], "low": x < b["low"], "both": (x < b["low"]) | (x > b["high"])}[mode]
    return df.filter(x.isNotNull()).withColumn("is_outlier", is_out)


def categorical_contrast(flagged: DataFrame, y: str, dims: list[str] | None = None, ids: list[str] | None = None, k: int | None = 8) -> DataFrame:
    """Per column the value whose share differs most between outliers and the rest."""
    names = _dimensions(flagged.drop("is_outlier"), y, dims, (ids or []) if ids is not None else None)
    flag = F.col("is_outlier")
    groups = by_dimension(
        flagged, names, {"n_out": F.count_if("o"), "n_base": F.count_if(~F.col("o"))}, {"o": flag}
    )
    t = totals(groups, names, {"out": F.sum("n_out"), "base": F.sum("n_base")})
    share_out = 100.0 * F.col("n_out") / F.greatest(t["out"], F.lit(1))
    share_base = 100.0 * F.col("n_base") / F.greatest(t["base"], F.lit(1))
    diffs = groups.select(
        "feature", F.coalesce("value", F.lit("(missing)")).alias("value"), share_out.alias("share_out"),
        share_base.alias("share_base"), (share_out - share_base).alias("diff_pp"),
    ).filter("diff_pp <> 0")
    best = best_per_key(diffs, "feature", F.abs("diff_pp"), "value")
    ordered = best.withColumn("label", F.concat("feature", F.lit("="), "value", F.lit(" (Δ="), signed_percent_points("diff_pp"), F.lit(")"))).orderBy(
        F.abs("diff_pp").desc(), "feature"
    )
    return at_most(ordered, k)


def best_per_key(df: DataFrame, key: str, size, tie: str) -> DataFrame:
    """T5: the row with the largest size per key, the smaller tie value first; one aggregate, no window."""
    rest = [c for c in df.columns if c != key]
    row = F.struct(*[F.col(c) for c in rest])
    picked = df.groupBy(key).agg(F.min_by(row, F.struct((-size).alias("s"), F.col(tie).alias("t"))).alias("__row"))
    return picked.select(key, *[F.col("__row")[c].alias(c) for c in rest])


def numeric_contrast(flagged: DataFrame, y: str, columns: list[str] | None = None, ids: list[str] | None = None, k: int | None = 8, min_n: int = 30) -> DataFrame:
    """Correlation of each numeric column with the flag, and its mean in both classes."""
    names = columns or [
        c for c in roles.numeric_columns(flagged) if c != y and not (c in ids if ids is not None else roles.id_like(c))
    ]
    flag = F.when(F.col("is_outlier"), F.lit(1.0)).otherwise(F.lit(0.0))
    aggs = []
    rs = correlations(flagged, [(number(flagged, c), flag) for c in names])
    for c, r in zip(names, rs):
        x = number(flagged, c)
        aggs.append(F.struct(
            r.alias("r"), F.avg(F.when(flag == 1, x)).alias("mean_out"),
            F.avg(F.when(flag == 0, x)).alias("mean_base"), F.count(x).alias("n"),
        ).alias(c))
    wide = flagged.agg(*aggs)
    long = to_long(wide, [], {c: F.col(f"`{c}`") for c in names}, "feature", "s").select("feature", "s.*")
    found = long.filter((F.col("n") >= min_n) & F.col("r").isNotNull())
    named = found.withColumn("label", F.concat("feature", F.lit(" (r="), fixed("r", 2, signed=True), F.lit(")")))
    return at_most(named.orderBy(F.abs("r").desc(), "feature"), k)


def outlier_summary(df: DataFrame, y: str, mode: str = "both", k: float = 1.5) -> DataFrame:
    """N, mean and median of outliers and of the rest."""
    flagged = flag_outliers(df, y, mode, k)
    x = number(flagged, y)
    base = flagged.select(F.when(F.col("is_outlier"), F.lit("outlier")).otherwise(F.lit("typical")).alias("part"), x.alias("x"))
    middle = quantiles(base, ["x"], [0.5], ["part"]).select("part", F.col("x")[0].alias("median"))
    return base.groupBy("part").agg(F.count("x").alias("n"), F.avg("x").alias("mean")).join(middle, "part").select(
        "part", "n", "mean", "median"
    )


def outlier_histograms(df: DataFrame, y: str, mode: str = "both", k: float = 1.5) -> DataFrame:
    """A histogram of the typical range and one of the outliers."""
    b = known(outlier_bounds(df, y, mode, k))
    x = number(df, y)
    base = df.select(x.alias("x")).filter("x is not null")
    within = F.col("x").between(b["low"], b["high"])
    n_in = known(base.agg(F.count_if(within).alias("n")))["n"]
    view = F.when((n_in < 20) & (b["n"] >= 40), F.col("x").between(b["p01"], b["p99"])).otherwise(within)
    out = {"high": F.col("x") > b["high"], "low": F.col("x") < b["low"], "both": ~within}[mode]

    def part(name: str, cond, most: int) -> DataFrame:
        rows = base.filter(cond)
        e = known(rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n")))
        flat = e["hi"] <= e["lo"]
        lo = F.when(flat, e["lo"] - 0.5).otherwise(e["lo"])
        hi = F.when(flat, e["hi"] + 0.5).otherwise(e["hi"])
        bins = F.when(e["n"] <= 1, F.lit(10)).otherwise(
            F.greatest(F.lit(10), F.least(F.lit(most), F.floor(1.2 * F.sqrt(e["n"].cast("double"))).cast("int")))
        )
        counts = binned(rows, F.col("x"), lo, hi, bins)
        width = (hi - lo) / bins
        return counts.select(
            F.lit(name).alias("part"), "bin", (lo + F.col("bin") * width).alias("bin_start"),
            (lo + (F.col("bin") + 1) * width).alias("bin_end"), "n",
        )

    return part("typical", view, 40).unionByName(part("outliers", out, 30))


def numeric_effects(df: DataFrame, y: str, columns: list[str] | None = None, ids: list[str] | None = None, k: int | None = 8, min_n: int = 40) -> DataFrame:
    """Change of y per deviation of x, corr(x, y) * sd(y), for the strongest columns."""
    names = columns or [
        c for c in roles.numeric_columns(df) if c != y and not (c in ids if ids is not None else roles.id_like(c))
    ]
    yv = number(df, y)
    aggs = [F.stddev_pop(yv).alias("__sd")]
    rs = correlations(df, [(number(df, c), yv) for c in names])
    for c, r in zip(names, rs):
        x = number(df, c)
        aggs.append(F.struct(
            r.alias("corr"), F.count(F.when(x.isNotNull() & yv.isNotNull(), 1)).alias("n")
        ).alias(c))
    wide = df.agg(*aggs)
    long = to_long(wide, ["__sd"], {c: F.col(f"`{c}`") for c in names}, "feature", "s").select("feature", "__sd", "s.*")
    out = long.filter((F.col("n") >= min_n) & F.col("corr").isNotNull() & (F.col("__sd") > 0))
    ordered = out.select("feature", (F.col("corr") * F.col("__sd")).alias("effect"), "corr", "n").orderBy(F.abs("effect").desc(), "feature")
    return at_most(ordered, k)


def categorical_lifts(
    df: DataFrame, y: str, dims: list[str] | None = None, ids: list[str] | None = None, k: int | None = 10,
    min_group_n: int = 10, max_levels: int | None = 12, shrink: float = SHRINK,
) -> DataFrame:
    """Shrunk mean minus overall mean per level; levels beyond the ``max_levels`` largest are one.

    With a support column n is its sum, while the group mean stays unweighted.
    """
    yv = number(df, y)
    base = df.filter(yv.isNotNull())
    names = _dimensions(base, y, dims, ids)
    support = roles.support_column(df)
    weighted = support is not None and support != y
    w = F.coalesce(number(df, support), F.lit(0.0)) if weighted else F.lit(1.0)
    levels = by_dimension(
        base, names, {"rows": F.count("y"), "sum_y": F.sum("y"), "w": F.sum("w"), "sum_wy": F.sum(F.col("w") * F.col("y"))}, {"y": yv, "w": w}
    )
    total = totals(levels, names, {
        "n": F.sum("rows"), "mu": F.coalesce(F.try_divide(F.sum("sum_wy"), F.sum("w")), F.try_divide(F.sum("sum_y"), F.sum("rows").cast("double"))),
    })
    rank = F.row_number().over(Window.partitionBy("feature").orderBy(F.col("rows").desc(), F.col("value").asc_nulls_last()))
    own = F.coalesce("value", F.lit("(missing)"))
    bucket = own if max_levels is None else F.when(F.col("rank") <= max_levels, own).otherwise(F.lit("(other)"))
    groups = levels.withColumn("rank", rank).groupBy("feature", bucket.alias("value")).agg(
        F.sum("w").alias("n"), (F.sum("sum_y") / F.sum("rows")).alias("mean")
    ).filter((F.col("n") >= min_group_n) & (total["n"] >= 30))
    out = groups.select("feature", "value", "n", "mean", total["mu"].alias("overall_mean"))
    out = out.withColumn("mean_shrunk", shrunk(F.col("mean"), F.col("n"), F.col("overall_mean"), shrink))
    named = out.withColumn("lift", F.col("mean_shrunk") - F.col("overall_mean")).withColumn("label", driver_label("feature", "value", "n"))
    return at_most(named.orderBy(F.abs("lift").desc(), "feature", "value"), k)

"""Descriptive analyses N1-N13 and scale rules N24-N25, each as a table."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tabulon.functions.numbers import correlations, known, number, one_row, paired_corr, ratio, to_long, whole
from tabulon.functions.quantiles import join_on_keys, quantiles
from tabulon.functions.text import strip
from tabulon.operators.aggregate import number_stats, top_groups_by_mean, value_counts
from tabulon.operators.clean import text_columns
from tabulon.session import cut_lineage, sent


def fences(df: DataFrame, column: str, k: float = 1.5, min_n: int = 30, accuracy: int | None = None) -> DataFrame:
    """Quartiles, IQR fences, outlier count and share, min and max; one row.

    With no spread the fences are the quartiles and nothing counts as an outlier.
    """
    x = number(df, column)
    base = df.select(x.alias("x"))
    q = known(quantiles(df.select(f"`{column}`"), [column], [0.25, 0.75], accuracy=accuracy))[column]
    iqr = q[1] - q[0]
    spread = iqr > 0
    low = F.when(spread, q[0] - k * iqr).otherwise(q[0])
    high = F.when(spread, q[1] + k * iqr).otherwise(q[1])
    out = spread & ((F.col("x") < low) | (F.col("x") > high))
    s = base.agg(
        F.count("x").alias("n_valid"), F.count_if(out).alias("outlier_count"),
        F.min("x").alias("min"), F.max("x").alias("max"),
        F.max(q[0]).alias("q1"), F.max(q[1]).alias("q3"), F.max(low).alias("low"), F.max(high).alias("high"),
        F.count_if((F.col("x") >= low) & (F.col("x") <= high)).alias("n_between"),
    )
    ok = F.col("n_valid") >= min_n
    return s.select(
        ok.alias("ok"), "n_valid", *[F.when(ok, F.col(c)).alias(c) for c in ("q1", "q3")],
        F.when(ok, F.col("q3") - F.col("q1")).alias("iqr"), *[F.when(ok, F.col(c)).alias(c) for c in ("low", "high")],
        F.when(ok, F.col("outlier_count")).alias("outlier_count"),
        F.when(ok, ratio(F.col("outlier_count"), F.col("n_valid"), 0.0)).alias("outlier_frac"), "min", "max", "n_between",
    )


def without_rare_outliers(df: DataFrame, column: str, k: float = 1.5, max_share: float = 0.02, min_n: int = 30) -> DataFrame:
    """Rows outside the fences go only if there are some and they are at most 2%."""
    f = known(fences(df, column, k, min_n))
    x = number(df, column)
    applies = F.coalesce(f["ok"] & (f["outlier_count"] > 0) & (f["outlier_frac"] <= max_share), F.lit(False))
    return df.filter(~applies | F.coalesce((x >= f["low"]) & (x <= f["high"]), F.lit(False)))


def view_range(df: DataFrame, column: str, k: float = 1.5, min_n: int = 30) -> DataFrame:
    """The range a plot would show: the fences, widened while they show one value only.

    Whole-number data is rounded outward first; then the nearest values on the sides that hold
    outliers are taken in, found as one max below and one min above instead of a list of values.
    The decisions need one row of numbers per pass; the second pass runs only for a single value.
    """
    base = df.select(number(df, column).alias("x")).filter("x is not null")
    x = F.col("x")
    f = fences(df, column, k, min_n).first()
    use = bool(f["ok"] and f["n_between"])
    low, high = (f["low"], f["high"]) if use else (f["min"], f["max"])
    if low is not None:
        low, high = _widened(base, low, high)

    def shown(c):
        return F.when(x.between(F.lit(low), F.lit(high)), c)

    return base.agg(
        F.lit(low).cast("double").alias("low_view"), F.lit(high).cast("double").alias("high_view"),
        F.count(shown(x)).alias("n_in_view"),
        F.count_if(x < F.lit(low)).alias("n_below"), F.count_if(x > F.lit(high)).alias("n_above"),
        F.avg(shown(x)).alias("mean_in_view"), F.bool_and(shown(whole(x))).alias("whole_in_view"),
        F.min(shown(x)).alias("min_in_view"), F.max(shown(x)).alias("max_in_view"),
    )


def _widened(base: DataFrame, low: float, high: float) -> tuple[float, float]:
    x = F.col("x")
    lo_r, hi_r = float(np.floor(low)), float(np.ceil(high))
    tight, loose = x.between(low, high), x.between(lo_r, hi_r)
    s = base.agg(
        F.min("x").alias("min"), F.max("x").alias("max"), F.bool_and(whole(x)).alias("whole"),
        F.min(F.when(tight, x)).alias("tight_min"), F.max(F.when(tight, x)).alias("tight_max"),
        F.min(F.when(loose, x)).alias("loose_min"), F.max(F.when(loose, x)).alias("loose_max"),
    ).first()
    if s["min"] == s["max"] or s["tight_min"] != s["tight_max"]:
        return low, high
    anchor = s["tight_min"]
    if s["whole"]:
        low, high, anchor = lo_r, hi_r, s["loose_min"]
        if s["loose_min"] != s["loose_max"]:
            return low, high
    near = base.agg(
        F.max(F.when(x < anchor, x)).alias("below"), F.min(F.when(x > anchor, x)).alias("above"),
        F.count_if(x < low).alias("n_below"), F.count_if(x > high).alias("n_above"),
    ).first()
    below, above = near["below"], near["above"]
    new_low = min(low, below) if near["n_below"] and below is not None else low
    new_high = max(high, above) if near["n_above"] and above is not None else high
    if (new_low, new_high) == (low, high):
        if below is not None and (above is None or anchor - below <= above - anchor):
            new_low = min(low, below)
        elif above is not None:
            new_high = max(high, above)
    return new_low, new_high


def view_summary(df: DataFrame, column: str, k: float = 1.5, min_n: int = 30) -> DataFrame:
    """Values hidden below and above the view, mean and median of the shown ones."""
    v = view_range(df, column, k, min_n)
    r = known(v)
    x = number(df, column)
    seen = df.select(F.when((x >= r["low_view"]) & (x <= r["high_view"]), x).alias("x"))
    middle = known(quantiles(seen, ["x"], [0.5]))["x"][0]
    return v.select("low_view", "high_view", "n_in_view", "n_below", "n_above", "mean_in_view", middle.alias("median_in_view"))


def bin_edges(view: DataFrame) -> DataFrame:
    """First edge, bin width and number of bins for a view."""
    n = F.col("n_in_view")
    equal = F.least(F.lit(50), F.greatest(F.lit(12), F.rint(1.2 * F.sqrt(n.cast("double"))))).cast("int")
    lo, hi = F.col("low_view"), F.col("high_view")
    lo = F.when(hi > lo, lo).when(F.col("max_in_view") > F.col("min_in_view"), F.col("min_in_view")).otherwise(F.lit(0.0))
    hi_ = F.when(F.col("high_view") > F.col("low_view"), F.col("high_view")).when(
        F.col("max_in_view") > F.col("min_in_view"), F.col("max_in_view")
    ).otherwise(F.lit(1.0))
    lo_i = F.floor("low_view") - 1.5
    hi_i = F.ceil("high_view") + 1.5
    return view.select(
        F.when(F.col("whole_in_view"), lo_i).otherwise(lo).cast("double").alias("lo"),
        F.when(F.col("whole_in_view"), hi_i).otherwise(hi_).cast("double").alias("hi"),
        F.when(F.col("whole_in_view"), (hi_i - lo_i).cast("int")).otherwise(equal).alias("k"), "low_view", "high_view",
    )


def binned(df: DataFrame, x, lo, hi, k) -> DataFrame:
    """Counts per bin; the right edge belongs to the last bin."""
    place = F.least(F.floor((x - lo) / (hi - lo) * k).cast("int"), k - 1)
    return df.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def with_empty_bins(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """Every bin of the edges, also the empty ones."""
    bins = edges.select("lo", "hi", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.col("k")
    return bins.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"), F.coalesce("n", F.lit(0)).alias("n"),
    )


def histogram(df: DataFrame, column: str, k: float = 1.5, min_n: int = 30) -> DataFrame:
    """Histogram of the view; whole numbers get unit bins, else equal bins."""
    edges = bin_edges(view_range(df, column, k, min_n))
    e = known(edges)
    x = number(df, column)
    shown = df.filter((x >= e["low_view"]) & (x <= e["high_view"]))
    return with_empty_bins(binned(shown, x, e["lo"], e["hi"], e["k"]), edges)


def box_stats(df: DataFrame, column: str, group: str, low: int = 2, high: int | None = None) -> DataFrame:
    """Quartiles, whiskers on the last value inside 1.5 IQR, fliers; nothing for fewer than ``low`` or more than
    ``high`` groups."""
    label = strip(group) if group in text_columns(df) else F.col(f"`{group}`").cast("string")
    base = df.select(label.alias("group"), number(df, column).alias("x")).filter("x is not null")
    q = quantiles(base, ["x"], [0.25, 0.5, 0.75], ["group"]).select(
        "group", F.col("x")[0].alias("q1"), F.col("x")[1].alias("median"), F.col("x")[2].alias("q3")
    )
    levels = one_row(base.agg(F.count_distinct("group").alias("n")))["n"]
    q = sent(cut_lineage(q))  # a row per group: sent to all tasks, since a shuffle by few groups puts most rows into one
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("x").between(F.col("q1") - reach, F.col("q3") + reach)
    return join_on_keys(base, q, ["group"]).filter((levels >= low) & (F.lit(True) if high is None else levels <= high)).groupBy("group").agg(
        F.count("x").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside & (F.col("x") <= F.col("q1")), F.col("x"))).alias("lo_in"),
        F.max(F.when(inside & (F.col("x") >= F.col("q3")), F.col("x"))).alias("hi_in"),
        F.count_if(~inside).alias("fliers"),
    ).select(
        "group", "n", "q1", "median", "q3", F.coalesce("lo_in", "q1").alias("whisker_low"),
        F.coalesce("hi_in", "q3").alias("whisker_high"), "fliers",
    )


def composition(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """Levels (null included) with shares, the rest as one line; ``is_top`` marks the largest."""
    shown = value_counts(df, column, top)
    most = one_row(shown.agg(F.max("n").alias("n")))["n"]
    return shown.withColumn("is_top", F.col("n") == most)


def summary_cards(df: DataFrame, columns: list[str]) -> DataFrame:
    """Metrics with counts, missing rate, moments and quantiles."""
    names = columns
    wide = number_stats(df, names, [0.05, 0.25, 0.5, 0.75, 0.95])
    rows = {}
    for c in names:
        q = F.col(f"{c}__q")
        rows[c] = F.struct(
            F.col("n_total"), F.col(f"{c}__n").alias("n"),
            F.when(F.col("n_total") == 0, F.lit(0.0)).otherwise(1.0 - ratio(F.col(f"{c}__n"), F.col("n_total"), 0.0)).alias("missing_rate"),
            F.col(f"{c}__mean").alias("mean"), q[2].alias("median"), F.col(f"{c}__std").alias("std"),
            F.col(f"{c}__min").alias("min"), q[0].alias("p05"), q[1].alias("p25"), q[3].alias("p75"), q[4].alias("p95"),
            F.col(f"{c}__max").alias("max"),
        )
    return to_long(wide, [], rows, "column", "s").select("column", "s.*")


def group_compare(df: DataFrame, group: str, column: str, k: int = 20) -> DataFrame:
    """The k groups with the highest mean, with highest, lowest and gap of the shown ones."""
    shown = top_groups_by_mean(df, group, column, k)
    label = F.coalesce(F.col("value"), F.lit("(missing)"))
    ends = one_row(shown.agg(
        F.max_by(label, F.struct("mean", label)).alias("highest"), F.min_by(label, F.struct("mean", label)).alias("lowest"),
        (F.max("mean") - F.min("mean")).alias("gap"),
    ))
    total = one_row(df.agg(F.count_distinct(strip(group) if group in text_columns(df) else F.col(f"`{group}`")).alias("n")))["n"]
    return shown.select(
        "value", "mean", "n", ends["highest"].alias("highest"), ends["lowest"].alias("lowest"), ends["gap"].alias("gap"), total.alias("groups_total"),
    )


def correlation_matrix(df: DataFrame, columns: list[str], max_columns: int | None = None) -> DataFrame:
    """All ordered pairs, pairwise complete; 1 on the diagonal, null for a constant column."""
    names = columns[:max_columns]
    pairs = list(combinations_with_replacement(names, 2))
    rs = correlations(df, [(number(df, a), number(df, b)) for a, b in pairs])
    wide = df.agg(*[r.alias(f"r{i}") for i, r in enumerate(rs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for left, right in sorted({(a, b), (b, a)}):
            cells.append(F.struct(F.lit(left).alias("a"), F.lit(right).alias("b"), F.col(f"r{i}").alias("r")))
    return wide.select(F.inline(F.array(*cells)))


def top_pairs(matrix: DataFrame, k: int = 3) -> DataFrame:
    """The strongest distinct pairs of a matrix."""
    return matrix.filter("a < b and r is not null").orderBy(F.abs("r").desc(), "a", "b").limit(k)


def crosstab(df: DataFrame, a: str, b: str, top: int = 20) -> DataFrame:
    """Shares within each row of the crosstab, cut to the largest 20 rows and columns.

    The table is grouped once; the cut and the empty cells work on at most ``top`` x ``top`` labels.
    """
    cells = df.groupBy(
        F.coalesce(strip(F.col(f"`{a}`").cast("string")), F.lit("(missing)")).alias("a"),
        F.coalesce(strip(F.col(f"`{b}`").cast("string")), F.lit("(missing)")).alias("b"),
    ).agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("total_a")).orderBy(F.col("total_a").desc(), "a").limit(top)
    inner = cells.join(rows, "a")
    cols = inner.groupBy("b").agg(F.sum("n").alias("total_b")).orderBy(F.col("total_b").desc(), "b").limit(top)
    kept = inner.join(cols, "b")
    labels = one_row(cols.agg(F.array_sort(F.collect_list("b")).alias("b")))["b"]
    grid = rows.select("a", F.explode(labels).alias("b"))
    full = grid.join(kept.select("a", "b", "n"), ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = ratio(F.col("n"), F.sum("n").over(Window.partitionBy("a")), 0.0)
    return full.select("a", "b", "n", share.alias("share"))


def _axis_fences(base: DataFrame, name: str, q, n, k: float, min_n: int):
    """Fences of one axis; min and max where they do not apply; 0..1 for a constant axis."""
    iqr = q[name][1] - q[name][0]
    use = (n["n"] >= min_n) & (iqr > 0)
    lo = F.when(use, q[name][0] - k * iqr).otherwise(n[f"{name}_min"])
    hi = F.when(use, q[name][1] + k * iqr).otherwise(n[f"{name}_max"])
    flat = hi <= lo
    return F.when(flat, F.lit(0.0)).otherwise(lo), F.when(flat, F.lit(1.0)).otherwise(hi)


def paired_view(df: DataFrame, x: str, y: str, k: float = 1.5, min_n: int = 30) -> tuple[DataFrame, DataFrame]:
    """The complete pairs with their view flag, and the bounds of the view."""
    base = df.select(number(df, x).alias("x"), number(df, y).alias("y")).filter("x is not null and y is not null")
    q = known(quantiles(base, ["x", "y"], [0.25, 0.75]))
    n = known(base.agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"),
        F.min("y").alias("y_min"), F.max("y").alias("y_max"),
    ))
    xl, xh = _axis_fences(base, "x", q, n, k, min_n)
    yl, yh = _axis_fences(base, "y", q, n, k, min_n)
    inside = F.col("x").between(xl, xh) & F.col("y").between(yl, yh)
    bounds = base.agg(
        F.max(xl).alias("x_low"), F.max(xh).alias("x_high"), F.max(yl).alias("y_low"), F.max(yh).alias("y_high"),
        F.count_if(inside).alias("n_inside"),
    )
    few = known(bounds)["n_inside"] < 3
    return base.withColumn("in_view", inside | few), bounds


def scatter_stats(df: DataFrame, x: str, y: str, k: float = 1.5, min_n: int = 30) -> DataFrame:
    """Bounds, pairs in view, pairs below or above on either axis, Pearson r in view."""
    pairs, bounds = paired_view(df, x, y, k, min_n)
    b = known(bounds)
    xi, yi = F.when(F.col("in_view"), F.col("x")), F.when(F.col("in_view"), F.col("y"))
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if("in_view").alias("n_in_view"),
        F.count_if((F.col("x") < b["x_low"]) | (F.col("y") < b["y_low"])).alias("n_below"),
        F.count_if((F.col("x") > b["x_high"]) | (F.col("y") > b["y_high"])).alias("n_above"),
        paired_corr(xi, yi).alias("r"),
        F.max(b["x_low"]).alias("x_low"), F.max(b["x_high"]).alias("x_high"),
        F.max(b["y_low"]).alias("y_low"), F.max(b["y_high"]).alias("y_high"),
    )


def polynomial_fit(df: DataFrame, x: str, y: str, max_degree: int = 4) -> DataFrame:
    """Per degree 1-4 the residual sum, AIC and coefficients in standardised x; ``is_best`` by AIC.

    One pass gives mean and deviation, one the power sums of standardised x (15 numbers). Only these
    go to the driver for the small normal equations; residuals come from one more pass.
    """
    base = df.select(number(df, x).alias("x"), number(df, y).alias("y")).filter("x is not null and y is not null")
    m = base.agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.stddev_pop("x").alias("sx"),
        F.avg("y").alias("my"), F.stddev_pop("y").alias("sy"),
    ).first()
    schema = "degree int, n bigint, rss double, aic double, coefficients array<double>, is_best boolean"
    n = m["n"]
    if n < 3 or not m["sx"]:
        return df.sparkSession.createDataFrame([], schema)
    z = (F.col("x") - F.lit(m["mx"])) / F.lit(m["sx"])
    scale_y = m["sy"] or 1.0
    v = (F.col("y") - F.lit(m["my"])) / F.lit(scale_y)
    std = base.select(z.alias("z"), v.alias("v"))

    def power(i: int):
        out = F.lit(1.0)
        for _ in range(i):
            out = out * F.col("z")
        return out

    sums = std.agg(
        *[F.sum(power(i)).alias(f"s{i}") for i in range(2 * max_degree + 1)],
        *[F.sum(power(i) * F.col("v")).alias(f"t{i}") for i in range(max_degree + 1)],
    ).first()
    fits: dict[int, np.ndarray] = {}
    for d in range(1, max_degree + 1):
        if n < d + 2:
            continue
        gram = np.array([[sums[f"s{i + j}"] for j in range(d + 1)] for i in range(d + 1)])
        fits[d] = np.linalg.lstsq(gram, np.array([sums[f"t{i}"] for i in range(d + 1)]), rcond=None)[0]

    def fitted(c: np.ndarray):
        out = F.lit(float(c[-1]))
        for a in reversed(c[:-1]):
            out = out * F.col("z") + F.lit(float(a))
        return out

    rss = std.agg(*[F.sum((F.col("v") - fitted(c)) * (F.col("v") - fitted(c))).alias(str(d)) for d, c in fits.items()]).first()
    rows = []
    for d, c in fits.items():
        r = max(rss[str(d)] * scale_y ** 2, 1e-12)
        coef = [float(a) * scale_y for a in c]
        coef[0] += m["my"]
        rows.append((d, n, r, float(n * np.log(r / n) + 2 * (d + 1)), coef))
    best = min(rows, key=lambda r: (r[3], r[0]))[0]
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], schema)


def scale_choice(df: DataFrame, column: str, log_ratio: float = 20.0) -> DataFrame:
    """Percent for values in 0..1, log for positive values over a wide range; by extremes and by p05/p95."""
    x = number(df, column)
    base = df.select(x.alias("x"), F.when(x > 0, x).alias("pos"))
    s = known(base.agg(
        F.count("x").alias("n"), F.count("pos").alias("n_pos"), F.min("x").alias("min"), F.max("x").alias("max"),
    ))
    q = quantiles(base, ["x", "pos"], [0.05, 0.95])
    enough = s["n_pos"] >= F.greatest(F.lit(5), F.floor(0.5 * s["n"]).cast("int"))
    by_pos = F.try_divide(F.col("pos")[1], F.greatest(F.col("pos")[0], F.lit(1e-12)))
    by_all = F.try_divide(F.abs(F.col("x")[1]), F.greatest(F.abs(F.col("x")[0]), F.lit(1e-12)))
    spread = F.coalesce(F.when(enough, by_pos).otherwise(by_all), F.lit(1.0))
    percent = (s["min"] >= 0) & (s["max"] <= 1)
    wide = (s["min"] > 0) & (F.try_divide(s["max"], F.greatest(F.lit(1e-12), s["min"])) > 1e3)
    return q.select(
        s["n"].alias("n"), s["min"].alias("min"), s["max"].alias("max"), spread.alias("spread_ratio"),
        F.when(percent, F.lit("percent")).when(wide, F.lit("log")).otherwise(F.lit("linear")).alias("scale_by_extremes"),
        F.when((s["min"] > 0) & (spread >= log_ratio), F.lit("log")).otherwise(F.lit("linear")).alias("scale_by_spread"),
    )


def axis_range(
    df: DataFrame, column: str, k: float = 1.5, min_n: int = 30, scale: str = "linear", zero_baseline: bool = True,
    pad_frac: float = 0.03, pad_min_rel: float = 0.01,
) -> DataFrame:
    """Padded range of the inliers; a one-sided range starts or ends at zero; log scale pads by 10%."""
    f = known(fences(df, column, k, min_n))
    x = number(df, column)
    base = df.select(x.alias("x"))
    clipped = F.coalesce(f["ok"] & (f["outlier_count"] > 0) & (f["n_between"] >= max(3, int(0.5 * min_n))), F.lit(False))
    used = F.when(~clipped | F.col("x").between(f["low"], f["high"]), F.col("x"))
    if scale == "log":
        used = F.when(used > 0, used)
    s = base.agg(F.min(used).alias("lo"), F.max(used).alias("hi"), F.bool_or(clipped).alias("view_clipped"))
    if scale == "log":
        return s.select((F.col("lo") * 0.9).alias("axis_min"), (F.col("hi") * 1.1).alias("axis_max"), "view_clipped")
    pad = F.greatest(
        pad_frac * F.greatest(F.col("hi") - F.col("lo"), F.lit(0.0)),
        pad_min_rel * F.greatest(F.abs("lo"), F.abs("hi"), F.lit(1.0)),
    )
    low = F.when(F.lit(zero_baseline) & (F.col("lo") >= 0), F.lit(0.0)).otherwise(F.col("lo") - pad)
    high = F.when(F.lit(zero_baseline) & (F.col("lo") < 0) & (F.col("hi") <= 0), F.lit(0.0)).otherwise(F.col("hi") + pad)
    return s.select(low.alias("axis_min"), high.alias("axis_max"), "view_clipped")

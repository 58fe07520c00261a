"""Exact quantiles with linear interpolation, by one route for every size: selection by digits.

A first pass counts the values and finds the ends. Each further pass cuts the range that holds a wanted rank into 65,536
parts of equal width, counts rows per part with their least and greatest value, and running sums over these counts tell
which part holds the rank; the next pass looks at that part alone. A part whose ends agree is settled at once, so a
column of few values needs one pass. Once all open parts hold at most ``WINDOW_ROWS`` rows, one last pass ranks their
values. Where cutting by width leaves most rows in one part, the next pass cuts by magnitude (sign and binary exponent),
so widely spread values take a few passes, too. No task ranks more than 65,536 entries, whatever the size or skew.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulon.functions.numbers import number

PARTS = 1 << 16
WINDOW_ROWS = 1 << 16
#: Open parts that may be sent to all tasks; more of them are joined by a shuffle.
SENT_PARTS = 50_000
LINEAR, MAGNITUDE = 0, 1


def magnitude(v: Column) -> Column:
    """Non-decreasing in v: its sign times its binary exponent, counted up from the smallest positive number."""
    size = F.abs(v)
    step = F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(4000)).otherwise(F.floor(F.log2(size)) + 1076)
    return F.when(v < 0, -step).otherwise(step).cast("int")


def part_of(v: Column, low: Column, high: Column) -> Column:
    """Which of the parts of equal width between two ends a value is in; the lower end is in the first, the upper one in
    the last. Subtracting, dividing and rounding keep the order of values. Halves keep the width within range."""
    at = F.try_divide(v * 0.5 - low * 0.5, high * 0.5 - low * 0.5)
    # next to the smallest numbers halves may have no width
    near = F.coalesce(at, F.when(v > low, F.lit(1.0)).otherwise(F.lit(0.0)))
    return F.least(F.floor(near * PARTS), F.lit(PARTS - 1)).cast("int")


def digit_of(v: Column, low: Column, high: Column, mode: Column) -> Column:
    return F.when(mode == MAGNITUDE, magnitude(v)).otherwise(part_of(v, low, high))


def first_mode(low: float, high: float) -> int:
    return MAGNITUDE if math.isinf(low) or math.isinf(high) else LINEAR


def _approximate(df: DataFrame, keys: list[str], columns: list[str], probs: list[float], accuracy: int) -> DataFrame:
    ps = F.array(*[F.lit(float(p)) for p in probs])
    return df.groupBy(*[f"`{k}`" for k in keys]).agg(*[F.percentile_approx(number(df, c), ps, accuracy).alias(c) for c in columns])


def _counted(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per group and digit: rows before and up to it, and the least and greatest value in it."""
    counts = rows.groupBy(*group, "d").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    up = F.sum("n").over(Window.partitionBy(*group).orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(*group, "n", "lo", "hi", (up - F.col("n")).alias("before"), up.alias("upto"))


def _between(low: float, high: float, frac: float) -> float:
    return low if frac == 0 or low == high else low + frac * (high - low)


def _without_keys(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """What is open between passes are a few ranks, which the driver holds and puts into the next pass as literals."""
    spark = df.sparkSession
    wide = df.select(*[(number(df, c) + F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(columns)])  # adding zero makes both zeros one
    facts = wide.agg(*[F.struct(F.count(f"v{i}").alias("n"), F.min(f"v{i}").alias("lo"), F.max(f"v{i}").alias("hi")).alias(f"v{i}") for i in range(len(columns))]).first()
    slots = []
    for i in range(len(columns)):
        n, lo, hi = facts[f"v{i}"]
        for j, p in enumerate(probs):
            place = float(p) * (n - 1)
            slots += [{"c": i, "p": j, "s": s, "r": f(place), "frac": place - math.floor(place), "n": n, "lo": lo, "hi": hi, "mode": first_mode(lo, hi)} for s, f in ((0, math.floor), (1, math.ceil)) if n]
    while open_ := [x for x in slots if x["lo"] != x["hi"]]:
        last = max(x["n"] for x in open_) <= WINDOW_ROWS
        kinds = list(dict.fromkeys((x["c"], x["lo"], x["hi"], x["mode"]) for x in open_))
        number_of = {k: b for b, k in enumerate(kinds)}
        parts = []
        for i in sorted({k[0] for k in kinds}):
            v, own, digit = F.col(f"v{i}"), F.lit(None).cast("int"), F.lit(None).cast("double" if last else "int")
            for (c, lo, hi, mode), b in number_of.items():
                if c == i:
                    inside = v.between(F.lit(lo), F.lit(hi))
                    own = F.when(inside, F.lit(b)).otherwise(own)
                    if not last:
                        digit = F.when(inside, magnitude(v) if mode == MAGNITUDE else part_of(v, F.lit(lo), F.lit(hi))).otherwise(digit)
            parts.append(F.struct(own.alias("b"), v.alias("v"), (v if last else digit).alias("d")))
        rows = wide.select(F.inline(F.array(*parts))).filter("b is not null")
        ranks = F.array(*[F.struct(F.lit(number_of[x["c"], x["lo"], x["hi"], x["mode"]]).alias("k"), F.lit(y).alias("slot"), F.lit(x["r"]).cast("bigint").alias("r")) for y, x in enumerate(open_)])
        met = _counted(rows, ["b"]).select("*", F.inline(F.filter(ranks, lambda r: (r["k"] == F.col("b")) & (r["r"] >= F.col("before")) & (r["r"] < F.col("upto")))))
        for r in met.select("slot", (F.col("r") - F.col("before")).alias("r"), "n", "lo", "hi").collect():
            x = open_[r["slot"]]
            mode = first_mode(r["lo"], r["hi"]) if 2 * r["n"] <= x["n"] else MAGNITUDE if x["mode"] == LINEAR else LINEAR
            x.update(r=r["r"], n=r["n"], lo=r["lo"], hi=r["hi"], mode=mode)
    found = {(x["c"], x["p"], x["s"]): x for x in slots}
    out = []
    for i, c in enumerate(columns):
        if (i, 0, 0) not in found:
            out.append(F.lit(None).cast("array<double>").alias(c))
        else:
            values = [_between(found[i, j, 0]["lo"], found[i, j, 1]["lo"], found[i, j, 0]["frac"]) for j in range(len(probs))]
            out.append(F.array(*[F.lit(float(x)) for x in values]).alias(c))
    return spark.sql("SELECT 1 AS one").select(*out)


def _with_keys(df: DataFrame, keys: list[str], columns: list[str], probs: list[float]) -> DataFrame:
    """What is open between passes is a table with a few ranks per key, joined to the rows of the next pass."""
    from tabulon.session import cut_lineage

    names = [f"k{i}" for i in range(len(keys))]
    # equal values are counted as one row each from here on
    values = F.inline(F.array(*[F.struct(F.lit(i).alias("c"), (number(df, c) + F.lit(0.0)).alias("v")) for i, c in enumerate(columns)]))
    rows = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], values)
    facts = cut_lineage(rows.groupBy(*names, "c").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = F.array(*[
        F.struct(F.lit(j).alias("p"), F.lit(s).alias("s"), (F.floor(place(p)) if s == 0 else F.ceil(place(p))).cast("bigint").alias("r"), (place(p) - F.floor(place(p))).alias("frac"))
        for j, p in enumerate(probs) for s in (0, 1)
    ])
    endless = (F.abs(F.col("lo")) == float("inf")) | (F.abs(F.col("hi")) == float("inf"))
    start = F.when(endless, F.lit(MAGNITUDE)).otherwise(F.lit(LINEAR))
    slots = facts.filter("n > 0").select(*names, "c", "n", "lo", "hi", start.alias("mode"), F.inline(ranks))
    place_of, group = ["c", "p", "s", "frac"], [*names, "c", "b_lo", "b_hi"]

    def same(left: list[str], right: list[str]) -> Column:
        out = F.lit(True)
        for a, b in zip(left, right, strict=True):
            out = out & (F.col(a).eqNullSafe(F.col(b)) if a in names else F.col(a) == F.col(b))
        return out

    done = []
    while True:
        done.append(slots.filter("lo = hi").select(*names, *place_of, F.col("lo").alias("value")))
        open_ = slots.filter("lo <> hi")
        state = open_.agg(F.max("n").alias("n")).first()
        if state["n"] is None:
            break
        last = state["n"] <= WINDOW_ROWS
        parts = open_.select(*[F.col(c).alias(f"w_{c}") for c in (*names, "c")], F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), "mode").distinct()
        if parts.count() <= SENT_PARTS:
            parts = F.broadcast(parts)
        inside = same([*names, "c"], [f"w_{c}" for c in (*names, "c")]) & F.col("v").between(F.col("b_lo"), F.col("b_hi"))
        digit = F.col("v") if last else digit_of(F.col("v"), F.col("b_lo"), F.col("b_hi"), F.col("mode"))
        counts = _counted(rows.join(parts, inside).select(*group, "v", digit.alias("d")), group)
        wanted = open_.select(*[F.col(c).alias(f"w_{c}") for c in (*names, "c")], F.col("lo").alias("w_lo"), F.col("hi").alias("w_hi"), F.col("n").alias("w_n"), "mode", "p", "s", "r", "frac")
        met = counts.join(wanted, same(group, [*[f"w_{c}" for c in (*names, "c")], "w_lo", "w_hi"])).filter("r >= before and r < upto")
        if last:
            done.append(met.select(*names, *place_of, F.col("lo").alias("value")))
            break
        far = (F.abs(F.col("lo")) == float("inf")) | (F.abs(F.col("hi")) == float("inf"))
        other = F.when(F.col("mode") == LINEAR, F.lit(MAGNITUDE)).otherwise(F.lit(LINEAR))
        mode = F.when(2 * F.col("n") <= F.col("w_n"), F.when(far, F.lit(MAGNITUDE)).otherwise(F.lit(LINEAR))).otherwise(other)
        slots = cut_lineage(met.select(*names, "c", "n", "lo", "hi", mode.alias("mode"), "p", "s", (F.col("r") - F.col("before")).alias("r"), "frac"))
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    of = lambda i, j, s: F.max(F.when((F.col("c") == i) & (F.col("p") == j) & (F.col("s") == s), F.col("value")))
    sides = found.groupBy(*names).agg(
        *[of(i, j, s).alias(f"q{i}_{j}_{s}") for i in range(len(columns)) for j in range(len(probs)) for s in (0, 1)],
        *[F.max(F.when((F.col("c") == i) & (F.col("p") == j), F.col("frac"))).alias(f"f{i}_{j}") for i in range(len(columns)) for j in range(len(probs))],
    )

    def value(i: int, j: int) -> Column:
        low, high, frac = F.col(f"q{i}_{j}_0"), F.col(f"q{i}_{j}_1"), F.col(f"f{i}_{j}")
        return F.when((frac == 0) | (low == high), low).otherwise(low + frac * (high - low))

    arrays = [F.when(F.col(f"q{i}_0_0").isNotNull(), F.array(*[value(i, j) for j in range(len(probs))])).alias(f"out{i}") for i in range(len(columns))]
    wide = sides.select(*names, *arrays)
    whole = join_on_keys(facts.select(*names).distinct(), wide, names, "left")
    return whole.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *[F.col(f"out{i}").alias(c) for i, c in enumerate(columns)])


def quantiles(df: DataFrame, columns: list[str], probs: list[float], keys: list[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """One row (or one row per key, null keys included): for every column an array with its quantiles.

    Linear interpolation between the two ranks next to a quantile; null where a column has no value. ``accuracy`` asks
    for the approximate aggregate of that accuracy instead. The passes run when this is called.
    """
    if accuracy is not None:
        return _approximate(df, keys or [], columns, probs, accuracy)
    if not columns or not probs:
        raise ValueError("quantiles need columns and probabilities")
    return _with_keys(df, keys, columns, probs) if keys else _without_keys(df, columns, probs)


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys, keeping one copy of the keys."""
    if not keys:
        raise ValueError("no keys")
    renamed = right.select(
        *[F.col(f"`{k}`").alias(f"__r_{k}") if k in keys else F.col(f"`{k}`") for k in right.columns]
    )
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])

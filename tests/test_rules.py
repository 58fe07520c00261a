"""Null, tie, spread, single-value and empty-input rules on small frames."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.functions.expressions import canonical, canonical_set
from tabulon.functions.distinct import distinct_up_to, exact_distinct
from tabulon.functions.numbers import correlations, number
from tabulon.functions.running import running
from tabulon.functions import quantiles as Q
from tabulon.functions.quantiles import quantiles
from tabulon.functions import text as X
from tabulon.functions.text import WHITESPACE, content_words, number_free, strip, words
from tabulon.operators import aggregate as A
from tabulon.operators import clean as C
from tabulon.operators import columns as P
from tabulon.operators import descriptive as N
from tabulon.operators import diagnostic as G
from tabulon.operators import features as M
from tabulon.operators import modelstore, prescriptive
from tabulon.operators import predictive as ML
from tabulon.operators import reshape as U
from tabulon.operators import series as W
from tabulon.operators import textops as K
from tabulon.operators import verify as V
from tabulon.operators.predicates import Condition, condition_column, where_all, where_guarded, where_plain
from tabulon.plans.registry import ANALYSES, run_steps
from tabulon.sources import readers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, column=None):
    rows = df.collect()
    return sorted(((r[column] if column else tuple(r)) for r in rows), key=lambda v: (v is None, str(v)))


# --- filters ----------------------------------------------------------------------------------

def test_text_equality_trims_and_null_rules(spark):
    df = frame(spark, [(1, " a "), (2, "b"), (3, None)], "id int, s string")
    assert values(where_all(df, [Condition("s", "==", "a ")]), "id") == [1]
    assert values(where_all(df, [Condition("s", "!=", "a")]), "id") == [2]
    assert values(where_all(df, [Condition("s", "==", [])]), "id") == [3]
    assert values(where_all(df, [Condition("s", "!=", ["a", "x"])]), "id") == [2, 3]
    assert values(where_all(df, [Condition("s", "==", 5)]), "id") == []


def test_number_inequality_keeps_nulls_and_nan_is_null(spark):
    df = frame(spark, [(1, 1.0), (2, 2.0), (3, None), (4, float("nan"))], "id int, x double")
    assert values(where_all(df, [Condition("x", "!=", 1)]), "id") == [2, 3, 4]
    assert values(where_all(df, [Condition("x", ">=", 2)]), "id") == [2]
    assert values(where_all(df, [Condition("x", ">", "abc")]), "id") == []


def test_contains_is_a_regex_without_case_and_never_matches_null(spark):
    df = frame(spark, [(1, "Nanny"), (2, None), (3, "xyz")], "id int, s string")
    assert values(where_all(df, [Condition("s", "contains", "NAN")]), "id") == [1]
    assert values(where_all(df, [Condition("s", "contains", ["^x", "q"])]), "id") == [3]
    assert values(where_plain(df, [Condition("s", "contains", "NAN")]), "id") == []


def test_contains_on_large_numbers_has_no_exponent(spark):
    df = frame(spark, [(12345678.9,)], "x double")
    assert where_all(df, [Condition("x", "contains", "12345678\\.9")]).count() == 1


@pytest.mark.parametrize("conditions", [
    [Condition("x", ">", 100)], [Condition("x", ">", 1), Condition("x", "<", 1)], [Condition("gone", "==", 1)], [],
    [Condition("x", "==", i) for i in range(30)],
])
def test_guarded_filter_never_empties(spark, conditions):
    df = frame(spark, [(1,), (2,), (3,)], "x int")
    assert where_guarded(df, conditions)[0].count() > 0


def test_guarded_filter_matches_the_step_by_step_rule(spark):
    df = frame(spark, [(i, i % 3, i % 5) for i in range(30)], "x int, a int, b int")
    conditions = [Condition("a", "==", 1), Condition("b", "==", 9), Condition("b", ">", 2), Condition("a", "==", 2), Condition("x", "<", 20)]
    step = df
    for c in conditions:
        trial = step.filter(condition_column(step, c))
        step = trial if trial.count() else step
    out, kept, notes = where_guarded(df, conditions)
    assert values(out, "x") == values(step, "x") and len(kept) == 3 and len(notes) == 2


# --- quantiles and statistics -----------------------------------------------------------------

ENDS = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 1.0, -1.0, 1.0 + 2**-52, 2.0 - 2**-52, 2.0, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 3.0, 1e15, 0.1, -0.3]


def test_digits_keep_the_order_of_numbers(spark):
    rng = np.random.default_rng(5)
    xs = ENDS + [float(x) for x in rng.integers(-(2**63), 2**63 - 1, 2000).view(np.float64) if np.isfinite(x)]
    xs += [float(s * 2.0**e * f) for e in range(-1074, 1024, 7) for f in (1.0, 1 - 2**-53, 1 + 2**-52) for s in (1, -1) if np.isfinite(2.0**e * f)]
    df = frame(spark, [(x,) for x in xs], "x double")
    got = sorted(((r[0], r[1]) for r in df.select("x", Q.magnitude(F.col("x"))).collect()), key=lambda r: r[0])
    assert [d for _, d in got] == sorted(d for _, d in got) and len({d for _, d in got}) > 1500
    for low, high in ((-1.7976931348623157e308, 1.7976931348623157e308), (0.0, 5e-324), (-5e-324, 5e-324), (1.0, 1.0 + 2**-52), (-1.0, 1e15), (2.0**-1022, 1.0)):
        inside = df.filter(F.col("x").between(low, high)).select("x", Q.part_of(F.col("x"), F.lit(low), F.lit(high)).alias("d"))
        got = sorted(((r["x"], r["d"]) for r in inside.unionByName(spark.createDataFrame([(low, 0), (high, Q.PARTS - 1)], "x double, d int")).collect()), key=lambda r: r[0])
        digits = [d for _, d in got]
        assert digits == sorted(digits) and digits[0] == 0 and digits[-1] == Q.PARTS - 1


@pytest.mark.parametrize("parts", [1, 8])
@pytest.mark.parametrize("window", [1, 20, 1 << 16])
def test_quantiles_as_numpy(spark, monkeypatch, parts, window):
    monkeypatch.setattr(Q, "WINDOW_ROWS", window)  # with 1 the search goes on until the ends agree
    monkeypatch.setattr(Q, "PARTS", 16)
    rng = np.random.default_rng(1)
    xs = np.concatenate([rng.normal(0, 1e-3, 200), rng.normal(1e6, 1e5, 200), np.full(300, 7.0), -rng.random(50), 1e9 + rng.random(100) * 1e-5, [1e308, -1e308, 5e-324]])
    rows = [(None if i % 4 == 3 else int(i % 4), None if i % 17 == 0 else float(x), None if i % 3 else i) for i, x in enumerate(xs)]
    df = frame(spark, rows, "g int, x double, y int").repartition(parts)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]

    def expected(group, c):
        return np.quantile([r[c] for r in rows if r[c] is not None and (group == "all" or r[0] == group)], probs)

    one = quantiles(df, ["x", "y"], probs).first()
    assert np.allclose(one["x"], expected("all", 1), rtol=1e-12, atol=0) and np.allclose(one["y"], expected("all", 2), rtol=1e-12, atol=0)
    by = {r["g"]: r for r in quantiles(df, ["x", "y"], probs, ["g"]).collect()}
    assert set(by) == {None, 0, 1, 2}
    for g, r in by.items():
        assert np.allclose(r["x"], expected(g, 1), rtol=1e-12, atol=0) and np.allclose(r["y"], expected(g, 2), rtol=1e-12, atol=0)


def test_quantiles_with_infinities_ties_and_nothing(spark):
    df = frame(spark, [(1, None, "n/a")], "g int, x double, s string")
    for c in ("x", "s"):
        assert quantiles(df, [c], [0.5]).first()[c] is None and quantiles(df, [c], [0.5], ["g"]).first()[c] is None
    assert quantiles(df.limit(0), ["x"], [0.5]).first()["x"] is None and quantiles(df.limit(0), ["x"], [0.5], ["g"]).count() == 0
    inf = float("inf")
    df = frame(spark, [(1, -inf), (1, inf), (1, inf), (2, 0.0), (2, -0.0), (2, float("nan"))], "g int, x double")
    assert {r["g"]: r["x"] for r in quantiles(df, ["x"], [0.0, 0.75, 1.0], ["g"]).collect()} == {1: [-inf, inf, inf], 2: [0.0, 0.0, 0.0]}


def test_no_task_ranks_more_than_a_digit_of_rows(spark):
    """One value on two thirds of the rows and a narrow rest: settled by counts, with no window over all rows."""
    df = spark.range(300_000).select(F.when(F.col("id") % 3 < 2, 5.0).otherwise(1e6 + F.col("id") * 1e-7).alias("x"))
    xs = np.where(np.arange(300_000) % 3 < 2, 5.0, 1e6 + np.arange(300_000) * 1e-7)
    assert np.allclose(quantiles(df, ["x"], [0.1, 0.5, 0.8, 0.99]).first()["x"], np.quantile(xs, [0.1, 0.5, 0.8, 0.99]), rtol=1e-15, atol=0)


def test_correlations_with_gaps_and_constants(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.normal(size=60), "b": rng.normal(size=60), "c": 3.0})
    pdf.loc[::7, "b"] = np.nan
    df = frame(spark, [tuple(None if v != v else float(v) for v in r) for r in pdf.itertuples(index=False)], "a double, b double, c double")
    rs = correlations(df, [(number(df, "a"), number(df, "b")), (number(df, "a"), number(df, "c"))])
    row = df.agg(rs[0].alias("ab"), rs[1].alias("ac")).first()
    assert row["ab"] == pytest.approx(pdf["a"].corr(pdf["b"])) and row["ac"] is None


def test_fences_without_spread_and_with_few_values(spark):
    flat = frame(spark, [(5.0,)] * 40 + [(9.0,)], "x double")
    f = N.fences(flat, "x").first()
    assert f["ok"] and f["low"] == f["high"] == 5.0 and f["outlier_count"] == 0
    few = N.fences(frame(spark, [(1.0,), (2.0,)], "x double"), "x").first()
    assert not few["ok"] and few["low"] is None and few["min"] == 1.0


def test_view_is_widened_to_the_nearest_values(spark):
    rows = [(5.0,)] * 40 + [(9.0,), (2.0,), (11.0,)]
    v = N.view_range(frame(spark, rows, "x double"), "x").first()
    assert (v["low_view"], v["high_view"]) == (2.0, 9.0) and v["n_above"] == 1


def test_whole_numbers_are_rounded_outward_first(spark):
    x = [(10.0,)] * 60 + [(11.0,)]
    v = N.view_range(frame(spark, x, "x double"), "x").first()
    assert v["high_view"] == 11.0 and v["n_in_view"] == 61


@pytest.mark.parametrize("rows", [[(float(i % 13) + 0.5,) for i in range(100)], [(float(i % 6),) for i in range(100)], [(2.5,)] * 35])
def test_histogram_counts_add_up(spark, rows):
    df = frame(spark, rows, "x double")
    v = N.view_range(df, "x").first()
    assert sum(r["n"] for r in N.histogram(df, "x").collect()) == v["n_in_view"]


def test_group_sums_of_nothing_are_zero_and_null_keys_stay(spark):
    df = frame(spark, [("a", None), (None, 2.0), (None, 3.0)], "g string, x double")
    out = A.aggregate(df, A.Plan(["g"], [A.Metric("s", "x", "sum")]))
    assert values(out) == sorted([("a", 0.0, 1), (None, 5.0, 2)], key=str)


def test_medians_of_groups_without_values_are_null(spark):
    df = frame(spark, [("a", 1.0), ("a", 4.0), (None, 2.0), ("b", None)], "g string, x double")
    plan = A.Plan(["g"], [A.Metric("m", "x", "median"), A.Metric("n", None, "count")])
    assert values(A.aggregate(df, plan)) == sorted([("a", 2.5, 2), (None, 2.0, 1), ("b", None, 1)], key=str)


def test_single_value_deviation_is_zero(spark):
    s = A.number_stats(frame(spark, [(4.0,)], "x double"), ["x"], [0.5]).first()
    assert s["x__std"] == 0.0 and s["x__q"] == [4.0]


# --- cleaning ---------------------------------------------------------------------------------

def test_strip_knows_every_python_blank(spark):
    df = frame(spark, [(WHITESPACE + "x" + WHITESPACE,)], "s string")
    assert df.select(strip("s")).first()[0] == "x"


def test_guarded_drops(spark):
    df = frame(spark, [(i, None if i < 2 else 1) for i in range(10)], "id int, x int")
    assert C.drop_incomplete(df, ["x"]).count() == 10
    assert C.drop_incomplete(df, ["x"], max_drop=0.2).count() == 8
    twice = df.unionByName(df.filter("id = 5"))
    assert C.drop_duplicates(twice, ["id"]).count() == 10
    assert C.drop_duplicates(df.withColumn("k", F.lit(1)), ["k"]).count() == 10
    assert C.drop_duplicates(df.withColumn("k", F.lit(1)), ["k"], ["id"], force=True).first()["id"] == 0
    assert C.drop_duplicates(df.select("x")).count() == 10


def test_wide_duplicates_by_hashes_first(spark):
    rows = [(i % 7, None if i % 3 else "x", i % 2 == 0, float(i % 5)) for i in range(300)] + [(99, "only", True, 1.0), (None, "x", True, None)]
    df = frame(spark, rows, "a int, b string, c boolean, d double")
    assert C.duplicate_share(df, df.columns).first()["n_duplicates"] == len(rows) - len(set(rows))
    one = frame(spark, [(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert C.duplicate_share(one, one.columns).first()["n_duplicates"] == 0


def test_mode_ties_take_the_smaller_value(spark):
    df = frame(spark, [("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert values(C.impute_mode(df, ["s"]), "s") == ["a", "a", "a", "b", "b"]


def test_clip_does_nothing_without_spread(spark):
    df = frame(spark, [(1.0,)] * 9 + [(50.0,), (None,)], "x double")
    assert values(C.clip_outliers(df, "x"), "x") == values(df, "x")


def test_prepare_runs_missing_tokens_first(spark):
    df = frame(spark, [(" ? ", " 3 "), ("x", "n/a")], "s string, n string")
    out = C.prepare(df, [{"name": "coerce_numeric", "params": {"columns": ["n"]}}, {"name": "unknown"}])
    assert values(out) == [("x", None), (None, 3.0)]


# --- series -----------------------------------------------------------------------------------

def daily(spark, n, key="a", twice=False):
    start = dt.datetime(2024, 1, 1)
    rows = [(key, start + dt.timedelta(days=i), 100.0 + 2 * i + (i % 7)) for i in range(n)]
    return frame(spark, rows + (rows if twice else []), "k string, ts timestamp_ntz, v double")


def test_forecast_survives_repeated_times_and_short_series(spark):
    raw = daily(spark, 60, twice=True).unionByName(daily(spark, 8, "short"))
    s = W.build_series(raw, ["k"], "ts", "v", "day", "mean")
    out = ML.forecast(s, ["k"], "day", 7, trees=5, depth=4).points.orderBy("step").collect()
    assert [r["step"] for r in out] == list(range(1, 8)) and {r["k"] for r in out} == {"a"}
    assert out[0]["t"] == dt.datetime(2024, 3, 1) and all(150 < r["forecast"] < 300 for r in out)


def test_forecast_of_one_series_without_keys(spark):
    s = W.build_series(daily(spark, 60), [], "ts", "v", "day", "mean")
    assert ML.forecast(s, [], "day", 2, trees=3, depth=3).points.count() == 2


def test_forecast_needs_thirty_points(spark):
    with pytest.raises(ValueError):
        ML.forecast(W.build_series(daily(spark, 20), ["k"], "ts", "v", "day"), ["k"], "day", 3, trees=3)


def test_slope_of_a_line_and_of_two_points(spark):
    line = frame(spark, [(dt.datetime(2024, 1, 1 + i), 5.0 + 3 * i) for i in range(12)], "t timestamp_ntz, y double")
    assert W.recent_slope(line, []).first()["slope"] == pytest.approx(3.0)
    assert W.recent_slope(line.limit(2), []).first()["slope"] == 0.0


def test_unaligned_last_point_goes_to_the_next_period(spark):
    s = frame(spark, [(dt.datetime(2024, 1, 17),)], "t timestamp_ntz")
    assert [r["t"] for r in W.future_calendar(s, [], "month", 2).orderBy("step").collect()] == [dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1)]


def test_constant_support_maps_to_the_middle(spark):
    s = W.scaled_support(frame(spark, [(3,), (3,)], "n_records int")).first()
    assert s["scaled"] == 102.5


# --- diagnostics ------------------------------------------------------------------------------

def test_pareto_shares_add_up_and_low_support_is_apart(spark):
    rows = [("d", f"v{i}", float(3 if i > 11 else 50), 1.0 + i) for i in range(15)]
    df = frame(spark, rows, "dimension string, value string, n double, contribution double")
    out = G.pareto(df).orderBy("rank").collect()
    assert len(out) == 12 and sum(r["share_pct"] for r in out) == pytest.approx(100.0)
    assert out[-1]["driver"].startswith("(low-support") and out[-1]["cum_share_pct"] == pytest.approx(100.0)
    only_low = G.pareto(df.filter("n < 5")).collect()
    assert len(only_low) == 3 and not any("low-support" in r["driver"] for r in only_low)


def test_no_outliers_without_spread_of_the_median(spark):
    df = frame(spark, [(1.0,)] * 9 + [(99.0,)], "x double")
    assert V.robust_outliers(df, "x").count() == 0


def test_support_join_matches_null_keys(spark):
    df = frame(spark, [("a", 1.0), (None, 2.0)], "g string, m double")
    counts = frame(spark, [("a", 5), (None, 7)], "g string, n_records bigint")
    assert values(V.join_support(df, counts), "n_records") == [5, 7]


def test_polynomial_degree_by_aic(spark):
    rows = [(float(i), 2.0 + 0.5 * i - 0.3 * i * i + math.sin(i * 12.9) * 0.01) for i in range(40)]
    df = frame(spark, rows, "x double, y double")
    best = N.polynomial_fit(df, "x", "y").filter("is_best").first()
    assert best["degree"] >= 2
    coef = np.polyfit([r[0] for r in rows], [r[1] for r in rows], best["degree"])
    rss = sum((np.polyval(coef, x) - y) ** 2 for x, y in rows)
    assert best["rss"] == pytest.approx(rss, rel=1e-4)


# --- features and scenarios -------------------------------------------------------------------

def test_no_features_is_an_error_not_a_crash(spark):
    df = frame(spark, [(i, float(i), i % 2 == 0) for i in range(100)], "id int, y double, is_train boolean")
    with pytest.raises(ValueError):
        ML.fit_regression(df, "y", ids=["id"], columns=["id_not_there"], trees=3)


def test_scenario_from_bounds_and_lists():
    got = M.scenario_from_conditions([Condition("a", ">", 2), Condition("a", "<=", 6), Condition("b", "in", ["x", "y"]), Condition("c", ">", "?")])
    assert got == {"a": 4.0, "b": "x"}


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(500)
    a = values(M.hash_split(df.repartition(1), ["id"]).filter("is_train"), "id")
    assert a == values(M.hash_split(df.repartition(8), ["id"]).filter("is_train"), "id") and 330 < len(a) < 470


def test_few_candidates_are_all_kept(spark):
    df = frame(spark, [("a",)] * 6 + [("b",)] * 2, "d string")
    assert M.candidate_list(df, "d").count() == 2


def test_unique_baseline_is_enforced(spark):
    df = frame(spark, [(1, "x"), (1, "y")], "id int, v string")
    with pytest.raises(ValueError):
        U.join_baseline(df, df, ["id"], ["v"])


def test_missing_ids_brute_force(spark):
    rows = [("a", 1), ("a", 2), ("b", 2), ("c", 3), ("c", None)]
    got = values(U.missing_ids(frame(spark, rows, "g string, id int"), "g", "id"))
    assert got == sorted([("a", 3), ("b", 1), ("b", 3), ("c", 1), ("c", 2)], key=str)


def test_column_rules(spark):
    df = frame(spark, [(1, "a", 2.0)], "user_id int, kind string, price double")
    assert P.select_existing(df, ["nope"]).columns == df.columns
    assert P.ensure_metric(["user_id", "kind"], "price", 2) == ["price", "kind"]
    assert P.ensure_metric(["kind", "due_date"], "price", 2) == ["kind", "price"]
    assert P.feature_columns(df, df.columns) == ["kind", "price"]
    assert P.summary_columns(df, ["price"], "price", "kind") == ["price", "kind"]


def test_registry_runs_steps(spark):
    df = frame(spark, [("a", float(i)) for i in range(40)], "g string, x double")
    out = run_steps(df, [("filters", {"conditions": [Condition("x", ">", 3)]}), ("analyze", {"family": "descriptive", "kind": "histogram" if ("descriptive", "histogram") in ANALYSES else "distribution", "column": "x"})])
    assert sum(r["n"] for r in out.collect()) == 36


# --- texts ------------------------------------------------------------------------------------

def plain_chunks(text, size=1200, overlap=150):
    text = text.replace("\r\n", "\n")
    if len(text) <= size:
        return [text] if text.strip() else []
    starts = [0]
    while starts[-1] + size < len(text):
        starts.append(starts[-1] + size - overlap)
    return [text[s:s + size] for s in starts]


@pytest.mark.parametrize("n", [0, 1, 1199, 1200, 1201, 1350, 2250, 2251, 5000])
def test_chunks_equal_a_plain_reading(spark, n):
    text = ("äb\r\nc " * 2000)[:n]
    got = K.chunk_text(frame(spark, [(text,)], "text string")).orderBy("chunk_no").collect()
    assert [r["chunk"] for r in got] == plain_chunks(text)


def test_words_with_underscores(spark):
    df = frame(spark, [("Ist_DLZ-x/y über",)], "t string")
    assert df.select(words("t")).first()[0] == ["ist_dlz", "ist", "dlz", "x", "y", "über"]


TEXTS = [
    "The machine was late by 3 days on monday", "the machine was LATE by 12.5 days on monday", "yes", "yes indeed", "oh yes indeed sir",
    "alpha beta gamma delta epsilon", "epsilon delta gamma beta alpha", "alpha beta gamma delta epsilon zeta", "beta gamma", "a", "",
    " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)), " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(55)),
    " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(36)), " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(2, 44)),
    "the machine was late by 7 days on monday",
]


@pytest.mark.parametrize("threshold", [0.5, 0.78, 0.9])
def test_near_duplicates_against_brute_force(spark, threshold):
    df = frame(spark, list(enumerate(TEXTS)), "id int, t string")
    rows = df.select("id", number_free("t").alias("f"), F.array_sort(content_words("t")).alias("w")).filter("f <> ''").orderBy("id").collect()
    want = set()
    forms, sets = {}, {}
    for r in rows:
        if r["f"] in forms:
            want.add(("copy", forms[r["f"]], r["id"]))
            continue
        forms[r["f"]] = r["id"]
        w = tuple(r["w"])
        if w and w in sets:
            want.add(("words", sets[w], r["id"]))
        elif w:
            sets[w] = r["id"]
    for wa, a in sets.items():
        for wb, b in sets.items():
            if a < b and len(set(wa) & set(wb)) / len(set(wa) | set(wb)) >= threshold:
                want.add(("similar", a, b))
    want |= {("inside", a, b) for fa, a in forms.items() for fb, b in forms.items() if a != b and fa in fb}
    got = {(r["kind"], r["left_id"], r["right_id"]) for r in K.near_duplicates(df, "id", "t", threshold).collect()}
    assert got == want


def test_hot_copies_are_a_star_not_pairs(spark):
    rows = [(i, "The press stopped after 3 hours of work") for i in range(200)] + [(i, f"The press stopped after {i} hours of work") for i in range(200, 300)]
    got = K.near_duplicates(frame(spark, rows, "id int, t string"), "id", "t").collect()
    assert len(got) == 299 and {r["left_id"] for r in got} == {0} and {r["kind"] for r in got} == {"copy"}


def test_highlights_skip_near_copies(spark):
    rows = [(1, 0, "most parts were late by 3 days in may"), (1, 1, "Most parts were late by 9 days in may"), (1, 2, "nothing else to say"), (1, 3, "")]
    out = K.pick_highlights(frame(spark, rows, "d int, p int, s string"), "d", "s", "p")
    assert values(out.select("rank", "position")) == [(1, 0), (2, 2)]


def test_search_finds_the_whole_query(spark):
    q = frame(spark, [(1, "red ring parts"), (2, "")], "qid int, q string")
    c = frame(spark, [(10, "we sell red ring parts today"), (11, "parts of a ring"), (12, "unrelated")], "cid int, t string")
    got = K.keyword_search(q, c, "qid", "q", ["cid"], "t", carry=["t"]).collect()
    assert {(r["cid"], round(r["score"], 4)) for r in got} == {(10, 1.0), (11, round(2 / 6, 4))} and {r["t"] for r in got} == {"we sell red ring parts today", "parts of a ring"}


@pytest.mark.parametrize("top", [1, 5])
def test_search_as_scoring_every_chunk(spark, top):
    """Bounds drop no result: many ties, a word in nearly every chunk, queries of one word, phrases that cut words."""
    rnd = random.Random(8)
    common, rare = ["the", "of"], [f"w{i}" for i in range(30)] + ["a_b", "über"]
    text = lambda n: " ".join(rnd.choice(common) if rnd.random() < 0.6 else rnd.choice(rare) for _ in range(n))
    chunks = [(i // 3, i % 3, text(rnd.randint(0, 12))) for i in range(240)] + [(90, 0, None), (91, 0, "xxthe ofyy the of"), (92, 0, "THE   w1-w2")]
    queries = [(i, text(rnd.randint(1, 14))) for i in range(40)] + [(50, "the"), (51, "of the"), (52, "w1-w2"), (53, None), (54, "..."), (55, "nowhere"), (56, "e of"), (57, "the w1 the w2 of nowhere a_b b")]
    rows = spark.createDataFrame([(t,) for _, t in queries] + [(t,) for *_, t in chunks], "t string").select("t", K.words("t").alias("w")).collect()
    tokens = {r["t"]: set(r["w"]) for r in rows}
    want = []
    for qid, q in queries:
        scored = []
        for d, n, t in chunks:
            both = tokens[q] & tokens[t]
            if both:
                score = len(both) / max(6, len(tokens[q])) + (0.5 if q.lower() in t.lower() else 0)
                scored += [(-score, d, n, len(both))] if score >= 0.1 else []
        want += [(qid, rank, d, n, round(-s, 9), overlap) for rank, (s, d, n, overlap) in enumerate(sorted(scored)[:top], 1)]
    got = K.keyword_search(frame(spark, queries, "qid int, q string"), frame(spark, chunks, "d int, n int, t string"), "qid", "q", ["d", "n"], "t", top=top).collect()
    assert sorted((r["qid"], r["rank"], r["d"], r["n"], round(r["score"], 9), r["overlap"]) for r in got) == sorted(want)


def test_frequent_words_bring_no_candidates(spark):
    """5,000 chunks hold a stop word; only those with a rarer word of the query are ever scored."""
    chunks = spark.range(5000).select("id", F.concat(F.lit("the common text "), F.when(F.col("id") % 500 == 0, "rare ring ").otherwise(F.lit("")), F.col("id").cast("string")).alias("t"))
    q = frame(spark, [(1, "the rare ring of common text"), (2, "the ring of")], "qid int, q string")
    seen = []
    original = K.cut_lineage
    try:
        K.cut_lineage = lambda df: (seen.append((df.columns, df.count())), original(df))[1]
        got = K.keyword_search(q, chunks, "qid", "q", ["id"], "t").collect()
    finally:
        K.cut_lineage = original
    assert [r["id"] for r in sorted(got, key=lambda r: (r["qid"], r["rank"]))] == [0, 500, 1000, 1500, 2000] * 2
    assert max(n for columns, n in seen if "q" in columns and "c" in columns) <= 30


def test_fields_cross_lines_and_first_wins(spark):
    df = frame(spark, [(1, "• alpha:\n first text\nbeta - second\nalpha: later\nbeta: colon first")], "d int, text string")
    got = {(r["name"], r["description"]) for r in K.fields(df, ["d"]).collect()}
    assert got == {("alpha", "first text"), ("beta", "colon first")}


@pytest.mark.parametrize("given, want", [
    ("Filter to: ist_ende.notna() & ta_abgang higher than 5", "notna(ist_ende)&ta_abgang>5"),
    ("x greater than or equal to 3", "x>=3"),
    ("status.isin(['b', 'a', 'b'])", "in(status,{a,b})"),
    ("status in {'b','a'} | other is null", "in(status,{a,b})|isna(other)"),
    ("ist_ende.dt.year == 2024", "year(ist_ende)==2024"),
    ("name.str.contains('Ab')", "contains(name,ab)"),
    ("b == 2 & a == 1", "a==1&b==2"),
    ("keep rows (optionally drop x). Optionally sort.", "keep rows ."),
    ("sum of x # comment", "sum of x"),
    ("größe is null", "isna(größe)"),
    ("größe\u00a0is not null", "notna(größe)"),
    ("größe in ['b', 'a']", "in(größe,{a,b})"),
    ("name.str.contains('foo, Bar')", "contains(name,foo, bar)"),
    ("a == 1 & (optional: b == 2) c at most 3.5", "a==1 & c<=3.5".replace(" & ", "&")),
    ("x not equal to 3", "x!=3"),
])
def test_canonical_spelling(spark, given, want):
    assert frame(spark, [(given,)], "s string").select(canonical("s")).first()[0] == want


def test_canonical_sets(spark):
    df = frame(spark, [(["B at least 2", "b >= 2", "none", ""],)], "s array<string>")
    assert df.select(canonical_set("s")).first()[0] == ["b>=2"]


# --- sources ----------------------------------------------------------------------------------

def test_csv_skips_long_lines_and_pads_short_ones(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,x\n1,a,2.5\n2,b\n3,c,1.0,extra\n4,\"d,e\",3.5\n")
    got = readers.read_csv(spark, str(tmp_path / "a.csv")).select("id", "name", "x")
    assert values(got) == [(1, "a", 2.5), (2, "b", None), (4, "d,e", 3.5)]


def test_json_lines_keep_their_line_numbers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"v": 1}\n\n{"v": 2}\n   \n{"v": 3}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "12")
    try:
        got = readers.read_json_lines(spark, str(tmp_path), "v int").select("line_no", "record.v")
        assert values(got) == [(0, 1), (2, 2), (4, 3)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_documents_are_whole_and_hashed(spark, tmp_path):
    (tmp_path / "n.txt").write_text("one\ntwo")
    (tmp_path / "m.md").write_text("# three")
    got = readers.read_documents(spark, str(tmp_path)).collect()
    assert {r["text"] for r in got} == {"one\ntwo", "# three"} and all(len(r["source_id"]) == 64 for r in got)


def test_observed_rows(spark):
    df, seen = V.observed(spark.range(7), "step")
    df.collect()
    assert seen.get["rows"] == 7


def test_no_cap_unless_asked_for(spark):
    groups = frame(spark, [(f"g{i % 25:02d}", float(i)) for i in range(200)], "g string, x double")
    assert N.box_stats(groups, "x", "g").count() == 25 and N.box_stats(groups, "x", "g", high=20).count() == 0
    wide = frame(spark, [tuple(float(i * j % 7) for j in range(1, 13)) for i in range(20)], ", ".join(f"c{j} double" for j in range(1, 13)))
    names = wide.columns
    assert N.summary_cards(wide, names).count() == 12 and N.correlation_matrix(wide, names).count() == 144
    assert len(P.usable_numeric(wide, ids=[])) == 12 and len(P.select_existing(wide, ["none"]).columns) == 12
    keys = frame(spark, [(f"k{i}", "b") for i in range(60)], "k string, time_bucket string")
    counts = frame(spark, [(f"k{i}", "b", i) for i in range(60)], "k string, time_bucket string, n_records long")
    assert {(r["k"], r["n_records"]) for r in V.join_support(keys, counts).collect()} == {(f"k{i}", i) for i in range(60)}
    head = "same opening " * 20
    texts = frame(spark, [(1, "s", head + "a", 2.0), (2, "s", head + "b", 1.0), (3, "s", head + "a", 3.0)], "i int, s string, t string, score double")
    assert K.distinct_snippets(texts, "s", "t", "score", ["i"]).count() == 2
    assert K.distinct_snippets(texts, "s", "t", "score", ["i"], head=120).count() == 1


def test_models_by_name_predict_numbers_and_classes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(modelstore, "shared_folder", lambda _: str(tmp_path))  # a store without models
    rows = [(i, float(i % 10), "red" if i % 3 else "blue", 5.0 * (i % 10) + (3.0 if i % 3 else 40.0), "big" if i % 10 > 4 else "small") for i in range(300)]
    df = frame(spark, rows, "no int, width double, colour string, weight double, size string").drop("no")
    small = {"trees": 8, "depth": 6}
    analyse = lambda family, kind, **kw: ANALYSES[family, kind](df, **kw, **small).collect()
    given = {"width": 9, "colour": "blue"}
    (r,) = analyse("predictive", "regression", target="weight", columns=["width", "colour"], scenario=given)
    assert 70 < r["predicted"] < 90 and r["warnings"] == []
    (c,) = analyse("predictive", "classification", target="size", columns=["width", "colour"], scenario=given)
    assert c["predicted"] == "big"
    cases = {x["case"]: x for x in analyse("prescriptive", "scenario_evaluation", target="weight", columns=["width", "colour"], scenario=given, objective="maximize")}
    assert cases["scenario"]["aligned"] is True
    ranked = analyse("prescriptive", "candidate_ranking", target="weight", columns=["width", "colour"], dimension="colour")
    assert [x["candidate"] for x in ranked] == ["red", "blue"]
    fitted, _ = ML.fit_classification(M.hash_split(df, df.columns), "size", columns=["width", "colour"], **small)
    with pytest.raises(ValueError):
        prescriptive.evaluate_scenario(fitted, given)


# --- one pass over many columns, running totals, bitmaps ---------------------------------------

def test_distinct_values_by_sketch_and_fingerprint(spark):
    df = spark.range(5000).selectExpr("id", "cast(id % 200 AS string) AS few", "cast(id % 201 AS string) AS one_more", "repeat(cast(id AS string), 300) AS text", "id % 2 = 0 AS flag", "cast(NULL AS string) AS none", "CASE WHEN id % 3 = 0 THEN 0.0 WHEN id % 3 = 1 THEN -0.0D END AS zero")
    cols = {c: F.col(c) for c in df.columns}
    assert distinct_up_to(df, cols, 200) == {"few": 200, "flag": 2, "none": 0, "zero": 1}
    got = {r["column"]: (r["n_distinct"], r["n"]) for r in exact_distinct(df, cols).collect()}
    assert got["text"] == (5000, 5000) and got["none"] == (0, 0) and got["one_more"] == (201, 5000) and got["zero"] == (1, 3334)
    plan = A.distinct_counts(df, ["few", "text"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    assert exact_distinct(df.limit(0), {"few": F.col("few")}).first()["n_distinct"] == 0


def test_duplicates_know_where_nulls_are(spark):
    rows = [("a", None, 1, 1), (None, "a", 1, 1), ("a", None, 1, 1), (None, None, 1, 1)]
    df = frame(spark, rows, "a string, b string, c int, d int")
    assert C.duplicate_share(df, df.columns).first()["n_duplicates"] == 1 and C.duplicate_share(df, ["a", "b"]).first()["n_duplicates"] == 1


def test_running_totals_over_many_ranges(spark):
    """No task holds all rows: ranges of a hundred thousand rows, with ties in the values and nulls that count as zero."""
    df = spark.range(100_000).selectExpr("id", "(id * 7919) % 100003 AS k", "CASE WHEN id % 10 = 0 THEN NULL ELSE cast(id % 13 AS double) END AS v")
    out = running(df, [F.col("k")], {"total": "v"}, number="place")
    rows = sorted((r["k"], r["v"] or 0.0, r["total"], r["place"]) for r in out.collect())
    want = np.cumsum([r[1] for r in rows])
    assert [r[3] for r in rows] == list(range(1, 100_001)) and np.allclose([r[2] for r in rows], want)
    assert out.columns == ["id", "k", "v", "total", "place"] and running(df.limit(0), [F.col("k")], {"t": "v"}).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan


def test_missing_ids_over_more_groups_than_one_bitmap(spark, monkeypatch):
    groups = spark.range(40_000).select((F.col("id") + 1).alias("g"))
    full = groups.select("g", F.lit("whole").alias("k"))
    gaps = groups.filter("g not in (1, 8, 32768, 32769, 39999)").select("g", F.lit("gaps").alias("k"))
    late = groups.filter("g > 32768 and g <= 39990").select("g", F.lit("late").alias("k"))
    got = U.missing_ids(full.unionByName(gaps).unionByName(late).unionByName(gaps.limit(5)), "g", "k")
    by = {r["k"]: r for r in got.groupBy("k").agg(F.count("g").alias("n"), F.min("g").alias("lo"), F.max("g").alias("hi")).collect()}
    assert sorted(r["g"] for r in got.filter("k = 'gaps'").collect()) == [1, 8, 32768, 32769, 39999]
    assert (by["late"]["n"], by["late"]["lo"], by["late"]["hi"]) == (32_768 + 10, 1, 40_000) and "whole" not in by
    few = frame(spark, [("a", 1), (None, 1), (None, 2), ("b", None)], "g string, k int")
    assert values(U.missing_ids(few, "g", "k")) == sorted([("a", 2), ("b", 1), ("b", 2)], key=str)


def test_named_dimensions_stay_whatever_their_levels(spark):
    df = frame(spark, [(f"g{i % 40}", f"h{i % 5}", float(i % 7)) for i in range(400)], "g string, h string, y double")
    out = G.variance_decomposition(df, "y", ["g", "h"])
    assert {r["dimension"] for r in out.collect()} == {"g", "h"} and out.filter("dimension = 'g'").count() == 40
    lifts = G.categorical_lifts(df, "y", ["g"], k=None, max_levels=None)
    assert lifts.count() == 40
    assert {r["dimension"] for r in G.variance_decomposition(df, "y").collect()} == {"h"}
    with pytest.raises(ValueError, match="group by"):
        G.variance_decomposition(df.select("y"), "y")


def test_trend_statistics_of_groups_and_nothing(spark):
    rows = [("a", 3, 1.0), ("a", 1, 5.0), (None, 2, 7.0), ("b", 1, None), ("a", None, 9.0)]
    df = frame(spark, rows, "g string, d int, y double").withColumn("t", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(d)"))
    got = {(r["scope"], r["series"]): r for r in W.trend_stats(df, "t", "y", ["g"]).collect()}
    assert set(got) == {("global", "(all)"), ("group", "a"), ("group", "(missing)")}
    a, whole = got["group", "a"], got["global", "(all)"]
    assert (a["start"], a["end"], a["delta"], a["mean"], a["median"]) == (5.0, 1.0, -4.0, 3.0, 3.0)
    assert whole["n_points"] == 3 and whole["start"] == 5.0 and whole["max"] == 7.0 and whole["median"] == 5.0
    none = W.trend_stats(df.limit(0), "t", "y").first()
    assert none["n_points"] == 0 and none["mean"] is None and none["median"] is None


def test_closing_line_is_a_warning_or_a_follow_up(spark):
    texts = frame(spark, [(1, "Most parts were late", ["Delays reach 9 days"]), (2, None, None), (3, "All fine", []), (4, "Sales rise", [])], "d int, summary string, chosen array<string>")
    warnings = [(1, 0, "Duplicates were found"), (1, 1, "Delays reach 12 days"), (1, 2, "never seen"), (2, 0, "No summary, no warning"), (3, 0, " "), (4, 0, "Few rows in March")]
    followups = [(1, 0, "Check this."), (1, 1, "Compare the two plants"), (2, 0, "Investigate it"), (3, 0, "all  FINE"), (3, 1, "look into it"), (4, 0, "Split by region")]
    out = K.pick_closing(texts, frame(spark, warnings, "d int, p int, s string"), frame(spark, followups, "d int, p int, s string"), "d", "s", "p")
    assert values(out) == sorted([(1, "followup", "Compare the two plants"), (2, "followup", "Investigate it"), (4, "warning", "Few rows in March")], key=str)


def test_relationships_choose_a_view(spark):
    df = frame(spark, [(float(i), float(i % 7), float(i * i), "ab"[i % 2], "xyz"[i % 3]) for i in range(60)], "p double, q double, r double, s string, t string")
    run = lambda cols, **kw: ANALYSES["descriptive", "relationships"](df.select(*cols), **kw)
    assert "n_pairs" in run(["p", "q"]).columns and run(["p", "q", "r"]).count() == 9 and "n_pairs" in run(["p", "q", "r"], mode="pair").columns
    assert run(["s", "t"]).columns == ["a", "b", "n", "share"]
    with pytest.raises(ValueError):
        run(["p", "s"])


@pytest.mark.parametrize("text, unit, label", [
    ("Time spent (in  days )", "days", "Time spent"),
    ("Time (IN working hours) per case", "working hours", "Time  per case"),
    ("Waiting (at the gate) time (h)", None, "Waiting"),
    ("Speed (in km/h)", None, "Speed"),
    ("a minute of rest", "minutes", "a minute of rest"),
    ("Share ()", None, "Share ()"),
    ("(in days)", "days", None),
    ("Length (in\u00a0days) of a (b) c", "days", "Length  of a (b) c"),
    ("Lauf (in", None, "Lauf (in"),
])
def test_units_and_labels_of_descriptions(spark, text, unit, label):
    row = frame(spark, [(text,)], "t string").select(X.unit_from_description("t").alias("u"), X.label_from_description("t").alias("l")).first()
    assert (row["u"], row["l"]) == (unit, label)


def test_spaces_and_digits_of_any_script(spark):
    row = frame(spark, [("A\u00a0 b\u2003-3.5 \u0663\u0664 x1y",)], "t string").select(number_free("t").alias("n"), content_words("t").alias("w")).first()
    assert row["n"] == "a b # # x#y" and row["w"] == ["x#y"]

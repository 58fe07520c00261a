"""Steps that must not grow with the table: what is shuffled, how often input is read, what one task holds."""

from __future__ import annotations

import re

import pytest


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture
def no_size_checks(spark):
    """Joins as with tables too large for Spark's own broadcasts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_near_duplicates_shuffle_no_whole_texts(spark):
    from tabulon.operators.textops import near_duplicates

    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    texts = [(1, " ".join(words[:50])), (2, " ".join(words[:49] + words[55:56])), (3, " ".join(words[:50])), (4, "so " + " ".join(words[:50]) + " on"), (5, "other text here")]
    found = near_duplicates(spark.createDataFrame(texts, "id int, t string"), "id", "t")
    got = {(r["kind"], r["left_id"], r["right_id"]) for r in found.collect()}
    assert got == {("copy", 1, 3), ("words", 1, 4), ("similar", 1, 2), ("inside", 1, 4)}
    assert not re.search(r"hashpartitioning\((form|w|token|key)#", plan_of(found))


def test_near_duplicates_by_shuffle_and_by_sent_ids_are_the_same(spark, monkeypatch):
    """Only forms in a pair meet; beyond the limits of what is sent, and with parts that say nothing, rows stay the same."""
    from tabulon.operators import textops

    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    texts = [(i, " ".join(words[:50 + i % 3] + words[60 + i:62 + i])) for i in range(20)] + [(30, "so " + " ".join(words[10:40]) + " on"), (31, " ".join(words[5:45])), (32, "wab"), (33, "WAB"), (34, " ".join(words[:9])), (35, None)]
    df = spark.createDataFrame(texts, "id int, t string")

    def found():
        return sorted(tuple(r) for r in textops.near_duplicates(df, "id", "t").collect())

    met = []
    original = textops._texts_met
    monkeypatch.setattr(textops, "_texts_met", lambda pairs, forms: (met.append(pairs.count()), original(pairs, forms))[1])
    want = found()
    assert {r[0] for r in want} == {"copy", "similar", "inside"} and len(want) > 100 and max(met) < 400
    monkeypatch.setattr(textops, "SENT_IDS", 0)
    monkeypatch.setattr(textops, "MOST_IN_PART", 1)
    assert found() == want


def test_canonical_reads_its_text_once(spark):
    from tabulon.functions.expressions import canonical

    df = spark.createDataFrame([("Filter to: a is null & b at least 3 (optional: c) # d",), ("Optionally drop e. f > 2",), ("optionals > 1",)], "t string")
    out = df.select(canonical("t").alias("c"))
    assert [r["c"] for r in out.collect()] == ["b>=3&isna(a)", "f>2", "optionals>1"]
    assert out._jdf.queryExecution().analyzed().toString().count("optional") <= 4


def test_pairs_are_normalised_once(spark):
    from pyspark.sql import functions as F

    from tabulon.operators.textops import too_similar

    df = spark.createDataFrame([("Sales rose by 3 in May", "sales rose by 4 in may"), ("red green blue", "blue green red"), ("one thing", "another matter"), (None, "x"), ("", "")], "a string, b string")
    out = df.select(too_similar(F.col("a"), F.col("b")).alias("s"))
    assert [r["s"] for r in out.collect()] == [True, True, False, False, False]
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 4


def test_box_stats_send_their_quartiles(spark, no_size_checks):
    from tabulon.operators.descriptive import box_stats

    out = box_stats(spark.range(200).selectExpr("concat('g', id % 2) AS g", "cast(id AS double) AS x"), "x", "g")
    assert {(r["group"], r["n"], r["median"]) for r in out.collect()} == {("g0", 100, 99.0), ("g1", 100, 100.0)}
    assert "BroadcastHashJoin" in plan_of(out) and "SortMergeJoin" not in plan_of(out)


def test_decision_table_makes_its_input_once(spark):
    from tabulon.operators.prescriptive import decision_table

    df = spark.range(400).selectExpr("cast(id % 40 AS double) AS y", "cast(id % 40 AS double) * 2 AS x", "concat('d', id % 4) AS d", "'unused' AS u")
    out = decision_table(df, "y", columns=["x"], dims=["d"])
    rows = out.collect()
    assert [(r["kind"], r["feature"], r["n"]) for r in rows if r["kind"] == "numeric"] == [("numeric", "x", 400.0)] and len(rows) == 5
    assert "Range" not in plan_of(out)
    assert not spark.sparkContext._jsc.sc().getPersistentRDDs().size()


def test_forecast_sums_its_series_once(spark, monkeypatch, tmp_path):
    from tabulon.operators import modelstore, predictive

    monkeypatch.setattr(modelstore, "shared_folder", lambda _: str(tmp_path))
    raw = spark.range(400).selectExpr("'a' AS k", "timestamp'2020-01-06' + make_interval(0, 0, id % 80) AS t", "cast(id % 80 AS double) AS v")
    series = raw.groupBy("k", "t").agg({"v": "sum"}).withColumnRenamed("sum(v)", "y")
    out = predictive.forecast(series, ["k"], "week", 2, trees=3, depth=2)
    assert out.points.count() == 2 and "Range" not in plan_of(out.points)


def test_rows_of_few_classes_are_dealt_out(spark):
    """All rows of a class meet in one partition after a join by class."""
    from tabulon.session import dealt

    met = spark.range(0, 4000, 1, 8).repartition(20, "id").selectExpr("id % 2 AS c").repartition(20, "c").persist()
    sizes = [n for n in dealt(met, 500).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 600
    assert dealt(met, 4000).rdd.getNumPartitions() == 20
    met.unpersist()


def test_a_fit_keeps_no_nodes_per_row_and_bounds_its_tasks(spark):
    from tabulon.operators.predictive import forest_options
    from tabulon.session import dealt

    assert not forest_options(None, 400, 10)["cacheNodeIds"]
    assert dealt(spark.range(0, 1000, 1, 8), 10).rdd.getNumPartitions() == 100


def test_variants_of_a_task_are_bounded(spark, monkeypatch):
    from tabulon.operators import evaluation

    monkeypatch.setattr(evaluation, "TASK_ROWS", 10, raising=False)
    variants = spark.range(500).selectExpr("id % 100 AS k", "id % 3 AS c")
    out = evaluation.component_matches(variants, spark.range(100).selectExpr("id AS k", "id % 3 AS c"), ["k"], ["c"])
    assert out.count() == 500 and "REPARTITION_BY_NUM" in plan_of(out)

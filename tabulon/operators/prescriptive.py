"""Scenarios, candidate ranking and decision tables: M8-M11."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions import roles
from tabulon.functions.numbers import one_row
from tabulon.operators.aggregate import number_stats
from tabulon.operators.diagnostic import categorical_lifts, numeric_effects
from tabulon.operators.features import candidate_list, scenario_rows
from tabulon.operators.modelstore import array_mean, array_quantile, flat_trees, tree_values
from tabulon.operators.predictive import Fitted
from tabulon.session import cut_lineage


def score_rows(fitted: Fitted, rows: DataFrame) -> DataFrame:
    return fitted.model.transform(fitted.stages.transform(rows))


def predict_scenario(fitted: Fitted, scenario: dict) -> DataFrame:
    """M3, M4: what the model says of one set of given inputs: a number, or the class by name; with warnings."""
    known = {c: v for c, v in scenario.items() if c in fitted.spec.columns}
    given = fitted.holdout.sparkSession.range(1).select(F.lit("scenario").alias("case"), *[F.lit(str(v)).alias(c) for c, v in known.items()])
    scored = score_rows(fitted, scenario_rows(given, fitted.spec))
    said = F.col("prediction")
    if fitted.labels is not None:
        said = F.element_at(F.array(*[F.lit(v) for v in fitted.labels]), said.cast("int") + 1)
    return scored.select(said.alias("predicted"), "warnings")


def predict_spread(fitted: Fitted, rows: DataFrame, name: str) -> DataFrame:
    """M8: mean, p10 and p90 of the single trees per scenario row, from the forest's nodes as arrays."""
    trees = one_row(flat_trees(fitted.nodes))["trees"]
    vectors = fitted.stages.transform(rows).select(name, vector_to_array("features").alias("x")).withColumn("trees", trees)
    values = vectors.select(name, F.array_sort(tree_values(F.col("trees"), fitted.depth, F.col("x"))).alias("v"))
    return values.select(name, array_mean(F.col("v")).alias("mean"), array_quantile(F.col("v"), 0.1).alias("p10"), array_quantile(F.col("v"), 0.9).alias("p90"))


def evaluate_scenario(fitted: Fitted, scenario: dict, objective: str = "minimize") -> DataFrame:
    """M8: baseline and scenario predictions with spread, their difference, and whether it helps."""
    if fitted.labels is not None:
        raise ValueError("classes have no mean to compare; use predict_scenario")
    spark = fitted.holdout.sparkSession
    known = {c: v for c, v in scenario.items() if c in fitted.spec.columns}
    one = spark.range(1)
    base = scenario_rows(one.select(F.lit("baseline").alias("case")), fitted.spec)
    scen = scenario_rows(one.select(F.lit("scenario").alias("case"), *[F.lit(str(v)).alias(c) for c, v in known.items()]), fitted.spec)
    rows = base.unionByName(scen)
    spread = predict_spread(fitted, rows.drop("warnings"), "case")
    b = one_row(spread.filter("case = 'baseline'").select("mean"))["mean"]
    delta = F.col("mean") - b
    better = {"minimize": delta < 0, "maximize": delta > 0}.get(objective, F.lit(None).cast("boolean"))
    return spread.join(rows.select("case", "warnings"), "case").select(
        "case", "mean", "p10", "p90", delta.alias("delta"), F.when(F.col("case") == "scenario", better).alias("aligned"), "warnings"
    )


def rank_candidates(df: DataFrame, fitted: Fitted, dimension: str, scenario: dict | None = None, objective: str = "minimize") -> DataFrame:
    """M9: every candidate level scored under the fixed scenario in one transform, ranked by direction."""
    fixed = {c: v for c, v in (scenario or {}).items() if c in fitted.spec.columns and c != dimension}
    cand = candidate_list(df, dimension)
    overrides = cand.select(
        "candidate", "n_obs", F.col("candidate").alias(dimension), *[F.lit(str(v)).alias(c) for c, v in fixed.items()]
    )
    scored = score_rows(fitted, scenario_rows(overrides, fitted.spec)).select("candidate", F.col("prediction").alias("predicted"), "n_obs")
    order = F.col("predicted").desc() if objective == "maximize" else F.col("predicted").asc()
    return scored.orderBy(order, "candidate")


def suggestion(effect: Column, objective: str) -> Column:
    """Which way to push a driver."""
    up, down = {"minimize": ("decrease", "increase"), "maximize": ("increase", "decrease")}.get(
        objective, ("push opposite of KPI increase", "push opposite of KPI increase")
    )
    return F.when(effect > 0, F.lit(up)).when(effect < 0, F.lit(down)).otherwise(F.lit("no clear direction"))


def decision_baseline(df: DataFrame, y: str) -> DataFrame:
    """N, mean, median, p10, p90, min, max of the metric."""
    s = number_stats(df, [y], [0.1, 0.5, 0.9])
    q = F.col(f"{y}__q")
    return s.select(
        F.col(f"{y}__n").alias("n"), F.col(f"{y}__mean").alias("mean"), q[1].alias("median"), q[0].alias("p10"), q[2].alias("p90"),
        F.col(f"{y}__min").alias("min"), F.col(f"{y}__max").alias("max"),
    )


def decision_table(df: DataFrame, y: str, objective: str = "minimize", columns: list[str] | None = None, dims: list[str] | None = None, ids: list[str] | None = None, n_numeric: int | None = 6, n_labels: int | None = 8) -> DataFrame:
    """The strongest numeric and label drivers (None: all) with a direction and a suggestion.

    The columns that are looked at are kept for the passes over them, so what makes ``df`` runs once; both tables are made
    when this is called.
    """
    if columns and dims:
        used = {y, *columns, *dims, roles.support_column(df)}
        df = df.select(*[F.col(f"`{c}`") for c in df.columns if c in used])
    df = df.persist()
    try:
        num = cut_lineage(numeric_effects(df, y, columns, ids, n_numeric).select(
            F.lit("numeric").alias("kind"), "feature", F.lit(None).cast("string").alias("value"), "effect", F.col("n").cast("double").alias("n")
        ))
        cat = cut_lineage(categorical_lifts(df, y, dims, ids, n_labels).select(
            F.lit("categorical").alias("kind"), "feature", "value", F.col("lift").alias("effect"), "n"
        ))
    finally:
        df.unpersist()
    e = F.col("effect")
    direction = F.when(e > 0, F.lit("positive")).when(e < 0, F.lit("negative")).otherwise(F.lit("zero"))
    return num.unionByName(cat).withColumn("direction", direction).withColumn("suggested_change", suggestion(e, objective))

"""Analyses and steps by name: Z3, Z4, and the flagship trend."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tabulon.operators import clean, columns, descriptive, diagnostic, features, predictive, prescriptive, series
from tabulon.operators.aggregate import Metric, Plan, aggregate
from tabulon.operators.predicates import Condition, where_guarded


def _regression(df: DataFrame, target: str, **options) -> predictive.Fitted:
    return predictive.fit_regression(features.hash_split(df, df.columns), target, **options)


def regression(df: DataFrame, target: str, scenario: dict | None = None, **options) -> DataFrame:
    """The prediction for given inputs, or without any the scores on the held-out rows."""
    fitted = _regression(df, target, **options)
    return fitted.metrics if scenario is None else prescriptive.predict_scenario(fitted, scenario)


def classification(df: DataFrame, target: str, scenario: dict | None = None, **options) -> DataFrame:
    """The class for given inputs, or without any the scores on the held-out rows."""
    fitted, _ = predictive.fit_classification(features.hash_split(df, df.columns), target, **options)
    return fitted.metrics if scenario is None else prescriptive.predict_scenario(fitted, scenario)


def scenario_evaluation(df: DataFrame, target: str, scenario: dict, objective: str = "minimize", **options) -> DataFrame:
    return prescriptive.evaluate_scenario(_regression(df, target, **options), scenario, objective)


def candidate_ranking(df: DataFrame, target: str, dimension: str | None = None, scenario: dict | None = None, objective: str = "minimize", **options) -> DataFrame:
    dimension = dimension or columns.choose_dimension(df, target)
    return prescriptive.rank_candidates(df, _regression(df, target, **options), dimension, scenario, objective)


def relationships(df: DataFrame, mode: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """The first view that the columns allow: two numeric ones as a scatter, more as correlations, else two label columns.

    ``mode`` asks for ``pair`` (a scatter of the first two numeric columns) or ``matrix``; one that doesn't fit is ignored.
    """
    numeric = columns.usable_numeric(df, ids)
    if len(numeric) >= 2 and (mode == "pair" or len(numeric) == 2):
        return descriptive.scatter_stats(df, numeric[0], numeric[1])
    if len(numeric) >= 3:
        return descriptive.correlation_matrix(df, numeric)
    labels = columns.usable_labels(df, ids)
    if len(labels) >= 2:
        return descriptive.crosstab(df, labels[0], labels[1])
    raise ValueError("relationships need two numeric columns or two label columns")


# Z3: (family, type) -> function(df, **arguments) -> DataFrame.
ANALYSES: dict[tuple[str, str], Callable[..., DataFrame]] = {
    ("descriptive", "distribution"): descriptive.histogram,
    ("descriptive", "box"): descriptive.box_stats,
    ("descriptive", "composition"): descriptive.composition,
    ("descriptive", "stats_summary"): descriptive.summary_cards,
    ("descriptive", "group_compare"): descriptive.group_compare,
    ("descriptive", "trend"): series.trend_stats,
    ("descriptive", "relationships"): relationships,
    ("descriptive", "correlation"): descriptive.correlation_matrix,
    ("descriptive", "scatter"): descriptive.scatter_stats,
    ("descriptive", "crosstab"): descriptive.crosstab,
    ("diagnostic", "anomaly_explanation"): lambda df, y, mode="both", dims=None: diagnostic.categorical_contrast(
        diagnostic.flag_outliers(df, y, mode), y, dims
    ),
    ("diagnostic", "numeric_drivers"): diagnostic.numeric_effects,
    ("diagnostic", "driver_relationships"): diagnostic.categorical_lifts,
    ("diagnostic", "variance_decomposition"): lambda df, y, dims=None: diagnostic.pareto(
        diagnostic.variance_decomposition(df, y, dims)
    ),
    ("predictive", "regression"): regression,
    ("predictive", "classification"): classification,
    ("predictive", "forecasting"): lambda df, keys, grain, horizon, **options: predictive.forecast(df, keys, grain, horizon, **options).points,
    ("prescriptive", "scenario_evaluation"): scenario_evaluation,
    ("prescriptive", "candidate_ranking"): candidate_ranking,
    ("prescriptive", "decision_formulation"): prescriptive.decision_table,
}


def analyse(df: DataFrame, family: str, kind: str, **arguments) -> DataFrame:
    """Z3: one analysis by name."""
    return ANALYSES[(family, kind)](df, **arguments)


# Step name -> function(df, **arguments) -> DataFrame, all lazy but for the guards' own counts.
STEPS: dict[str, Callable[..., DataFrame]] = {
    "filters": lambda df, conditions=(): where_guarded(df, list(conditions))[0],
    "columns": lambda df, names=(): columns.select_existing(df, list(names)),
    "prepare": lambda df, actions=(): clean.prepare(df, list(actions)),
    "aggregate": lambda df, plan=None: aggregate(df, plan) if plan else df,
    "analyze": lambda df, family, kind, **kw: analyse(df, family, kind, **kw),
}


def run_steps(df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """A chain of named steps as one lazy plan."""
    for name, arguments in steps:
        df = df.transform(STEPS[name], **arguments)
    return df


def monthly_price_by_flag(lineitem: DataFrame) -> DataFrame:
    """The flagship: average extended price per month and return flag with support, filtered."""
    return run_steps(lineitem, [
        ("filters", {"conditions": [Condition("l_discount", ">=", 0.02)]}),
        ("aggregate", {"plan": Plan(
            groups=["l_returnflag"], metrics=[Metric("mean_l_extendedprice", "l_extendedprice", "mean")],
            time_column="l_shipdate", grain="month",
        )}),
    ])

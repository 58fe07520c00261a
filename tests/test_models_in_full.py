"""The registered model queries fit the operators' own forests."""

from __future__ import annotations

import pytest

from tabulon.operators import modelstore, predictive
from tabulon.plans.catalog import QUERIES
from tests.test_catalog import FOLDER

MODELS = [
    "m3_regression", "m4_classification", "m4_class_metrics", "m5_forecast", "m5_forecast_holdout", "m6_importances",
    "m8_scenario_evaluation", "m9_candidate_ranking", "m12_holdout_line",
]


class Asked(Exception):
    pass


@pytest.mark.parametrize("name", MODELS)
def test_forest_is_whole(spark, monkeypatch, tmp_path, name):
    monkeypatch.setattr(modelstore, "shared_folder", lambda _: str(tmp_path))  # a store without models

    def forest(**options):
        raise Asked(options["numTrees"], options["maxDepth"])

    monkeypatch.setattr(predictive, "RandomForestRegressor", forest)
    monkeypatch.setattr(predictive, "RandomForestClassifier", forest)
    with pytest.raises(Asked) as asked:
        QUERIES[name](spark, FOLDER)
    assert asked.value.args == (400, 10)


def test_one_fit_serves_all_its_queries(spark, monkeypatch, tmp_path):
    """Five queries on one model fit it once; other rows or settings are other models; a fit that raises stores nothing."""
    monkeypatch.setattr(modelstore, "shared_folder", lambda _: str(tmp_path))
    fits = []
    original = predictive.RandomForestRegressor

    def forest(**options):
        fits.append(options["numTrees"])
        return original(**{**options, "numTrees": 5, "maxDepth": 3})

    monkeypatch.setattr(predictive, "RandomForestRegressor", forest)
    first = QUERIES["m3_regression"](spark, FOLDER).collect()
    for name in ("m6_importances", "m8_scenario_evaluation", "m9_candidate_ranking", "m12_holdout_line"):
        assert QUERIES[name](spark, FOLDER).count() > 0
    assert fits == [400] and QUERIES["m3_regression"](spark, FOLDER).collect() == first
    df = spark.range(200).selectExpr("id", "id % 7 AS a", "id % 5 AS b", "cast(id % 11 AS double) AS y", "id % 4 > 0 AS is_train")
    for rows, depth in ((df, 3), (df.repartition(3), 3), (df.where("id > 5"), 3), (df, 2)):
        predictive.fit_regression(rows, "y", columns=["a", "b"], depth=depth)
    assert len(fits) == 4  # the partitions of the same rows make no difference
    with pytest.raises(ValueError, match="at least"):
        predictive.fit_regression(df.limit(20), "y", columns=["a", "b"])
    assert not spark.sparkContext._jsc.sc().getPersistentRDDs().size()


def test_classes_are_scored_after_an_observation(spark, monkeypatch, tmp_path):
    """An observation in the session makes the session unfit for tasks; the model must not bring it along."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation("seen")
    spark.range(10).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 10
    monkeypatch.setattr(modelstore, "shared_folder", lambda _: str(tmp_path))
    df = spark.range(200).selectExpr("id % 7 AS a", "id % 5 AS b", "CASE WHEN id % 7 > 3 THEN 'x' ELSE 'y' END AS c", "id % 4 > 0 AS is_train")
    fitted, confusion = predictive.fit_classification(df, "c", columns=["a", "b"], trees=5, depth=3)
    assert fitted.metrics.first()["accuracy"] == 1.0 and confusion.count() == 4


def test_flat_trees_give_what_the_model_gives(spark, monkeypatch, tmp_path):
    """Splits by threshold and by category; the mean over trees is the model's prediction."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    from tabulon.functions.numbers import one_row
    from tabulon.operators.features import apply_features

    monkeypatch.setattr(modelstore, "shared_folder", lambda _: str(tmp_path))
    df = spark.range(400).selectExpr("id", "id % 37 AS a", "concat('k', id % 9) AS c", "cast((id % 37) * (id % 9 % 3) AS double) AS y", "id % 5 > 0 AS is_train")
    fitted = predictive.fit_regression(df, "y", columns=["a", "c"], trees=20, depth=6)
    rows = fitted.model.transform(fitted.stages.transform(apply_features(df, fitted.spec)))
    trees = one_row(modelstore.flat_trees(fitted.nodes))["trees"]
    own = rows.withColumn("trees", trees).select("prediction", modelstore.array_mean(modelstore.tree_values(F.col("trees"), 6, vector_to_array("features"))).alias("flat"))
    assert own.where(F.abs(F.col("prediction") - F.col("flat")) > 1e-9).count() == 0 and own.count() == 400

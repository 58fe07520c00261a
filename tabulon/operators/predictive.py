"""Models and forecasts on Spark ML: M3-M6, M12."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulon.functions.numbers import at_most, number, one_row, ratio
from tabulon.operators.features import OTHER, FeatureSpec, apply_features, learn_features, rare_classes_merged
from tabulon.operators.forest import RandomForestClassifier, RandomForestRegressor
from tabulon.operators.modelstore import array_mean, digest, fit_once, flat_trees, tree_values
from tabulon.operators.series import (
    LAGS, WINDOWS, _step, chronological_split, feature_names, recent_slope, supervised,
)
from tabulon.operators.aggregate import bucket_start
from tabulon.session import cut_lineage, dealt

TREES, MIN_LEAF, SEED = 400, 2, 42
MAX_CLASSES = 100
MIN_ROWS, MIN_FEATURES = 80, 2
MIN_POINTS, MIN_USABLE = 30, 25
#: Memory in MB for the statistics of the nodes that one pass over the rows splits.
NODE_MEMORY = 512
#: Rows that one task of a fit reads in each pass, of about 2 KB each for 400 trees.
TASK_ROWS = 400_000


@dataclass
class Fitted:
    """A model with the stages that feed it and its results as tables."""

    model: object
    stages: PipelineModel
    spec: FeatureSpec
    metrics: DataFrame
    importances: DataFrame
    holdout: DataFrame
    nodes: DataFrame
    depth: int
    labels: list[str] | None = None


def feature_stages(spark, spec: FeatureSpec) -> PipelineModel:
    """Label columns as indices over their known levels (no fitting pass), all features as a vector."""
    stages = []
    inputs = [f"`{c}`" if "." in c else c for c in spec.numeric]
    for c, levels in spec.levels.items():
        known = list(dict.fromkeys([*levels, OTHER]))
        stages.append(StringIndexerModel.from_labels(known, inputCol=c, outputCol=f"__i_{c}", handleInvalid="keep"))
        inputs.append(f"__i_{c}")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return PipelineModel(stages)


def forest_options(spec: FeatureSpec | None, trees: int, depth: int) -> dict:
    """Options common to all forests; as many bins as the column of most levels needs.

    The node that a row has reached in each tree is found anew in each pass: kept, it would double what is stored per row
    and be written to the checkpoint folder.
    """
    levels = max((len(v) for v in spec.levels.values()), default=0) if spec else 0
    return {
        "numTrees": trees, "minInstancesPerNode": MIN_LEAF, "maxDepth": depth, "seed": SEED,
        "maxBins": max(32, levels + 2), "maxMemoryInMB": NODE_MEMORY, "cacheNodeIds": False,
    }


def _spec_facts(spec: FeatureSpec) -> dict:
    return {"numeric": spec.numeric, "levels": spec.levels}


def raw_importances(spark, model, spec: FeatureSpec, k: int | None = 10) -> DataFrame:
    """M6: importance per raw column; one row per feature, so at most as many as columns."""
    values = model.featureImportances.toArray().tolist()
    rows = list(zip(spec.columns, [float(v) for v in values]))
    out = spark.createDataFrame(rows, "feature string, importance double")
    return at_most(out.groupBy("feature").agg(F.sum("importance").alias("importance")).orderBy(F.col("importance").desc(), "feature"), k)


def _ready(df: DataFrame, spec: FeatureSpec, enough: int) -> None:
    if len(spec.columns) < MIN_FEATURES or enough < MIN_ROWS:
        raise ValueError(f"needs at least {MIN_ROWS} rows and {MIN_FEATURES} features")


def regression_metrics(scored: DataFrame, actual: str, predicted: str = "prediction") -> DataFrame:
    """MAE, RMSE and R2 from one pass."""
    y, p = F.col(actual), F.col(predicted)
    s = scored.agg(
        F.count(F.lit(1)).alias("n_test"), F.avg(F.abs(y - p)).alias("mae"), F.avg((y - p) * (y - p)).alias("mse"), F.var_pop(y).alias("var"),
    )
    return s.select("n_test", "mae", F.sqrt("mse").alias("rmse"), (1 - F.try_divide(F.col("mse"), F.col("var"))).alias("r2"))


def fit_regression(df: DataFrame, target: str, split: DataFrame | None = None, columns: list[str] | None = None, ids: list[str] | None = None, trees: int = TREES, depth: int = 10) -> Fitted:
    """M3, M6: random forest on M1 features, trained where ``is_train``, scored on the rest.

    ``df`` carries ``is_train`` (M2). The features are fixed once and reused for both parts. Rows are read once; a model of
    the same rows and settings is taken from the store.
    """
    spark = df.sparkSession
    y = number(df, target)
    used = [c for c in df.columns if columns is None or c in (*columns, target, "is_train")]
    base = df.filter(y.isNotNull()).withColumn(target, y).select(*[F.col(f"`{c}`") for c in used]).persist()
    try:
        def fit(keep):
            spec = learn_features(base.drop("is_train"), target, columns, ids)
            stages = feature_stages(spark, spec)
            table = stages.transform(apply_features(dealt(base, TASK_ROWS), spec)).select("features", target, "is_train").persist()
            try:
                sizes = table.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_train").alias("n_train")).first()
                _ready(df, spec, sizes["n"])
                forest = RandomForestRegressor(labelCol=target, featureSubsetStrategy="all", **forest_options(spec, trees, depth))
                model = keep(forest.fit(table.filter("is_train")))
                scored = cut_lineage(model.transform(table.filter("not is_train")).select(F.col(target).alias("actual"), "prediction"))
            finally:
                table.unpersist()
            return stages, scored, {"spec": _spec_facts(spec), "n_train": sizes["n_train"]}

        key = digest(base, {"kind": "regression", "target": target, "columns": columns, "ids": ids, "trees": trees, "depth": depth})
        kept = fit_once(spark, key, RandomForestRegressionModel, fit)
    finally:
        base.unpersist()
    spec = FeatureSpec(**kept.facts["spec"])
    metrics = regression_metrics(kept.holdout, "actual").withColumn("n_train", F.lit(kept.facts["n_train"]))
    return Fitted(kept.model, kept.stages, spec, metrics, raw_importances(spark, kept.model, spec), kept.holdout, kept.nodes, depth)


def fit_line(holdout: DataFrame) -> DataFrame:
    """Predicted as a line of actual."""
    return holdout.agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("prediction", "actual").alias("slope"), F.regr_intercept("prediction", "actual").alias("intercept")
    )


def fit_classification(df: DataFrame, target: str, columns: list[str] | None = None, ids: list[str] | None = None, trees: int = TREES, depth: int = 10) -> tuple[Fitted, DataFrame]:
    """M4: balanced random forest; the second result is the confusion matrix with row shares."""
    spark = df.sparkSession
    used = [c for c in df.columns if columns is None or c in (*columns, target, "is_train")]
    base = rare_classes_merged(df, target).select(*[F.col(f"`{c}`") for c in used]).persist()
    try:
        def fit(keep):
            spec = learn_features(base.drop("is_train"), target, columns, ids)
            indexer = StringIndexer(inputCol=target, outputCol="__label", stringOrderType="frequencyDesc").fit(base)
            labels = indexer.labels
            if not 2 <= len(labels) <= MAX_CLASSES:
                raise ValueError(f"{target} needs 2 to {MAX_CLASSES} stable classes, has {len(labels)}")
            stages = feature_stages(spark, spec)
            table = stages.transform(apply_features(indexer.transform(dealt(base, TASK_ROWS)), spec)).select("features", "__label", "is_train").persist()
            try:
                sizes = table.filter("is_train").groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per class
                total = sum(r["n"] for r in sizes)
                weight = F.lit(1.0)
                for r in sizes:
                    weight = F.when(F.col("__label") == r["__label"], F.lit(total / (len(sizes) * r["n"]))).otherwise(weight)
                forest = RandomForestClassifier(labelCol="__label", weightCol="__weight", **forest_options(spec, trees, depth))
                model = keep(forest.fit(table.filter("is_train").withColumn("__weight", weight)))
                names = F.array(*[F.lit(v) for v in labels])
                scored = cut_lineage(model.transform(table.filter("not is_train")).select(
                    F.element_at(names, F.col("__label").cast("int") + 1).alias("actual"), F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"),
                ))
            finally:
                table.unpersist()
            return stages, scored, {"spec": _spec_facts(spec), "labels": list(labels)}

        key = digest(base, {"kind": "classification", "target": target, "columns": columns, "ids": ids, "trees": trees, "depth": depth})
        kept = fit_once(spark, key, RandomForestClassificationModel, fit)
    finally:
        base.unpersist()
    spec, labels = FeatureSpec(**kept.facts["spec"]), kept.facts["labels"]
    confusion = confusion_matrix(kept.holdout, labels)
    return Fitted(kept.model, kept.stages, spec, class_metrics(confusion), raw_importances(spark, kept.model, spec), kept.holdout, kept.nodes, depth, labels), confusion


def confusion_matrix(scored: DataFrame, labels: list[str]) -> DataFrame:
    """Counts of all label pairs and their share within the actual class, zero rows as zero."""
    counts = scored.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(v) for v in labels])
    grid = scored.sparkSession.range(1).select(F.explode(names).alias("actual")).select("actual", F.explode(names).alias("predicted"))
    full = grid.join(counts, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("actual")), 0.0))


def class_metrics(confusion: DataFrame) -> DataFrame:
    """Accuracy and weighted F1 from the confusion matrix."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    by_actual = confusion.groupBy(F.col("actual").alias("c")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    by_pred = confusion.groupBy(F.col("predicted").alias("c")).agg(F.sum("n").alias("claimed"))
    f1 = ratio(2 * F.col("tp"), F.col("support") + F.col("claimed"), 0.0)
    return by_actual.join(by_pred, "c").agg(
        F.sum("support").alias("n_test"), ratio(F.sum("tp"), F.sum("support"), 0.0).alias("accuracy"),
        ratio(F.sum(f1 * F.col("support")), F.sum("support"), 0.0).alias("weighted_f1"),
    )


def blend_weight(step: Column, horizon: int, start: float = 0.65, end: float = 0.20) -> Column:
    """Weight of the trend line, falling over the horizon."""
    return F.lit(start) + F.lit(end - start) * (step - 1) / F.lit(max(1, horizon - 1))


def trend_line(series: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """M5: last value plus slope times step, with the blend weight of each step."""
    last = series.groupBy(*keys).agg(F.max_by("y", "t").alias("last_y"), F.max("t").alias("last_t"))
    slope = recent_slope(series, keys)
    both = last.join(slope, keys) if keys else last.withColumn("slope", one_row(slope)["slope"])
    steps = both.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select(
        *keys, "step", (F.col("last_y") + F.col("slope") * F.col("step")).alias("trend"), blend_weight(F.col("step"), horizon).alias("weight"),
    )


@dataclass
class Forecast:
    points: DataFrame
    metrics: DataFrame
    model: object


def forecast(series: DataFrame, keys: list[str], grain: str, horizon: int, trees: int = TREES, depth: int = 10) -> Forecast:
    """M5: recursive forecast of all series at once.

    ``series`` has one row per key and bucket (``build_series`` sums repeated times). One forest is fitted on the first
    80% of every long enough series, or taken from the store. Each series is then one row that holds its last twelve
    values; its horizon is one fold over the steps: features from the values, the forest's mean from its nodes as arrays,
    the blend with the trend line, and the result pushed into the values. No step has a job or a plan of its own.
    """
    horizon = max(1, horizon)
    spark = series.sparkSession
    series = cut_lineage(series.filter("y is not null"))  # its rows are read many times, what they are summed from once
    long_enough = F.count(F.lit(1)).over(Window.partitionBy(*keys)) >= MIN_POINTS
    series = series.withColumn("__ok", long_enough).filter("__ok").drop("__ok")
    table = chronological_split(supervised(series, keys), keys)
    usable = F.count(F.lit(1)).over(Window.partitionBy(*keys)) >= MIN_USABLE
    names = feature_names()
    ready = table.withColumn("__ok", usable).filter("__ok").select(*keys, "t", "y", "is_train", *names).persist()
    try:
        if not ready.filter("is_train").limit(1).count():
            raise ValueError(f"needs a series with at least {MIN_POINTS} points and {MIN_USABLE} usable rows")

        def fit(keep):
            rows = VectorAssembler(inputCols=names, outputCol="features").transform(ready).select(*keys, "y", "is_train", "features")
            forest = RandomForestRegressor(labelCol="y", featureSubsetStrategy="all", **forest_options(None, trees, depth))
            model = keep(forest.fit(rows.filter("is_train")))
            return None, cut_lineage(model.transform(rows.filter("not is_train")).select(*keys, "y", "prediction")), {}

        key = digest(ready, {"kind": "forecast", "keys": keys, "trees": trees, "depth": depth})
        kept = fit_once(spark, key, RandomForestRegressionModel, fit)
        modelled = cut_lineage(ready.select(*keys).distinct()) if keys else None
    finally:
        ready.unpersist()
    off = F.col("y") - F.col("prediction")
    metrics = kept.holdout.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_test"), F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"))
    depth_back = max(*LAGS, *WINDOWS)
    recent = Window.partitionBy(*keys).orderBy(F.col("t").desc())
    state = (
        series.withColumn("rn", F.row_number().over(recent)).filter(F.col("rn") <= depth_back)
        .groupBy(*keys).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda s: s["y"]).alias("h"),
            F.max("t").alias("last_t"), F.max_by("y", "t").alias("last_y"),
        )
    )
    slope = recent_slope(series, keys)
    state = state.join(slope, keys) if keys else state.withColumn("slope", one_row(slope)["slope"])
    if keys:
        state = state.join(modelled, keys, "left_semi")
    trees_of = one_row(flat_trees(kept.nodes))["trees"]

    def features(h):
        cols = [F.element_at(h, -n) for n in LAGS]
        for n in WINDOWS:
            tail = F.slice(h, -n, n)
            mean = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / n
            cols += [mean, F.sqrt(F.aggregate(tail, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1))]
        return F.array(*cols)

    steps = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda n: F.struct(n.alias("n"), blend_weight(n, horizon).alias("w")))

    def ahead(acc, step):
        p = step["w"] * (F.col("last_y") + F.col("slope") * step["n"]) + (1.0 - step["w"]) * array_mean(tree_values(F.col("trees"), depth, features(acc["h"])))
        longer = F.transform(F.array(p), lambda x: F.struct(
            F.slice(F.concat(acc["h"], F.array(x)), -depth_back, depth_back).alias("h"), F.concat(acc["out"], F.array(x)).alias("out"),
        ))
        return F.get(longer, F.lit(0))

    begin = F.struct(F.col("h").alias("h"), F.array().cast("array<double>").alias("out"))
    done = state.withColumn("trees", trees_of).withColumn("out", F.aggregate(steps, begin, ahead, lambda acc: acc["out"])).drop("trees")
    points = done.select(*keys, "last_t", F.posexplode("out").alias("i", "forecast")).withColumn("step", F.col("i") + 1)
    points = points.withColumn("t", _step(bucket_start(F.col("last_t"), grain), grain, F.col("step"))).select(*keys, "step", "t", "forecast")
    return Forecast(points, metrics, kept.model)

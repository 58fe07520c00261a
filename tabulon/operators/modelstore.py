"""Fitted models kept in the shared folder: the same data, columns and settings are fitted once."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.ml import Model, PipelineModel
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from tabulon.functions.distinct import fingerprint
from tabulon.session import shared_folder

#: Part of every key; another layout or another way to fit gets another number.
FORMAT = 2


@dataclass
class Stored:
    """A model with the stages that feed it, its scored holdout, its nodes and what else was learned."""

    model: Model
    stages: PipelineModel | None
    holdout: DataFrame
    nodes: DataFrame
    facts: dict[str, Any]


def digest(rows: DataFrame, settings: dict[str, Any]) -> str:
    """Key of a fit: settings, schema and a summary of all rows that doesn't depend on their order."""
    first, second = fingerprint([F.col(f"`{c}`") for c in rows.columns])
    total = lambda h: F.sum(h.cast("decimal(38,0)"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), total(first).alias("a"), total(second).alias("b"), F.bit_xor(first).alias("c")).first()
    named = {"format": FORMAT, "spark": rows.sparkSession.version, "schema": rows.schema.jsonValue(), "settings": settings, "rows": [str(x) for x in seen]}
    return hashlib.sha256(json.dumps(named, sort_keys=True, default=str).encode()).hexdigest()


ENTRY = "name string, facts string, staged boolean"


def _entry(spark: SparkSession, path: str) -> Row | None:
    """The first finished fit of a list, if there is any."""
    try:
        return spark.read.schema(ENTRY).parquet(path).orderBy("name").first()
    except AnalysisException:  # no such folder yet
        return None


def reread(model: Model, path: str) -> Model:
    """The model as written to ``path`` and read again.

    A fitted classifier keeps its training summary and through it the session, which can't be sent to tasks once the
    session has made an observation; the model that is read has no summary. One that was read before is only written.
    """
    model.write().save(path)
    return model if getattr(model, "was_read", False) else type(model).load(path)


def fit_once(spark: SparkSession, key: str, kind: type[Model], fit: Callable[[Callable[[Model], Model]], tuple[PipelineModel | None, DataFrame, dict]]) -> Stored:
    """The stored model of this key, or the one that ``fit`` makes.

    ``fit`` gets a function that keeps its model and returns it ready for use, and gives stages, scored holdout and facts.

    A fit is written to a folder of its own, and its name is appended to the key's list as the last step, so a fit that
    breaks off leaves nothing that would be read, and two at a time do no harm.
    """
    base = f"{shared_folder(spark).rstrip('/')}/models/{key}"
    fitted: dict[str, Model] = {}
    if _entry(spark, f"{base}/list") is None:
        own = f"{base}/{uuid.uuid4().hex}"

        def keep(model: Model) -> Model:
            fitted[own] = reread(model, f"{own}/model")
            return fitted[own]

        stages, holdout, facts = fit(keep)
        if stages is not None:
            stages.write().save(f"{own}/stages")
        holdout.write.parquet(f"{own}/holdout")
        made = [(own.rsplit("/", 1)[1], json.dumps(facts), stages is not None)]
        spark.createDataFrame(made, ENTRY).coalesce(1).write.mode("append").parquet(f"{base}/list")
    entry = _entry(spark, f"{base}/list")
    own = f"{base}/{entry['name']}"
    return Stored(
        fitted.get(own) or kind.load(f"{own}/model"), PipelineModel.load(f"{own}/stages") if entry["staged"] else None,
        spark.read.parquet(f"{own}/holdout"), spark.read.parquet(f"{own}/model/data").select("treeID", "nodeData.*"), json.loads(entry["facts"]),
    )


def flat_trees(nodes: DataFrame) -> DataFrame:
    """One row with ``trees``: per tree arrays of feature, kind, bounds, left and right child (-1 at a leaf) and value by node.

    The kind is the number of categories, -1 for a split by threshold; bounds are the categories that go left, or the
    threshold alone. The row's size is bounded by the number of trees and their depth.
    """
    place = F.struct(
        "id", F.col("split.featureIndex").alias("f"), F.col("split.numCategories").alias("k"), F.col("split.leftCategoriesOrThreshold").alias("b"),
        F.col("leftChild").alias("l"), F.col("rightChild").alias("r"), F.col("prediction").alias("v"),
    )
    each = nodes.groupBy("treeID").agg(F.array_sort(F.collect_list(place)).alias("n"))
    arrays = F.struct("treeID", *[F.col(f"n.{c}").alias(c) for c in ("f", "k", "b", "l", "r", "v")])
    return each.agg(F.array_sort(F.collect_list(arrays)).alias("trees"))


def tree_values(trees: Column, depth: int, features: Column) -> Column:
    """The value of the leaf that an array of features reaches in each tree, in the trees' order, as one expression."""
    def leaf(tree: Column, x: Column) -> Column:
        def down(node: Column, _: Column) -> Column:
            value, bounds = F.get(x, F.get(tree["f"], node)), F.get(tree["b"], node)
            left = F.when(F.get(tree["k"], node) < 0, value <= F.get(bounds, F.lit(0))).otherwise(F.array_contains(bounds, value))
            child = F.when(left, F.get(tree["l"], node)).otherwise(F.get(tree["r"], node))
            return F.when(F.get(tree["l"], node) < 0, node).otherwise(child)

        return F.get(tree["v"], F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down))

    # the features are bound once, not made anew at every node
    return F.get(F.transform(F.array(features), lambda x: F.transform(trees, lambda tree: leaf(tree, x))), F.lit(0))


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v) / F.size(values)


def array_quantile(values: Column, p: float) -> Column:
    """Linear interpolation between the two ranks next to p; the array must be sorted."""
    place = (F.size(values) - 1) * F.lit(float(p))
    low = F.floor(place).cast("int")
    a, b = F.get(values, low), F.get(values, F.ceil(place).cast("int"))
    return a + (place - low) * (b - a)

"""Connected components of a graph given by its links, as DataFrame joins."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import cut_lineage


def contracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one task as stars: each node with the smallest one that it reaches within the task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of ``links`` (a, b) reaches.

    Links are first contracted within each task, which leaves at most one for each of its nodes. Then, each round, a node takes the smallest label among itself and its neighbours, then the label of its label, so the
    rounds grow with the logarithm of the longest chain between tasks, not with its length. Minima are taken before the shuffle, so a
    node with very many links is no bottleneck. Self links and repeated links change nothing; no links give no rows.
    """
    links = links.select("a", "b").where(F.col("a") != F.col("b"))
    links = cut_lineage(links.mapInArrow(contracted, "a long, b long").where(F.col("a") != F.col("b")))
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut_lineage(both.distinct())
    # a first step without a join: each node's label is the least of itself and its neighbours
    labels = cut_lineage(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("upper"))
        jumped = lower.join(up, "component").select("node", "old", F.least("component", "upper").alias("component"))
        jumped = cut_lineage(jumped)
        labels = jumped.select("node", "component")
        if not jumped.where(F.col("old") != F.col("component")).limit(1).count():
            return labels

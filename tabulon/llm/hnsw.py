"""Operator 6: approximate nearest neighbours by small-world graphs per shard.

Largest inner products are nearest points once one more component makes all vectors equally long. That component must not
outweigh the others, so the vectors of a shard are cut into bands of like length with a graph each; a query visits them
from long to short and leaves those that even the best direction can't lift into its list.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import cut_lineage
from tabulon.llm.topk import best, by_length

#: Distinct vectors in a shard's graph; bounds memory and build time of a task.
SHARD_ROWS = 16384
QUERY_ROWS = 4096
LINKS = 16
BUILD_WIDTH = 80
SEARCH_WIDTH = 100
#: Longest over shortest vector of a band; vectors of bands with fewer rows are compared exactly.
BAND_RATIO = 1.25
LEAST_BAND = 128
INDEX = "shard long, dim int, members array<array<long>>, vectors binary, bands array<struct<rows:long, levels:binary, links:binary, entry:int>>"


class Graph:
    """A hierarchical navigable small-world graph over the rows of a matrix, nearest by Euclidean distance.

    ``links`` is one flat array: node i has ``2 * links`` slots on the ground level and ``links`` on each level above,
    unused slots are -1; ``base[i]`` is where its slots begin.
    """

    def __init__(self, points: np.ndarray, levels: np.ndarray, links: np.ndarray | None = None, entry: int = -1, width: int = LINKS):
        self.points, self.levels, self.width, self.entry = points, levels, width, entry
        self.norms = np.einsum("ij,ij->i", points, points)
        self.base = np.concatenate(([0], np.cumsum(2 * width + levels.astype(np.int64) * width)))
        self.links = np.full(self.base[-1], -1, np.int32) if links is None else links

    @classmethod
    def build(cls, points: np.ndarray, width: int = LINKS, ef: int = BUILD_WIDTH, seed: int = 7) -> Graph:
        chance = np.random.default_rng(seed).random(len(points))
        levels = np.floor(-np.log(np.maximum(chance, 1e-12)) / math.log(width)).astype(np.int32)
        graph = cls(points, levels, width=width)
        for i in range(len(points)):
            graph.insert(i, ef)
        return graph

    def slots(self, node: int, level: int) -> slice:
        start = int(self.base[node])
        if level:
            start += self.width * (level + 1)
            return slice(start, start + self.width)
        return slice(start, start + 2 * self.width)

    def neighbours(self, node: int, level: int) -> np.ndarray:
        own = self.links[self.slots(node, level)]
        return own[own >= 0]

    def far(self, query: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances without the query's own square."""
        return self.norms[nodes] - 2.0 * (self.points[nodes] @ query)

    def descend(self, query: np.ndarray, node: int, top: int, bottom: int) -> int:
        """Greedy walk from level ``top`` down to above ``bottom``."""
        here = float(self.far(query, np.array([node]))[0])
        for level in range(top, bottom, -1):
            moved = True
            while moved:
                moved = False
                near = self.neighbours(node, level)
                if len(near):
                    d = self.far(query, near)
                    j = int(d.argmin())
                    if d[j] < here:
                        node, here, moved = int(near[j]), float(d[j]), True
        return node

    def nearest(self, query: np.ndarray, start: int, level: int, ef: int) -> list[tuple[float, int]]:
        """Up to ``ef`` nodes by rising distance, found from ``start``."""
        seen = np.zeros(len(self.points), bool)
        seen[start] = True
        d = float(self.far(query, np.array([start]))[0])
        open_, kept = [(d, start)], [(-d, start)]
        while open_:
            d, node = heapq.heappop(open_)
            if d > -kept[0][0] and len(kept) >= ef:
                break
            near = self.neighbours(node, level)
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            distances = self.far(query, near)
            if len(kept) >= ef:
                closer = distances < -kept[0][0]
                near, distances = near[closer], distances[closer]
            for d, node in zip(distances.tolist(), near.tolist(), strict=True):
                if len(kept) < ef:
                    heapq.heappush(kept, (-d, node))
                elif d < -kept[0][0]:
                    heapq.heapreplace(kept, (-d, node))
                else:
                    continue
                heapq.heappush(open_, (d, node))
        return sorted((-d, node) for d, node in kept)

    def spread(self, found: list[tuple[float, int]], most: int) -> np.ndarray:
        """Neighbours in different directions: nearer ones first, none that is closer to a chosen one than to the node."""
        nodes = np.array([n for _, n in found], np.int64)
        if len(nodes) <= most:
            return nodes
        own = np.array([d for d, _ in found])
        points = self.points[nodes]
        norms = self.norms[nodes]
        between = norms[:, None] + norms[None, :] - 2.0 * (points @ points.T)
        shaded = np.zeros(len(nodes), bool)
        taken = np.zeros(len(nodes), bool)
        for _ in range(most):
            i = int(np.argmin(shaded | taken))
            if shaded[i] or taken[i]:
                break
            taken[i] = True
            shaded |= between[i] <= own
        rest = most - int(taken.sum())
        if rest:
            taken[np.flatnonzero(~taken)[:rest]] = True
        return nodes[taken]

    def insert(self, node: int, ef: int) -> None:
        if self.entry < 0:
            self.entry = node
            return
        query, own, top = self.points[node], int(self.levels[node]), int(self.levels[self.entry])
        square = float(self.norms[node])
        at = self.descend(query, self.entry, top, min(own, top))
        for level in range(min(own, top), -1, -1):
            found = self.nearest(query, at, level, ef)
            at = found[0][1]
            chosen = self.spread([(d + square, n) for d, n in found], self.width)
            self.put(node, level, chosen)
            for other in chosen.tolist():
                self.add(other, node, level)
        if own > top:
            self.entry = node

    def put(self, node: int, level: int, nodes: np.ndarray) -> None:
        room = self.slots(node, level)
        self.links[room] = -1
        self.links[room.start : room.start + len(nodes)] = nodes

    def add(self, node: int, new: int, level: int) -> None:
        room = self.slots(node, level)
        held = self.links[room]
        free = np.flatnonzero(held < 0)
        if len(free):
            self.links[room.start + int(free[0])] = new
            return
        near = np.append(held, new).astype(np.int64)
        d = self.norms[near] - 2.0 * (self.points[near] @ self.points[node]) + float(self.norms[node])
        order = np.argsort(d, kind="stable")
        # some room stays free, so that not each further link sorts the neighbours again
        self.put(node, level, self.spread(list(zip(d[order].tolist(), near[order].tolist(), strict=True)), len(held) * 3 // 4))

    def search(self, query: np.ndarray, ef: int) -> np.ndarray:
        if self.entry < 0:
            return np.array([], np.int64)
        at = self.descend(query, self.entry, int(self.levels[self.entry]), 0)
        return np.array([n for _, n in self.nearest(query, at, 0, ef)], np.int64)


def raised(x: np.ndarray) -> np.ndarray:
    """The vectors over their largest component, with one more component that makes all equally long, so that nearest
    means largest inner product."""
    x = np.asarray(x, np.float64)
    x = x / (np.abs(x).max(initial=0.0) or 1.0)
    squares = np.einsum("ij,ij->i", x, x)
    return np.column_stack([x, np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0.0))])


def asked_point(vector: np.ndarray) -> np.ndarray:
    """The query in the space of ``raised``; its length doesn't change the order of inner products."""
    vector = vector / (np.abs(vector).max(initial=0.0) or 1.0)
    return np.append(vector / (math.sqrt(float(vector @ vector)) or 1.0), 0.0)


def log_lengths(x: np.ndarray) -> np.ndarray:
    """Binary logarithms of the vectors' lengths; no square leaves the range of numbers."""
    top = np.abs(x).max(axis=1, initial=0.0)
    safe = np.where(top > 0, top, 1.0)
    inner = np.einsum("ij,ij->i", x / safe[:, None], x / safe[:, None])
    return np.log2(safe) + 0.5 * np.log2(np.where(inner > 0, inner, 1.0))


def bands(x: np.ndarray) -> list[np.ndarray]:
    """Rows of each band of like length, long ones first; all rows that stand in no full band are the last list."""
    lengths = log_lengths(x)
    order = np.argsort(-lengths, kind="stable")
    out, rest, at = [], [], 0
    while at < len(order):
        end = at + int(np.searchsorted(-lengths[order[at:]], -(lengths[order[at]] - math.log2(BAND_RATIO)), side="right"))
        (out if end - at >= LEAST_BAND else rest).append(order[at:end])
        at = end
    return [*out, np.concatenate(rest).astype(np.int64) if rest else np.zeros(0, np.int64)]


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """vector, members: each different vector once with its ``k`` + 1 smallest ids; no more can be among k results."""
    order = Window.partitionBy("vector").orderBy("id")
    few = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("members"))


def build_index(rows: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, links: int = LINKS, ef: int = BUILD_WIDTH) -> DataFrame:
    """One row per shard and vector length; every vector is in one of its bands.

    ``vectors`` and ``members`` lie band after band, each band has a graph of flat arrays; the last one, of vectors whose
    length few others have, has none and is compared exactly.
    """
    nodes = cut_lineage(distinct_vectors(rows, k).withColumn("n", F.monotonically_increasing_id()))
    shards = max(1, math.ceil(nodes.count() / shard_rows))
    dealt = nodes.select(F.pmod(F.xxhash64("n"), F.lit(shards)).alias("shard"), F.size("vector").alias("dim"), F.col("n").alias("id"), "vector", "members")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        shard, dim = key[0].as_py(), key[1].as_py()
        ((_, x),) = by_length(group).values()
        order = np.argsort(group["id"].to_numpy(), kind="stable")
        parts = bands(x)
        back = np.concatenate(parts)
        made = []
        for part in parts[:-1]:
            graph = Graph.build(raised(x[part]), links, ef)
            made.append({"rows": len(part), "levels": graph.levels.astype("<i4").tobytes(), "links": graph.links.astype("<i4").tobytes(), "entry": graph.entry})
        made.append({"rows": len(parts[-1]), "levels": b"", "links": b"", "entry": -1})
        kind = pa.list_(pa.struct([("rows", pa.int64()), ("levels", pa.binary()), ("links", pa.binary()), ("entry", pa.int32())]))
        return pa.table({
            "shard": pa.array([shard], pa.int64()), "dim": pa.array([dim], pa.int32()),
            "members": pa.array([group["members"].take(pa.array(order[back])).to_pylist()], pa.list_(pa.list_(pa.int64()))),
            "vectors": pa.array([x[back].astype("<f8").tobytes()], pa.binary()), "bands": pa.array([made], kind),
        })

    return dealt.groupBy("shard", "dim").applyInArrow(run, INDEX)


class Shard:
    """A shard's index, ready for search."""

    def __init__(self, row: dict, links: int):
        self.x = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
        self.members = row["members"]
        self.graphs, at = [], 0
        for band in row["bands"]:
            stop = at + band["rows"]
            if band["levels"]:
                graph = Graph(raised(self.x[at:stop]), np.frombuffer(band["levels"], "<i4"), np.frombuffer(band["links"], "<i4"), band["entry"], links)
                self.graphs.append((at, graph, float(log_lengths(self.x[at:stop]).max())))
            at = stop
            self.alone = np.arange(at - band["rows"], at)  # the last band

    def nearest(self, query: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes that can be among the ``k`` best besides one node of the query's own, with their inner products."""
        near, scores = self.alone, exact(query, self.x[self.alone])
        point, own = asked_point(query), float(log_lengths(query[None])[0])
        for at, graph, longest in self.graphs:
            if len(scores) > k:
                least = np.partition(scores, -(k + 1))[-(k + 1)]
                # no product is larger than that of the lengths; a little room covers rounding
                if least > 0 and own + longest + 1e-9 < math.log2(least):
                    break
            found = graph.search(point, ef) + at
            near, scores = np.concatenate([near, found]), np.concatenate([scores, exact(query, self.x[found])])
        if len(near) > k + 1:
            best_nodes = scores >= np.partition(scores, -(k + 1))[-(k + 1)]
            near, scores = near[best_nodes], scores[best_nodes]
        return near, scores


def exact(query: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added in the order of the components."""
    total = np.zeros(len(x))
    for j in range(len(query)):
        total += x[:, j] * query[j]
    return total


def search(index: DataFrame, queries: DataFrame, k: int = 20, ef: int = SEARCH_WIDTH, query_rows: int = QUERY_ROWS, links: int = LINKS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products found for each query (``id``, ``vector``).

    Blocks of queries visit each shard; each visit returns k candidates per query with their inner product in double
    precision on the vectors as they are, and the lists are merged per query. ``ef`` nodes are kept open in a graph, at
    least 2k. Rows with the query's own id are no results; ties go to the smaller id. Equal vectors share a node, so many
    copies neither crowd the graph nor get lost. Vectors of a length that few others have are all compared. Null, zero and
    non-finite vectors are to be left out by the caller (``nonzero``). No rows in either input give no rows.
    """
    ef = max(ef, 2 * k)
    stored = cut_lineage(index)
    asked = cut_lineage(queries.select("id", "vector").distinct().withColumn("n", F.monotonically_increasing_id()))
    blocks = max(1, math.ceil(asked.count() / query_rows))
    asked = asked.select("id", "vector", F.size("vector").alias("dim"), F.pmod(F.xxhash64("n"), F.lit(blocks)).alias("block"))
    where = stored.select("shard", "dim").distinct()
    left = asked.join(where, "dim").select("id", "vector", "shard", "dim", "block")
    right = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if a.num_rows and b.num_rows:
            shard = Shard(b.slice(0, 1).to_pylist()[0], links)
            ((ids, q),) = by_length(a).values()
            for me, vector in zip(ids.tolist(), q, strict=True):
                near, scores = shard.nearest(vector, k, ef)
                pairs = [(-s, other) for s, node in zip(scores.tolist(), near.tolist(), strict=True) for other in shard.members[node] if other != me]
                found += [(me, other, -s) for s, other in heapq.nsmallest(k, pairs)]
        columns = list(zip(*found, strict=True)) or [[], [], []]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score"])

    keys = ("shard", "dim", "block")
    left = left.toDF(*left.columns)  # columns of its own: both sides come from the same rows
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    return best(lists.distinct(), ["query_id"], k).select("query_id", "rank", "vec_id", "score")


def nonzero(rows: DataFrame) -> DataFrame:
    return rows.where(F.exists("vector", lambda x: x != 0))

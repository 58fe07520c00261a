"""Operator 13: hard negatives from lists that the anchors of a cluster share.

Anchors are clustered by direction. For a cluster with centre c whose members lie within an angle r of it, no member q
has a larger inner product with x than |q| |x| cos(max(0, angle(x, c) - r)). The candidates of a shard are sorted by
|x| cos(...) once per cluster; all members walk this list and each stops where the bound certifies that nothing behind
can enter its result any more.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import cut_lineage
from tabulon.llm.topk import matrix

SHARD_ROWS = 16384
#: Anchors that meet a shard in one task.
BLOCK_ROWS = 4096
#: Anchors on whose directions the centres are fitted, anchors per centre, and the most centres.
FIT_ROWS = 8192
CLUSTER_ROWS = 64
MOST_CLUSTERS = 256
ROUNDS = 8
FAN_IN = 16
#: Candidates of one step of a walk.
STEP_ROWS = 512
#: Rounding of angles and lengths, as a share of |q| |x|; bounds are raised by it.
MARGIN = 1e-7
LIMIT = 2**63 - 1


def directions(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; zero vectors and those too long for doubles become zero."""
    top = np.abs(x).max(1, initial=0)
    with np.errstate(all="ignore"):
        scaled = x / np.where(top > 0, top, 1)[:, None]
        out = scaled / np.sqrt((scaled**2).sum(1))[:, None]
    return np.nan_to_num(out, nan=0, posinf=0, neginf=0)


def fit_centres(x: np.ndarray, count: int) -> np.ndarray:
    """Centres of ``count`` clusters of directions, from evenly spaced rows by a few rounds of means."""
    unit = directions(x)
    centres = unit[np.linspace(0, len(unit) - 1, count).astype(int)]
    for _ in range(ROUNDS if count > 1 else 1):
        own = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        centres = np.where((np.abs(sums).max(1) > 0)[:, None], directions(sums), centres)
    return centres


def nearest_centre(lists: pa.Array, centres: np.ndarray) -> np.ndarray:
    """Cluster of each vector; vectors of other lengths than the centres' fill clusters by their length."""
    sizes, flat = matrix(pa.chunked_array([lists]))
    own = sizes % max(len(centres), 1)
    fit = np.flatnonzero(sizes == centres.shape[1])
    if len(fit):
        starts = np.cumsum(sizes) - sizes
        own[fit] = np.argmax(directions(flat[starts[fit][:, None] + np.arange(centres.shape[1])]) @ centres.T, axis=1)
    return own


class Walk:
    """The list of one cluster over one shard: candidates by falling bound, scores exact."""

    def __init__(self, q: np.ndarray, x: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        size = q.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            self.length = np.sqrt((q**2).sum(1))
            norms = np.sqrt((x**2).sum(1))
        self.exact = size * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(x).max(initial=0)) < 2**53
        if self.exact:
            unit = directions(q)
            centre = directions(unit.sum(0)[None])[0]
            live = self.length > 0
            radius = np.arccos(np.clip(unit[live] @ centre, -1, 1)).max(initial=0)
            gap = np.maximum(0, np.arccos(np.clip(directions(x) @ centre, -1, 1)) - radius)
            bound = norms * (np.cos(gap) + MARGIN)
            order = np.argsort(-bound, kind="stable")
            self.bound = np.append(bound[order], -np.inf)
            self.q, self.x = q, x[order]
        else:  # whole lists in Python's integers, without early ends
            order = np.arange(len(x))
            self.bound = np.append(np.full(len(x), np.inf), -np.inf)
            self.q, self.x = (np.array([[int(v) for v in r] for r in a], object).reshape(len(a), size) for a in (q, x))
        self.ids, self.labels = ids[order], labels[order]

    def steps(self, active: np.ndarray):
        """(members walking, candidates' places, their scores) until no member is left; ``active`` is cleared by the caller."""
        at = 0
        while at < len(self.ids) and active.any():
            rows = np.flatnonzero(active)
            places = slice(at, at + STEP_ROWS)
            scores = self.q[rows] @ self.x[places].T
            if not self.exact:
                scores = np.array([[max(-LIMIT - 1, min(LIMIT, v)) for v in r] for r in scores], object).reshape(scores.shape)
            yield rows, places, scores.astype(np.int64)
            at += STEP_ROWS

    def rest(self, rows: np.ndarray, places: slice) -> np.ndarray:
        """What no candidate behind ``places`` scores above, for each member."""
        bound = self.bound[min(places.stop, len(self.ids))]
        with np.errstate(invalid="ignore"):
            return np.where(np.isfinite(bound), np.where(self.length[rows] > 0, self.length[rows] * bound, 0 if bound > -np.inf else -np.inf), bound)


def keep_best(kept: list[np.ndarray], new: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of rows (owner, score, id) the ``k`` best of each owner, by falling score and rising id."""
    owner, score, ids = (np.concatenate(p) for p in zip(kept, new, strict=True))
    order = np.lexsort((ids, ~score, owner))  # ~score falls as score rises, without overflow
    owner, score, ids = owner[order], score[order], ids[order]
    begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    place = np.arange(len(owner)) - np.repeat(begin, np.diff(np.r_[begin, len(owner)]))
    good = place < k
    return [owner[good], score[good], ids[good]]


def kth(kept: list[np.ndarray], owners: int, k: int) -> np.ndarray:
    """The k-th score of each owner, the least integer where there are fewer."""
    out = np.full(owners, -LIMIT - 1)
    owner, score, _ = kept
    counts = np.bincount(owner, minlength=owners)
    full = np.flatnonzero(counts >= k)
    out[full] = score[np.cumsum(counts)[full] - 1]
    return out


def empty() -> list[np.ndarray]:
    return [np.zeros(0, np.int64) for _ in range(3)]


def walk_same(walk: Walk, own: np.ndarray, labels: np.ndarray, k: int) -> list[np.ndarray]:
    """(member, score, id) of the ``k`` best candidates of each member's label."""
    kept, active = empty(), np.ones(len(own), bool)
    for rows, places, scores in walk.steps(active):
        least = kth(kept, len(own), k)
        fit = (walk.labels[places] == labels[rows][:, None]) & (walk.ids[places] != own[rows][:, None]) & (scores >= least[rows][:, None])
        r, c = np.nonzero(fit)
        kept = keep_best(kept, [rows[r], scores[r, c], walk.ids[places][c]], k)
        least = kth(kept, len(own), k)
        active[rows] = (least[rows] == -LIMIT - 1) | (walk.rest(rows, places) >= least[rows])
    return kept


def walk_other(walk: Walk, own: np.ndarray, labels: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[np.ndarray]:
    """(window, score, id) of the ``k`` best candidates of other labels in each window; ``owner`` is a window's member."""
    kept, open_ = empty(), low <= high
    active = np.bincount(owner[open_], minlength=len(own)) > 0
    slot = np.full(len(own), -1)
    for rows, places, scores in walk.steps(active):
        slot[rows] = np.arange(len(rows))
        least = kth(kept, len(owner), k)
        new = [empty()]
        other = (walk.labels[places] != labels[rows][:, None]) & (walk.ids[places] != own[rows][:, None])
        windows = np.flatnonzero(open_)
        for part in np.array_split(windows, max(1, len(windows) // 1024)):
            at = slot[owner[part]]
            s = scores[at]
            r, c = np.nonzero(other[at] & (s >= np.maximum(low[part], least[part])[:, None]) & (s <= high[part][:, None]))
            new.append([part[r], s[r, c], walk.ids[places][c]])
        kept = keep_best(kept, [np.concatenate(p) for p in zip(*new, strict=True)], k)
        least = kth(kept, len(owner), k)
        limit = np.full(len(own), -np.inf)
        limit[rows] = walk.rest(rows, places)
        open_ &= limit[owner] >= np.maximum(low, least)
        active[:] = np.bincount(owner[open_], minlength=len(own)) > 0
    return kept


def window(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole n with low * s <= 100 * n <= high * s, without leaving 64 bits."""
    q, r = np.divmod(scores, 100)
    return low * q - (-low * r) // 100, high * q + high * r // 100


def vectors_of(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of each length."""
    lengths, flat = matrix(table["vector"])
    starts = np.cumsum(lengths) - lengths
    out = {}
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        out[n] = rows, flat[starts[rows][:, None] + np.arange(n)] if n else np.zeros((len(rows), 0))
    return out


def clusters_of(anchors: pa.Table, shard: pa.Table):
    """(anchor rows, walk) of each cluster and vector length of a block of anchors."""
    cluster = anchors["cluster"].to_numpy()
    ids, labels = shard["id"].to_numpy(), shard["label"].to_numpy()
    candidates = vectors_of(shard)
    for n, (rows, q) in vectors_of(anchors).items():
        if n not in candidates:
            continue
        places, x = candidates[n]
        for c in np.unique(cluster[rows]):
            mine = cluster[rows] == c
            yield rows[mine], Walk(q[mine], x, ids[places], labels[places])


def _same(k: int):
    def run(key: tuple, anchors: pa.Table, shard: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64) for _ in range(3)]
        if anchors.num_rows and shard.num_rows:
            n, own, labels = (anchors[c].to_numpy() for c in ("n", "id", "label"))
            for rows, walk in clusters_of(anchors, shard):
                member, score, ids = walk_same(walk, own[rows], labels[rows], k)
                out = [np.concatenate(p) for p in zip(out, (n[rows][member], score, ids), strict=True)]
        return pa.table([*out, np.full(len(out[0]), key[1].as_py())], names=["n", "score", "found", "shard"])

    return run


def _other(k: int, low: int, high: int):
    def run(key: tuple, anchors: pa.Table, shard: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64) for _ in range(4)]
        if anchors.num_rows and shard.num_rows:
            n, own, labels = (anchors[c].to_numpy() for c in ("n", "id", "label"))
            sizes = pc.list_value_length(anchors["scores"]).to_numpy()
            scores = anchors["scores"].combine_chunks().flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for rows, walk in clusters_of(anchors, shard):
                owner = np.repeat(np.arange(len(rows)), sizes[rows])
                place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes[rows]) - sizes[rows], sizes[rows])
                least, most = window(scores[starts[rows][owner] + place], low, high)
                found, score, ids = walk_other(walk, own[rows], labels[rows], owner, least, most, k)
                out = [np.concatenate(p) for p in zip(out, (n[rows][owner[found]], place[found], score, ids), strict=True)]
        return pa.table([*out, np.full(len(out[0]), key[1].as_py())], names=["n", "place", "score", "found", "shard"])

    return run


def merged(lists: DataFrame, keys: list[str], shards: int, k: int) -> DataFrame:
    """The ``k`` best of all shards per key with their rank, ``FAN_IN`` shards at a time."""
    while True:
        shards = -(-shards // FAN_IN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN))
        order = Window.partitionBy(*keys, "shard").orderBy(F.col("score").desc(), "found")
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if shards <= 1:
            return lists.drop("shard")
        lists = lists.drop("rank")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` have id, label (both whole numbers) and vector (whole numbers as doubles). Scores are inner products; higher
    ones come first, ties by smaller id. An anchor's positives are its first ``positives`` other rows of its label; for
    each, the result has the first ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score
    <= high * positive_score.

    Candidates are dealt evenly to shards and anchors, cluster by cluster, to blocks of bounded size; clusters larger than
    a block are split. Each block meets each shard in one task, where every cluster has one sorted list. A first walk
    finds positives per shard, whose lists are merged; a second one finds the negatives. The centres are fitted on at most
    ``FIT_ROWS`` anchors, by hash; they change the order of the walk only, results are exact.

    Rows with a null id, label, vector or component, or a non-finite component take no part. Rows with an anchor's own id
    are none of its candidates; repeated rows of one id are candidates and anchors each. Vectors meet those of their own
    length only. Products beyond 2^53 are added as Python's integers and clipped to 64 bits. No rows or no anchors give
    no rows; other columns are left out.
    """
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", fine))
    marked = usable.select(F.col("id").cast("long"), F.col("label").cast("long"), "vector", F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    base = cut_lineage(marked.withColumn("n", F.monotonically_increasing_id()))
    facts = base.agg(F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors")).first()
    shards = max(1, -(-facts["rows"] // shard_rows))
    anchors = base.where("anchor").drop("anchor")
    sample = [r["vector"] for r in anchors.orderBy(F.xxhash64("id", "n")).select("vector").limit(FIT_ROWS).collect()]
    common = max({len(v) for v in sample}, key=[len(v) for v in sample].count) if sample else 0
    fit = np.array([v for v in sample if len(v) == common], float)
    centres = fit_centres(fit, min(MOST_CLUSTERS, len(fit), -(-facts["anchors"] // CLUSTER_ROWS))) if len(fit) else np.zeros((1, 0))

    def assign(batches):
        for batch in batches:
            yield batch.append_column("cluster", pa.array(nearest_centre(batch.column(2), centres), pa.int64()))

    anchors = cut_lineage(anchors.mapInArrow(assign, "id long, label long, vector array<double>, n long, cluster long"))
    # clusters lie in blocks one after another; a cluster of more rows than a block is dealt to several
    sizes = {r["cluster"]: r["count"] for r in anchors.groupBy("cluster").count().collect()}  # MOST_CLUSTERS rows at most
    spot, filled, first, parts = 0, 0, {}, {}
    for c in sorted(sizes):
        if filled and filled + sizes[c] > block_rows:
            spot, filled = spot + 1, 0
        first[c], parts[c] = spot, -(-sizes[c] // block_rows)
        if parts[c] > 1:
            spot, filled = spot + parts[c], 0
        else:
            filled += sizes[c]
    blocks = spot + (filled > 0)
    if not blocks:
        return base.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    begins = F.create_map(*[F.lit(x) for c in sizes for x in (c, first[c])])
    splits = F.create_map(*[F.lit(x) for c in sizes for x in (c, parts[c])])
    block = (begins[F.col("cluster")] + F.pmod(F.xxhash64("n"), splits[F.col("cluster")])).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    placed = anchors.withColumn("block", block)
    dealt = base.select("id", "label", "vector", F.pmod(F.xxhash64("n"), F.lit(shards)).alias("shard")).withColumn("block", every(blocks))

    def meet(members: DataFrame, run, schema: str) -> DataFrame:
        sides = members.withColumn("shard", every(shards)).groupBy("block", "shard")
        return sides.cogroup(dealt.groupBy("block", "shard")).applyInArrow(run, schema)

    same = merged(meet(placed, _same(positives), "n long, score long, found long, shard long"), ["n"], shards, positives)
    same = cut_lineage(same.select("n", (F.col("rank") - 1).cast("long").alias("place"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")))
    lists = same.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score")))["positive_score"].alias("scores"))
    members = placed.join(lists, "n").select("n", "id", "label", "vector", "cluster", "block", "scores")
    other = merged(meet(members, _other(negatives, low, high), "n long, place long, score long, found long, shard long"), ["n", "place"], shards, negatives)
    names = anchors.select("n", F.col("id").alias("anchor_id"))
    out = other.join(same, ["n", "place"]).join(names, "n")
    return out.select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

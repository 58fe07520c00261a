"""Operator 5: exact top-k search by tiled matrix products, partial selection and tree merging."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import cut_lineage

SHARD_ROWS = 4096
QUERY_ROWS = 2048
#: Queries times candidates in one product.
TILE_QUERIES = 256
FAN_IN = 16


def vectors(df: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, vector (array of doubles): rows whose id is set and whose vector has finite components only."""
    v = df[embedding].cast("array<double>")
    big = F.lit(float("inf"))
    rows = df.select(df[key].cast("long").alias("id"), v.alias("vector"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", fine))


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the vectors and their components one after another."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    return np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)


def by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of each length, by rising id."""
    lengths, flat = matrix(table["vector"])
    ids = table["id"].to_numpy()
    starts = np.cumsum(lengths) - lengths
    out = {}
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        out[n] = ids[rows], flat[starts[rows][:, None] + np.arange(n)] if n else np.zeros((len(rows), 0))
    return out


def tile_best(queries: pa.Table, shard: pa.Table, k: int) -> pa.Table:
    """The k best candidates of one shard for each query of one block, ties to the smaller id."""
    found: list[tuple[int, int, int]] = []
    candidates = by_length(shard)
    for n, (own, q) in by_length(queries).items():
        if n not in candidates:
            continue
        ids, c = candidates[n]
        exact = n * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(c).max(initial=0)) < 2**53
        if not exact:
            q, c = (np.array([[int(x) for x in r] for r in a], dtype=object).reshape(len(a), n) for a in (q, c))
        for start in range(0, len(q), TILE_QUERIES):
            scores = q[start : start + TILE_QUERIES] @ c.T
            for row, me in zip(scores, own[start : start + TILE_QUERIES].tolist(), strict=True):
                keep = ids != me
                if exact and len(row) > k:
                    row = np.where(keep, row, -np.inf)
                    keep &= row >= np.partition(row, len(row) - k)[len(row) - k]
                at = np.flatnonzero(keep)
                order = np.argsort(-row[at], kind="stable")[:k] if exact else sorted(range(len(at)), key=lambda i: -row[at[i]])[:k]
                found += [(me, int(ids[at[i]]), min(max(int(row[at[i]]), -(2**63)), 2**63 - 1)) for i in order]
    columns = list(zip(*found, strict=True)) or [[], [], []]
    return pa.table([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score"])


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest integer inner products of each query.

    Both inputs have ``id`` and ``vector`` with whole numbers as doubles, as ``vectors`` and ``whole`` give. Candidates
    are dealt evenly to shards and queries to blocks of bounded size; each pair of a block and a shard is one task group,
    multiplied tile by tile, of which only k rows per query leave. Partial lists are merged ``FAN_IN`` at a time.

    Rows with the query's own id are no candidates. Ties go to the smaller id; repeated rows of one id are candidates
    each. Vectors meet those of their own length only. Products beyond 2^53 are added as Python integers and clipped to
    64 bits in the result. No candidates or no queries give no rows.
    """
    numbered = cut_lineage(candidates.select("id", "vector").withColumn("n", F.monotonically_increasing_id()))
    asked = cut_lineage(queries.select("id", "vector").withColumn("n", F.monotonically_increasing_id()))
    shards = max(1, math.ceil(numbered.count() / shard_rows))
    blocks = max(1, math.ceil(asked.count() / query_rows))
    # counting within each partition would be uneven, a hash of the row number deals evenly whatever the ids are
    left = asked.withColumn("block", F.pmod(F.xxhash64("n"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")))
    right = numbered.withColumn("shard", F.pmod(F.xxhash64("n"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return pa.table([pa.array([], pa.int64())] * 4, names=["query_id", "vec_id", "score", "shard"])
        out = tile_best(a, b, k)
        return out.append_column("shard", pa.array([key[1].as_py()] * out.num_rows, pa.int64()))

    left = left.toDF(*left.columns)  # columns of its own: both sides may come from the same rows
    lists = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(run, "query_id long, vec_id long, score long, shard long")
    while shards > FAN_IN:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN))
        lists = best(lists, ["query_id", "shard"], k).drop("rank")
        shards = math.ceil(shards / FAN_IN)
    return best(lists, ["query_id"], k).select("query_id", "rank", "vec_id", "score")


def best(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def whole(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """Each component x becomes floor(scale * x), kept as a double."""
    times = lambda x: x * F.lit(scale)
    # floor() gives 64-bit integers; components beyond them are whole already
    down = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(F.when(F.abs(x) < 2.0**53, x).otherwise(0.0)).cast("double")).otherwise(x)
    return rows.withColumn("vector", F.transform("vector", lambda x: down(times(x))))

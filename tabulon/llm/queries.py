"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import bpe, hnsw, jaccard, mixing, negatives, packing, periods, quality, secrets, token_counts, topk, toxicity, warc
from tabulon.llm.common import documents, new_path, ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(run)
    def shipped(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return run(spark, folder)

    QUERIES[run.__name__] = shipped
    return shipped


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_bpe_encode_decode(spark: SparkSession, folder: str) -> DataFrame:
    wanted = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.encode_decode(documents(spark, folder), vocabulary("word_bpe_49k.json"), keep=["doc_id"], outputs=wanted)


@query
def op3_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    _, accounts = mixing.mix(documents(spark, folder))
    return accounts.select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A cache of its own for each run, so that the query always encodes every distinct text of its table."""
    return token_counts.token_counts(documents(spark, folder), vocabulary("byte_bpe_50k.json"), new_path(spark, "token-cache"))


@query
def op5_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = topk.whole(topk.vectors(table(spark, folder, "embeddings")))
    return topk.top_k(rows, rows.where("id % 50 = 0"), 5)


ORACLES["op5_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op6_graph_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    rows = hnsw.nonzero(topk.vectors(table(spark, folder, "embeddings")))
    return hnsw.search(hnsw.build_index(rows, 20), rows.where("id % 20 = 0"), 20)


@query
def op2_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    archives = new_path(spark, "warc")
    warc.write(table(spark, folder, "pages"), archives)
    records = warc.read(spark, archives, keep_payload=False).where("kind = 'record'")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op2_warc_round_trip"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h,
    max(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS last_id FROM pages
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(1 + (i // 4) * 5 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN last_id IS NULL OR page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM p
"""


@query
def op10_similar_documents(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_documents(documents(spark, folder))


@query
def op4_quality_resampling(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return quality.resample(docs, quality.fit(docs, table(spark, folder, "labels")))


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, folder, "labels")))


@query
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(documents(spark, folder))


@query
def op11_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    cut = packing.pieces(documents(spark, folder), vocabulary("byte_bpe_50k.json"), outputs=("ids_crc32",))
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def with_period(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words of one document in ten give way to a periodic tail, by the checksum of its id; a null id has none."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    wanted = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return periods.periodic_runs(documents(spark, folder), outputs=wanted, rewrite=with_period)


@query
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    key = F.col("vec_id").cast("long")
    label = F.when(key % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = topk.whole(vectors.select(key.alias("id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("vector")))
    return negatives.hard_negatives(rows, F.col("id") % 50 == 0)


ORACLES["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, c.label = q.label AS same, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

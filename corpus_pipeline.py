"""A training corpus from ``documents``: good documents, one of each group of near copies, without secrets, mixed to
source weights, and encoded.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.running import running
from tabulon.llm import bpe, jaccard, mixing, quality, secrets
from tabulon.llm.common import documents, fresh, new_path, ship, table
from tabulon.llm.queries import vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws, by quality labels; the rest go. No text is shuffled."""
    ship(spark)
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by word 5-gram sets with a similarity of 0.8 and more, one document stays, that of the smallest
    doc_id (null last).

    Different texts under one doc_id are judged apart, also those under null; of rows that repeat doc_id and text one
    stays. Documents without words are no group and all stay.
    """
    ship(spark)
    return jaccard.one_of_each(docs, size=5, share=80, of=100)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked; n_chars follows the text."""
    ship(spark)
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, in whole documents.

    Sources weigh 3, 1, 2 in turn and share 150 % of all words; a source gives at most twice its words. What rounding to
    whole documents leaves is carried to the next document of like size in the same source, so a source's words miss its
    target by about its longest document, and long documents stay as often as short ones. Documents that the mix doesn't
    take go, those without words stay once. Rows of one doc_id and source count alike.
    """
    ship(spark)
    _, accounts = mixing.mix(docs)
    taken = accounts.where("size > 0").withColumn("part", F.col("taken") / F.col("size")).withColumn("mark", F.xxhash64("doc_id"))
    order = [F.col(c) for c in ("source", "size", "mark", "doc_id", "part")]
    upto = running(taken, order, {"upto": "part"})
    whole = lambda c: F.floor(F.round(c, 6) + 0.5)
    times = (whole(F.col("upto")) - whole(F.col("upto") - F.col("part"))).cast("int")
    counted = upto.select("doc_id", "source", times.alias("copies"))
    counted = counted.unionByName(accounts.where("size = 0").select("doc_id", "source", F.lit(1).alias("copies")))
    names = fresh(docs, "copies_id", "copies_source", "copies")
    counted = counted.groupBy("doc_id", "source").agg(F.max("copies").alias("copies")).where("copies > 0").toDF(*names)
    same = docs["doc_id"].eqNullSafe(counted[names[0]]) & docs["source"].eqNullSafe(counted[names[1]])
    rows = docs.join(counted, same)
    (copy,) = fresh(rows, "copy")
    repeated = rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(names[2]))))
    return repeated.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text with their number, and the text decoded from them as a digest."""
    ship(spark)
    wanted = ("ids", "n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.encode_decode(docs, vocabulary("word_bpe_49k.json"), keep=["doc_id", "source"], outputs=wanted)


STAGES = [
    ("quality_classifier", keep_good),
    ("near_copies", drop_near_copies),
    ("secret_masking", mask_secrets),
    ("source_mix", mix_sources),
    ("bpe_encoding", encode),
]

#: Hashes, forests and vocabularies are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

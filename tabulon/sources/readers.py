"""Scans S1-S5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tabulon.operators.textops import chunk_text


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ",", header: bool = True, multi_line: bool = False) -> DataFrame:
    """Delimited text; lines with too many fields are skipped, short ones padded with nulls.

    One field more than the schema is asked for: only an over-long line can fill it. Without a
    schema the types are inferred in a first pass.
    """
    options = {"header": header, "sep": sep, "multiLine": multi_line}
    if schema is None:
        schema = spark.read.options(**options, inferSchema=True).csv(path).schema
    wide = T.StructType([*schema.fields, T.StructField("__extra", T.StringType())])
    rows = spark.read.schema(wide).options(**options, mode="PERMISSIVE", enforceSchema=True).csv(path)
    return rows.filter("__extra is null").drop("__extra")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of a folder or glob: path, whole text, content hash."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"), content_hash("value").alias("source_id")
    )


def content_hash(column: str):
    """SHA-256 of a text as hex."""
    return F.sha2(F.col(column).cast("binary"), 256)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """S3: one row per non-blank line with its line number in the file; parsed when a schema is given.

    Large files are split. Within a split the read order numbers the lines; the line counts of the
    earlier splits of the same file give the offset. The source id hashes the path, because a hash
    of the content would need the whole file in one task.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.col("value").alias("text"),
    )
    blocks = raw.groupBy("source_path", "block").agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("source_path").orderBy("block")
    offsets = blocks.select("source_path", "block", (F.sum("n").over(over) - F.col("n")).alias("offset"))
    local = F.row_number().over(Window.partitionBy("source_path", "block").orderBy("seq")) - 1
    lines = raw.withColumn("local", local).join(offsets, ["source_path", "block"]).filter(F.trim("text") != "")
    out = lines.select(
        F.sha2(F.col("source_path"), 256).alias("source_id"), "source_path", (F.col("offset") + F.col("local")).alias("line_no"), F.trim("text").alias("text"),
    )
    return out if schema is None else out.withColumn("record", F.from_json("text", schema))


def document_chunks(docs: DataFrame, source_type: str, size: int = 1200, overlap: int = 150) -> DataFrame:
    """Documents as the five-field chunk table: source_id, source_path, source_type, chunk_no, text."""
    return chunk_text(docs, "text", size, overlap).select(
        "source_id", "source_path", F.lit(source_type).alias("source_type"), "chunk_no", F.col("chunk").alias("text")
    )


def combine_sources(parts: list[DataFrame], cap: int | None = None) -> DataFrame:
    """Several chunk tables in a fixed order; with ``cap`` only the first rows of it (a distributed top-k)."""
    out = None
    for rank, part in enumerate(parts):
        one = part.withColumn("source_rank", F.lit(rank))
        out = one if out is None else out.unionByName(one)
    ordered = out.orderBy("source_rank", "source_path", "chunk_no")
    return ordered if cap is None else ordered.limit(cap)

"""Sinks S6, S7."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def as_payload(df: DataFrame, text: str, key: list[str] | None = None) -> DataFrame:
    """Each row as a JSON document {text, artifacts, tables}."""
    rows = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    body = F.struct(
        F.lit(text).alias("text"), F.struct(F.array().cast("array<string>").alias("images")).alias("artifacts"), F.struct(rows.alias("row")).alias("tables"),
    )
    return df.select(*(key or []), F.to_json(body).alias("payload"))


def write_payload(df: DataFrame, path: str) -> None:
    """Payloads as JSON lines."""
    df.select("payload").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """A comparison table as parquet, csv, json or orc, written by the executors."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)

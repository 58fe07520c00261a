"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.session import BATCH_BYTES, BATCH_ROWS, cut_lineage, new_path, ship, table

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "cut_lineage", "documents", "fresh", "new_path", "ship", "slices", "table", "word_count"]

#: Bytes 0x20 and 0x09-0x0D separate words.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def word_count(text: Column | str) -> Column:
    """Number of runs of characters other than 0x20 and 0x09-0x0D; 0 for null.

    Each run shrinks to one letter before the count, so no array of words is built for a long text.
    """
    col = F.col(text) if isinstance(text, str) else text
    marks = F.translate(F.regexp_replace(col, WORD, "x"), SPACES, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with no column of ``df``, compared without case as Spark does."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(column: pa.Array, most_bytes: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column with about ``most_bytes`` each; a longer text has a range of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and held + n > most_bytes:
            yield start, i
            start, held = i, 0
        held += int(n)
    yield start, len(lengths)

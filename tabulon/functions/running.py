"""Running totals and row numbers over a whole table, without a window that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulon.session import cut_lineage


def running(table: DataFrame, order: list[Column], totals: dict[str, str] | None = None, number: str | None = None) -> DataFrame:
    """``table`` with running totals (new name: column) and the row number in this order, which should single out rows.

    Rows are dealt by ranges of the order. Each range has its own running totals, and the sums of the ranges before are
    added to them; these are one row per range, which is all that the driver sees. Nulls count as zero.
    """
    totals = totals or {}
    ranged = cut_lineage(table.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(totals.values())])
    ahead, rows = [0, *[0.0] * len(totals)], []
    for r in sorted(sums.collect()):
        rows.append((r["__part"], *ahead))
        ahead = [a + b for a, b in zip(ahead, r[1:], strict=True)]
    kinds = ", ".join(["__at int", "__n long", *[f"__s{i} double" for i in range(len(totals))]])
    before = table.sparkSession.createDataFrame(rows, kinds)
    upto = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(before, F.col("__part") == F.col("__at"))
    out = {name: F.coalesce(F.sum(c).over(upto).cast("double"), F.lit(0.0)) + F.col(f"__s{i}") for i, (name, c) in enumerate(totals.items())}
    if number:
        out[number] = F.row_number().over(upto) + F.col("__n")
    return joined.withColumns(out).select(*table.columns, *out)

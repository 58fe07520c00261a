"""Adding up fixed-size count arrays of many tasks without one task or the driver holding them all."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 14
FAN_IN = 64


def packed(counts: np.ndarray) -> bytes:
    return counts.astype("<u2" if counts.max(initial=0) < 1 << 16 else "<i8").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * CHUNK else "<i8").astype(np.int64)


def summed(df: DataFrame, size: int, count: Callable[[Iterator[pa.RecordBatch], np.ndarray], None], kind: type = np.int64) -> np.ndarray:
    """The sum over all tasks of the ``size`` counters that ``count`` raises in place for the batches of a task.

    ``size`` is a multiple of ``CHUNK`` and bounds what comes back; ``kind`` is the type of a task's own counters. Counts are added chunk by chunk on the executors:
    those of at most ``FAN_IN`` tasks in one group, then those of as many groups, until one row per chunk is left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        count(batches, total)
        parts = total.reshape(-1, CHUNK)
        used = np.flatnonzero(parts.any(1))
        for at in range(0, len(used), 32):
            now = used[at : at + 32]
            yield pa.RecordBatch.from_arrays([pa.array(now, pa.int64()), pa.array([packed(parts[i]) for i in now], pa.binary())], ["chunk", "counts"])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for raw in group["counts"]:
            total += unpacked(raw.as_py())
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([packed(total)], pa.binary())})

    tasks = max(1, df.rdd.getNumPartitions())
    rows = df.mapInArrow(run, "chunk long, counts binary").withColumn("part", F.spark_partition_id().cast("long"))
    while True:
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("chunk", "part").applyInArrow(add, "chunk long, part long, counts binary")
        tasks = -(-tasks // FAN_IN)
        if tasks == 1:
            break
    out = np.zeros((size // CHUNK, CHUNK), np.int64)
    for row in rows.select("chunk", "counts").toLocalIterator():
        out[row["chunk"]] = unpacked(row["counts"])
    return out.ravel()

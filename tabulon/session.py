"""Session helpers. Nothing here runs at import time."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cpus: int | str = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tabulon")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` if the cluster names one.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tabulon-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so that a lost executor loses nothing."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """An input of fewer files than cores, dealt out to all cores before heavy per-row work.

    Inputs of more files are split enough and left alone, so that they are not shuffled for nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def dealt(df: DataFrame, task_rows: int) -> DataFrame:
    """A kept table dealt out before many passes over it, if it has fewer partitions than cores or one of more rows than
    a task should read; a join by few keys before may have left most rows in one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    too_few = df.rdd.getNumPartitions() < cores or (sizes["most"] or 0) > task_rows
    return df.repartition(max(cores, -(-(sizes["n"] or 0) // task_rows))) if too_few else df


def keyed(df: DataFrame, keys: list[str], task_rows: int) -> DataFrame:
    """A table for a join and an aggregate by its keys, dealt out by them if Spark's number of shuffle partitions would
    give a task more than so many rows. The join needs that shuffle anyway."""
    parts = -(-df.count() // task_rows)
    return df.repartition(parts, *[F.col(f"`{k}`") for k in keys]) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


#: Rows of a table that may be sent to all tasks of a join.
SENT_ROWS = 50_000


def sent(df: DataFrame) -> DataFrame:
    """A table for one side of a join: sent to all tasks if it has at most ``SENT_ROWS`` rows, else joined by a shuffle.

    It is counted first, so it should be kept already or cheap to make.
    """
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


#: Rows and bytes of one Arrow batch between the JVM and a Python worker, at most (a longer row is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, for clusters whose nodes don't have it installed.

    Arrow batches of the session are made small: rows hold whole texts or sets, and the default of 10,000 rows would put
    hundreds of MB of them into each worker.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, None) or "-1"
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
    context = spark.sparkContext
    if getattr(context, "_tabulon_shipped", False):
        return
    root = Path(__file__).resolve().parent
    fd, path = tempfile.mkstemp(prefix="tabulon-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, Path(root.name) / file.relative_to(root))
    context.addPyFile(path)  # Spark serves it from the driver
    context._tabulon_shipped = True

"""Cutting lineage in folders that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


ROOT = str(Path(__file__).resolve().parents[2])


def found_by_workers(spark: SparkSession) -> None:
    """Let the Python workers find this package where the driver found it."""
    known = spark.sparkContext.environment
    if ROOT not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [known.get("PYTHONPATH"), ROOT]))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where it is unset in local mode."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="tripmill-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known


def stage(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again, so that what follows does
    not repeat what came before, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/tripmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Fixed value: rows that one task sorts or groups.
TASK_ROWS = 250_000


def spread(df: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """df dealt by keys to as many tasks as its rows need, so that the memory of a task does
    not grow with the table (adaptive execution joins partitions by their compressed bytes).
    A table that needs no more tasks than the session has cores stays as it is. The rows are
    counted, so df should be a table as it is read or written."""
    spark = df.sparkSession
    tasks = -(-df.count() // rows)
    if tasks <= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)

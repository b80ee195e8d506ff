"""What a session needs before Python functions of this library run on its workers."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch end at so many bytes: a batch of very long texts would otherwise hold 10,000 of them.
BATCH_BYTES = 8 << 20


def workers_find_library(spark: SparkSession) -> SparkSession:
    """Let workers import this library from where the driver has it (on a cluster that ships it otherwise this changes nothing),
    and bound the bytes of Arrow batches unless the session does.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root, environment = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([root, *paths])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: spark.checkpoint.dir, or the context's; a local session without one gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores dealt out to all of them, before work that costs far more than the shuffle; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """`df` written as a table to the shared folder and read again: lineage ends there, and rows that were numbered or dealt out keep their places."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

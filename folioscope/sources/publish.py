"""Tables published together: a version's folders are written first and the pointer to it last, so that a reader has the old tables or the new ones, never some of each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "version long, folder string, tables array<string>"


def pointer(spark: SparkSession, path: str) -> tuple[int, str, list[str]] | None:
    """The newest version, its folder and its tables; None before the first one. Of two writers of one version the later folder name stands, for all readers alike."""
    try:
        rows = spark.read.schema(POINTER).json(f"{path}/pointers")
        last = rows.agg(F.max(F.struct("version", "folder", "tables")).alias("p")).first()["p"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if last is None else (last["version"], last["folder"], last["tables"])


def publish(tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> int:
    """Write each table's allowed columns, and no others, as a new version, and return its number. A failure on the way leaves the version before as it is; a folder without a pointer is never read."""
    spark = next(iter(tables.values()))[0].sparkSession
    before = pointer(spark, path)
    version, folder = 1 + (before[0] if before else 0), f"version-{uuid.uuid4().hex}"
    for name, (table, columns) in tables.items():
        table.select(*columns).write.parquet(f"{path}/{folder}/{name}")
    # one row in one file: it is there as a whole or not at all
    spark.createDataFrame([(version, folder, list(tables))], POINTER).coalesce(1).write.mode("append").json(f"{path}/pointers")
    return version


def snapshot(spark: SparkSession, path: str) -> Callable[[str], DataFrame]:
    """A reader of the newest version's tables by name; it keeps to that version, whatever is published later."""
    found = pointer(spark, path)
    if found is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    _, folder, tables = found

    def read(name: str) -> DataFrame:
        if name not in tables:
            raise KeyError(f"no table {name}, only {', '.join(tables)}")
        return spark.read.parquet(f"{path}/{folder}/{name}")

    return read

"""A store of runs in JSON and Parquet: manifests, page artifacts, immutable snapshots, imports, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.urls import csv_field

MANIFEST = (
    "runId string, startedAt string, endedAt string, owner struct<pid:int,host:string>, target struct<type:string,name:string,productScope:string>, stages array<string>, "
    "protocol struct<graderModel:string,probeModel:string,probeEffort:string,mode:string,graderPromptSha:string>, protocolFingerprint string, status string, counts struct<expected:int,pages:int,failed:int>, cost double, _corrupt_record string"
)


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Manifests of all runs, newest first; files that don't parse are left out."""
    rows = spark.read.schema(MANIFEST).option("mode", "PERMISSIVE").json(f"{root}/runs/*/manifest.json", multiLine=True)
    return rows.where("_corrupt_record is null and runId is not null").drop("_corrupt_record").orderBy(F.desc("runId"))


def page_files(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, page_key, name, text) of the files in runs/<run>/pages/<page>/; old copies are left out."""
    path = F.col("_metadata.file_path")
    rows = spark.read.text(f"{root}/runs/*/pages/*/*", wholetext=True).select("value", path.alias("path"))
    part = lambda pattern: F.regexp_extract("path", pattern, 1)
    rows = rows.select(part("/runs/([^/]+)/").alias("run_id"), part("/pages/([^/]+)/").alias("page_key"), part("/([^/]+)$").alias("name"), F.col("value").alias("text"))
    return rows.where(~F.col("name").rlike(r"-old\.(?:md|json)$"))


def preferred_audit(files: DataFrame) -> DataFrame:
    """The audit of each page: a probe-informed one, else audit.md, else the first name."""
    rank = F.when(F.col("name") == "audit-probe-informed.md", 0).when(F.col("name") == "audit.md", 1).otherwise(2)
    audits = files.where(F.col("name").rlike(r"^audit.*\.md$"))
    best = audits.groupBy("run_id", "page_key").agg(F.min_by(F.struct("name", "text"), F.struct(rank, "name")).alias("a"))
    return best.select("run_id", "page_key", "a.name", "a.text")


def unwrapped_probes(sets: DataFrame) -> DataFrame:
    """(probe_set_id, probes) where a set may hold its probes under `probes.probes`: both are JSON texts in `body`."""
    inner = F.get_json_object("body", "$.probes.probes")
    return sets.select("probe_set_id", F.coalesce(inner, F.get_json_object("body", "$.probes")).alias("probes"))


def append_runs(new: DataFrame, path: str, key: str = "run_id") -> DataFrame:
    """Append the runs that the table at `path` doesn't hold, partitioned by run; runs are immutable. Returns what was appended."""
    spark = new.sparkSession
    try:
        held = spark.read.parquet(path).select(key).distinct()
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        held = None
    before = None if held is None else f"{path.rstrip('/')}-held-{uuid.uuid4().hex}"
    if held is not None:
        held.write.parquet(before)  # the names before this import, for the answer after it
        held = spark.read.parquet(before)
    fresh = new if held is None else new.join(held, key, "left_anti")
    # one file for each run of a hash partition: the rows of a run are dealt to one writer
    fresh.repartition(key).write.mode("append").partitionBy(key).parquet(path)
    after = spark.read.parquet(path).select(F.col(key).cast("string").alias(key)).distinct()
    return after if held is None else after.join(held.select(F.col(key).cast("string").alias(key)), key, "left_anti")


def import_account(held: DataFrame, new: DataFrame, cost: str, key: str = "run_id") -> DataFrame:
    """(imported, already, total, recovered, recovered_now) of a table of runs after an import: how many runs are `new` (keys), and the measured cost of all and of these. Runs without a measured cost count as runs only."""
    runs = held.groupBy(F.col(key).cast("string").alias("run")).agg(F.sum(cost).alias("cost"))
    marked = runs.join(new.select(F.col(key).cast("string").alias("run"), F.lit(True).alias("fresh")).distinct(), "run", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    money = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return marked.agg(F.count_if("fresh").alias("imported"), F.count_if(~F.col("fresh")).alias("already"), F.count("*").alias("total"), money(F.col("cost")).alias("recovered"), money(F.when(F.col("fresh"), F.col("cost"))).alias("recovered_now"))


def write_csv(table: DataFrame, path: str, order: list[str]) -> None:
    """RFC 4180 lines with CRLF and a header; unknown values are empty. One ordered partition for each range of the order."""
    line = F.concat_ws(",", *[csv_field(F.col(c)) for c in table.columns])
    rows = table.orderBy(*order).select(F.concat(line, F.lit("\r")).alias("value"))
    header = table.sparkSession.createDataFrame([(",".join(table.columns) + "\r",)], "value string")
    header.coalesce(1).union(rows).write.mode("overwrite").text(path)

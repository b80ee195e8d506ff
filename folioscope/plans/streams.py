"""Streams over the events table, read to their end; each result is that of the batch query in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope.session import shared_folder, workers_find_library
from folioscope.streaming import progress
from folioscope.streaming import runs as streams

STATUS = "CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'complete' WHEN 3 THEN 'interrupted' ELSE 'running' END"


def events(spark, sf_dir):
    """The events table as a stream of run statuses."""
    workers_find_library(spark)
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(kind).parquet(f"{sf_dir}/events.parquet*")
    return rows.select("event_id", F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("at"), F.expr(STATUS).alias("status"))


def finished(frame, mode: str):
    """What a stream has written to the shared folder when its input is read: its last batch in complete mode, all batches in append and update mode."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(streams.batch_writer(f"{path}/out")).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    if mode == "complete":
        out = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0])
    return out.drop("batch")


def stream_run_state(spark, sf_dir):
    # each micro-batch writes the runs that it changes; the row of the most changes is a run's last
    found = finished(streams.run_states(events(spark, sf_dir)), "update")
    return found.groupBy("run_id").agg(F.max_by("status", "changes").alias("status"), F.max("changes").alias("changes"))


def stream_windows(spark, sf_dir):
    found = finished(streams.windowed_counts(events(spark, sf_dir)), "complete")
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "status", "n")


def stream_transitions(spark, sf_dir):
    return finished(streams.checked_transitions(events(spark, sf_dir)), "append")


def stream_sessions(spark, sf_dir):
    found = finished(streams.sessions(events(spark, sf_dir)), "complete")
    return found.select("run_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


PAGE_EVENT = {"run_id": "user_id", "event_id": "event_id", "at": "CAST(ts AS timestamp)", "page": "CAST(event_id % 11 AS BIGINT)", "ok": "event_id % 13 > 0", "expected": "CASE WHEN event_id % 3 = 0 THEN CAST(6 + user_id % 5 AS BIGINT) END"}


def stream_progress(spark, sf_dir):
    """Pages done, failed and expected of each run after four micro-batches, of which the third holds the earliest events; `batches` counts those that changed a run."""
    workers_find_library(spark)
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(*[F.expr(e).alias(n) for n, e in PAGE_EVENT.items()], ((F.col("event_id") * 7 + 2) % 4).alias("part"))
    for part in range(4):
        rows.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{path}/in")
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", progress.PROVIDER)
    try:
        source = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        query = progress.progress(source).writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(progress.upsert(f"{path}/out")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return progress.current(spark.read.parquet(f"{path}/out")).select("run_id", F.col("version").alias("batches"), "done", "failed", "expected", "status")


SQL = {
    "stream_progress": """WITH e AS (SELECT user_id AS run_id, event_id, event_id % 11 AS page, event_id % 13 > 0 AS ok, CASE WHEN event_id % 3 = 0 THEN 6 + user_id % 5 END AS expected, (event_id * 7 + 2) % 4 AS part FROM events),
      p AS (SELECT run_id, page, arg_max(ok, event_id) AS ok FROM e GROUP BY ALL), c AS (SELECT run_id, count(*) FILTER (ok) AS done, count(*) FILTER (NOT ok) AS failed FROM p GROUP BY run_id), b AS (SELECT run_id, count(DISTINCT part) AS batches, max(expected) AS expected FROM e GROUP BY run_id)
      SELECT run_id, batches, done, failed, expected, CASE WHEN done + failed >= expected THEN 'finished' ELSE 'running' END AS status FROM b JOIN c USING (run_id)""",
    "stream_sessions": """WITH e AS (SELECT user_id AS run_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT run_id, ts, sum(new) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT run_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY run_id, s""",
    "stream_run_state": f"SELECT user_id AS run_id, max_by({STATUS}, (ts, event_id)) AS status, count(*) AS changes FROM events GROUP BY user_id",
    "stream_windows": f"SELECT strftime(ts, '%Y-%m-%d') AS day, {STATUS} AS status, count(*) AS n FROM events GROUP BY ALL",
    "stream_transitions": f"""WITH e AS (SELECT event_id, user_id AS run_id, {STATUS} AS status FROM events), p AS (SELECT run_id, event_id, lag(status) OVER (PARTITION BY run_id ORDER BY event_id) AS prior, status FROM e)
      SELECT *, prior IS NULL OR (prior || '>' || status) IN ('queued>running', 'queued>cancelled', 'running>complete', 'running>partial', 'running>cancelled', 'running>interrupted', 'interrupted>running') AS legal FROM p""",
}
QUERIES = [stream_progress, stream_run_state, stream_windows, stream_sessions, stream_transitions]

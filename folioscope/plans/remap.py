"""Entities of the library made from the driver's tables by integer arithmetic on keys, as DataFrames and as SQL text.

The tables hold no probe results, runs or audits; these mappings give each entity rows at the tables' scale, with nulls and ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RESULT_COLUMNS = {
    "run_id": "l_suppkey",
    "page_key": "l_partkey % 500",
    "mode": "CASE WHEN l_linestatus = 'F' THEN 'web' ELSE 'closed' END",
    "probe_id": "l_orderkey",
    "archetype": "concat('archetype-', CAST(l_partkey % 9 AS STRING))",
    "accuracy": "CAST(l_orderkey % 11 AS BIGINT)",
    "hallucination_free": "CAST(l_partkey % 11 AS BIGINT)",
    "relevance": "CAST(l_suppkey % 11 AS BIGINT)",
    "structure": "CAST(l_linenumber % 11 AS BIGINT)",
    "fidelity": "CASE WHEN l_linenumber < 7 THEN CAST(floor((l_orderkey % 11 + l_partkey % 11 + l_suppkey % 11 + l_linenumber % 11) * 2.5 + 0.5) AS BIGINT) END",
    "refusal": "l_linenumber = 7 AND l_returnflag = 'R'",
    "error": "CASE WHEN l_linenumber = 7 AND l_returnflag <> 'R' THEN 'overloaded' END",
    "subject_identified": "CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 7 > 0 END",
    "hit": "CASE WHEN l_linestatus = 'F' THEN l_returnflag = 'A' END",
    "via": "CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN CASE WHEN l_suppkey % 3 = 0 THEN 'mention' ELSE 'citation' END END",
    "tier": "CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_returnflag = 'A' THEN 'exact' WHEN l_suppkey % 4 = 0 THEN 'in-scope' WHEN l_suppkey % 4 = 1 THEN 'out-of-scope' ELSE 'none' END END",
    "search_degraded": "l_partkey % 13 = 0",
    "searches_attempted": "CASE WHEN l_linestatus = 'F' THEN CAST(l_linenumber % 4 AS BIGINT) END",
    "searches_succeeded": "CASE WHEN l_linestatus = 'F' THEN CAST(least(l_linenumber % 4, l_orderkey % 3) AS BIGINT) END",
    "claim": "CAST(l_partkey % 8 AS BIGINT)",
}
RUN_COLUMNS = {
    "run_id": "o_orderkey",
    "target_type": "CASE o_custkey % 3 WHEN 0 THEN 'product' WHEN 1 THEN 'watchlist' ELSE 'page' END",
    "target_name": "concat('t', CAST(o_custkey % 40 AS STRING))",
    "at": "o_orderdate",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'partial' ELSE 'cancelled' END",
    "grader_model": "substring(o_orderpriority, 1, 1)",
    "probe_effort": "CASE WHEN o_custkey % 10 > 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'high' ELSE 'low' END END",
    "probe_model": "CASE WHEN o_custkey % 20 <> 3 THEN concat('m', CAST(o_orderkey % 11 % 2 AS STRING)) END",
    "grader_prompt_sha": "CASE WHEN o_custkey % 20 <> 7 THEN substring(sha2(concat('prompt', CAST(o_orderkey % 13 % 3 AS STRING)), 256), 1, 12) END",
    "page_key": "o_custkey % 300",
    "mode": "CASE WHEN o_orderkey % 3 = 0 THEN 'closed' ELSE 'web' END",
    "score": "CASE WHEN o_orderkey % 4 > 0 THEN CAST((o_orderkey * 13 + o_custkey) % 101 AS BIGINT) END",
    "fidelity": "CASE WHEN o_orderkey % 5 > 0 THEN CAST((o_custkey * 7 + o_orderkey) % 101 AS BIGINT) END",
    "degraded": "CAST(o_orderkey % 6 AS BIGINT) * CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE 1 END",
    "failed": "CASE WHEN o_orderkey % 9 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END",
    "cost_cents": "CAST(o_orderkey % 977 AS BIGINT)",
}
CALL_COLUMNS = {
    "label": "event_type",
    "model": "CASE event_id % 5 WHEN 0 THEN 'large-20260101' WHEN 1 THEN 'large' WHEN 2 THEN 'medium' WHEN 3 THEN 'small' ELSE CASE WHEN event_type = 'click' THEN 'unlisted' ELSE 'small' END END",
    "input_tokens": "CAST(event_id * 37 % 4000 AS BIGINT)",
    "output_tokens": "CAST(event_id * 11 % 900 AS BIGINT)",
    "cache_read": "CAST(event_id * 17 % 20000 AS BIGINT)",
    "cache_write": "CAST(event_id * 7 % 3000 AS BIGINT)",
    "cache_write_1h": "CASE WHEN event_id % 4 = 0 THEN CAST(event_id * 7 % 3000 AS BIGINT) ELSE CAST(0 AS BIGINT) END",
    "service_tier": "CASE WHEN user_id % 3 = 0 THEN 'batch' WHEN user_id % 3 = 1 THEN 'standard' END",
    "run_id": "user_id",
    "ord": "event_id",
}
PRICE_ROWS = [("large", 5.0, 25.0), ("medium", 2.0, 10.0), ("small", 1.0, 5.0)]


def mapped(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in columns.items()])


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe results of `lineitem`."""
    return mapped(read(spark, sf_dir, "lineitem"), RESULT_COLUMNS).withColumn("live_search_failed", F.expr("mode = 'web' AND searches_attempted > 0 AND searches_succeeded = 0"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of `orders`, each of one page."""
    return mapped(read(spark, sf_dir, "orders"), RUN_COLUMNS)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of `events`."""
    return mapped(read(spark, sf_dir, "events"), CALL_COLUMNS)


def sql_of(columns: dict[str, str], table: str) -> str:
    """The same mapping for DuckDB, in which `at` is a reserved word."""
    rows = ", ".join(f"{e.replace('AS STRING', 'AS VARCHAR').replace('sha2(', 'sha256(').replace(", 256)", ")")} AS {'run_at' if n == 'at' else n}" for n, e in columns.items())
    return f"SELECT {rows} FROM {table}"


RESULTS = f"results AS (SELECT *, (mode = 'web' AND searches_attempted > 0 AND searches_succeeded = 0) AS live_search_failed FROM ({sql_of(RESULT_COLUMNS, 'lineitem')}))"
RUNS = f"runs AS ({sql_of(RUN_COLUMNS, 'orders')})"
CALLS = f"calls AS ({sql_of(CALL_COLUMNS, 'events')})"
PRICES = "prices(model, input, output) AS (VALUES " + ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in PRICE_ROWS) + ")"


def half_up(x: str, digits: int) -> str:
    return f"(floor(({x}) * {10**digits}.0::DOUBLE + 0.5) / {10**digits}.0::DOUBLE)"


def ratio(part: str, whole: str, digits: int | None = None) -> str:
    value = f"CASE WHEN ({whole}) > 0 THEN ({part})::DOUBLE / ({whole}) END"
    return value if digits is None else half_up(value, digits)

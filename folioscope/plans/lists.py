"""Watchlists, targets and published versions made from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope.operators.grouped import spread_wide
from folioscope.plans.remap import read, runs
from folioscope.session import shared_folder
from folioscope.sources import publish, watchlists

ORIGIN = "https://docs.example/any"
#: Pages of a list, by k: two that are one address, one off the origin, one that is no address, one that is no text.
PAGES = {"0": "concat('\"https://docs.example/p', k, '\"')", "1": "CASE WHEN k % 3 = 0 THEN concat('\"HTTPS://Docs.Example:443/p', k, '\"') ELSE '\"https://docs.example/q\"' END", "2": "CASE k % 4 WHEN 0 THEN '\"https://other.example/\"' WHEN 1 THEN '\"p 1\"' WHEN 2 THEN '17' ELSE '\"https://docs.example\"' END"}
LIST = f"""CASE WHEN k % 13 = 0 THEN '{{\"version\": 1, ' WHEN k % 13 = 1 THEN '[1]' ELSE concat('{{"version": ', CASE WHEN k % 5 = 0 THEN '2' WHEN k % 5 = 1 THEN '"1"' ELSE '1' END, CASE WHEN k % 7 > 0 THEN concat(', "name": "w', k, '"') ELSE '' END,
  ', "pages": [', CASE WHEN k % 11 = 0 THEN '' ELSE concat({PAGES["0"]}, ', ', {PAGES["1"]}, ', ', {PAGES["2"]}) END, ']}}') END"""
SPEC = "CASE k % 9 WHEN 0 THEN concat('product:p', k) WHEN 1 THEN 'watchlist:a:b' WHEN 2 THEN concat('page:https://docs.example/', k, ':8') WHEN 3 THEN 'page:docs.example' WHEN 4 THEN concat('https://docs.example/', k) WHEN 5 THEN 'product:' WHEN 6 THEN ' ' WHEN 7 THEN 'plain' END"


def list_texts(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")).select(F.format_string("list_%d", "k").alias("file"), F.expr(LIST).alias("value"))


def watchlist_problems(spark, sf_dir):
    """Every violation of lists that are files of their own."""
    path = f"{shared_folder(spark)}/lists-{uuid.uuid4().hex}"
    spread_wide(list_texts(spark, sf_dir), "file").write.partitionBy("file").text(path)
    return watchlists.watchlist_problems(watchlists.watchlist_texts(spark, path), ORIGIN)


def watchlist_pages(spark, sf_dir):
    """Pages of the lists without a violation."""
    texts = list_texts(spark, sf_dir).withColumnRenamed("value", "text")
    bad = watchlists.watchlist_problems(texts, ORIGIN).select("file").distinct()
    return watchlists.watchlist_pages(texts.join(bad, "file", "left_anti"), ORIGIN).withColumn("ord", F.col("ord").cast("long"))


def targets_resolved(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return watchlists.targets(rows.withColumn("spec", F.expr(SPEC))).select("k", "kind", "name", "problem")


def page_targets(spark, sf_dir):
    return watchlists.page_targets(targets_resolved(spark, sf_dir)).select("name", "url", "source", "included")


def published_versions(spark, sf_dir):
    """An index and its runs published twice: a reader of the first version keeps it, a later one has the second, and neither sees other columns."""
    path = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    rows = runs(spark, sf_dir)
    tables = lambda part: {"index": (part.groupBy("target_name").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.sum("cost_cents").alias("cost")), ["target_name", "n", "best"]), "runs": (part, ["run_id", "target_name", "score"])}
    publish.publish(tables(rows.where("run_id % 2 = 0")), path)
    first = publish.snapshot(spark, path)
    publish.publish(tables(rows), path)
    both = [(1, first), (2, publish.snapshot(spark, path))]
    parts = [version("index").join(version("runs").groupBy("target_name").agg(F.count("*").alias("rows")), "target_name").withColumn("version", F.lit(n)) for n, version in both]
    return parts[0].union(parts[1])


K = "SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 13 > 1"

WRONG = "CASE k % 9 WHEN 3 THEN 'no address' WHEN 4 THEN 'unknown kind' WHEN 5 THEN 'no name' WHEN 6 THEN 'empty' WHEN 7 THEN 'no kind' WHEN 8 THEN 'empty' END"
FULL = "k % 11 > 0"
SQL = {
    "watchlist_problems": f"""WITH s AS ({K}), p AS (SELECT k, 'version' AS problem, NULL::INTEGER AS position, CASE WHEN k % 5 = 0 THEN '2' ELSE '"1"' END AS value FROM s WHERE k % 5 < 2 UNION ALL SELECT k, 'name', NULL, NULL FROM s WHERE k % 7 = 0 UNION ALL SELECT k, 'pages', NULL, NULL FROM s WHERE k % 11 = 0
      UNION ALL SELECT k, 'duplicate', 1, 'HTTPS://Docs.Example:443/p' || k FROM s WHERE k % 3 = 0 AND {FULL} UNION ALL SELECT k, 'off-origin', 2, 'https://other.example/' FROM s WHERE k % 4 = 0 AND {FULL} UNION ALL SELECT k, 'not-an-address', 2, 'p 1' FROM s WHERE k % 4 = 1 AND {FULL} UNION ALL SELECT k, 'not-text', 2, '17' FROM s WHERE k % 4 = 2 AND {FULL}
      UNION ALL SELECT s_suppkey, CASE s_suppkey % 13 WHEN 0 THEN 'not-json' ELSE 'not-an-object' END, NULL, NULL FROM supplier WHERE s_suppkey % 13 < 2) SELECT 'list_' || k AS file, problem, position, value FROM p""",
    "watchlist_pages": f"""WITH s AS ({K} AND s_suppkey % 5 > 1 AND k % 7 > 0 AND k % 11 > 0 AND k % 3 > 0 AND k % 4 = 3) SELECT 'w' || k AS name, o AS ord, CASE o WHEN 0 THEN 'https://docs.example/p' || k WHEN 1 THEN 'https://docs.example/q' ELSE 'https://docs.example' END AS url, 'watchlist' AS source, true AS included FROM s, range(3) t(o)""",
    "targets_resolved": f"WITH c AS (SELECT c_custkey AS k FROM customer) SELECT k, CASE k % 9 WHEN 0 THEN 'product' WHEN 1 THEN 'watchlist' WHEN 2 THEN 'page' END AS kind, CASE k % 9 WHEN 0 THEN 'p' || k WHEN 1 THEN 'a:b' WHEN 2 THEN 'https://docs.example/' || k || ':8' END AS name, {WRONG} AS problem FROM c",
    "page_targets": "SELECT 'https://docs.example/' || c_custkey || ':8' AS name, 'https://docs.example/' || c_custkey || ':8' AS url, 'explicit' AS source, true AS included FROM customer WHERE c_custkey % 9 = 2",
    "published_versions": """SELECT 't' || o_custkey % 40 AS target_name, count(*) AS n, max(CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey * 13 + o_custkey) % 101 END) AS best, count(*) AS "rows", v AS version FROM orders, range(1, 3) t(v) WHERE v = 2 OR o_orderkey % 2 = 0 GROUP BY 1, v""",
}
QUERIES = [watchlist_problems, watchlist_pages, targets_resolved, page_targets, published_versions]

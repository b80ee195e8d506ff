"""Queries over probe runs of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import runs as operators
from folioscope.plans.remap import RESULTS, RUNS, half_up, ratio, results, runs


def prompts(rows):
    """The prompt that a result was asked, and the one that its probe has now: some have changed, some are gone."""
    old = F.concat(F.lit("p"), F.col("probe_id") % 20)
    return rows.withColumn("prompt", old), rows.where("probe_id % 17 > 0").select("page_key", "probe_id", F.when(F.col("probe_id") % 13 > 0, old).otherwise("changed").alias("prompt")).distinct()


def current_runs(spark, sf_dir):
    asked, now = prompts(results(spark, sf_dir))
    return operators.current_runs(asked, now, ["page_key", "run_id"], ["page_key"])


def primary_runs(spark, sf_dir):
    return operators.primary_runs(runs(spark, sf_dir).withColumn("current", F.col("run_id") % 3 > 0), ["page_key"])


def retrieval_normalised(spark, sf_dir):
    asked, now = prompts(results(spark, sf_dir))
    rows = asked.withColumn("new_hit", F.col("tier") == "exact").withColumn("new_via", F.when(F.col("accuracy") > 5, "citation"))
    found = operators.normal_retrieval(rows, now, ["page_key", "probe_id"])
    return found.groupBy("page_key", "origin").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.count("via").alias("vias"))


def run_page_means(spark, sf_dir):
    found = operators.run_page_means(runs(spark, sf_dir), ["target_name"])
    return found.select("target_name", *[F.round(c, 6).alias(c) for c in ("score", "fidelity")], "measured", "of_target")


def variance_table(spark, sf_dir):
    return operators.variance_table(runs(spark, sf_dir), ["page_key", "mode"])


def mean_spread(spark, sf_dir):
    return operators.mean_spread(runs(spark, sf_dir), ["target_type"], "page_key")


def arm_costs(spark, sf_dir):
    return operators.arm_costs(runs(spark, sf_dir), "mode")


def search_flags(spark, sf_dir):
    codes = F.filter(F.array(F.when(F.col("run_id") % 2 == 0, "unavailable"), F.when(F.col("run_id") % 3 == 0, "too_many_requests"), F.when(F.col("run_id") % 5 == 0, "invalid_input")), lambda c: c.isNotNull())
    return operators.search_flags(runs(spark, sf_dir).select("run_id", codes.alias("search_errors"))).select("run_id", F.col("n_errors").cast("long").alias("n_errors"), "retryable")


def product_counts(spark, sf_dir):
    urls = F.transform(F.sequence(F.lit(1).cast("long"), F.col("run_id") % 3 + 1), lambda i: F.concat(F.lit("u"), i))
    return operators.product_counts(runs(spark, sf_dir).select("target_name", urls.alias("expected_source_urls")), ["target_name"])


def run_formats(spark, sf_dir):
    rows = runs(spark, sf_dir)
    cost = F.when(F.col("run_id") % 10 > 0, F.col("cost_cents") / 100)
    return rows.select("run_id", operators.duration_text(F.col("run_id") * 7919).alias("took"), operators.money_text(cost).alias("money"), operators.gap(F.col("score"), F.col("fidelity")).alias("gap"), operators.day(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("day"))


PROMPTS = f"""WITH {RESULTS}, asked AS (SELECT *, 'p' || (probe_id % 20) AS prompt FROM results),
  now AS (SELECT DISTINCT page_key, probe_id, CASE WHEN probe_id % 13 > 0 THEN 'p' || (probe_id % 20) ELSE 'changed' END AS now_prompt FROM results WHERE probe_id % 17 > 0)"""
SQL = {
    "current_runs": f"{PROMPTS} SELECT page_key, run_id, bool_and(coalesce(prompt = now_prompt, false)) AS current FROM asked LEFT JOIN now USING (page_key, probe_id) GROUP BY page_key, run_id",
    "primary_runs": f"WITH {RUNS} SELECT page_key, run_id, mode FROM runs WHERE run_id % 3 > 0 QUALIFY row_number() OVER (PARTITION BY page_key ORDER BY mode = 'web' DESC, run_at DESC, run_id DESC) = 1",
    "retrieval_normalised": f"""{PROMPTS}, r AS (SELECT *, coalesce(prompt = now_prompt, false) AS same FROM asked LEFT JOIN now USING (page_key, probe_id)),
      v AS (SELECT page_key, CASE WHEN via IS NOT NULL THEN 'stored' WHEN same THEN 'recomputed' ELSE 'grader' END AS origin, CASE WHEN via IS NULL AND same THEN tier = 'exact' ELSE hit END AS h, CASE WHEN via IS NOT NULL THEN via WHEN same AND accuracy > 5 THEN 'citation' END AS w FROM r)
      SELECT page_key, origin, count(*) AS n, count(*) FILTER (h) AS hits, count(w) AS vias FROM v GROUP BY ALL""",
    "run_page_means": f"WITH {RUNS}, p AS (SELECT target_name, page_key, avg(score) AS s, avg(fidelity) AS f FROM runs GROUP BY ALL) SELECT target_name, round(avg(s), 6) AS score, round(avg(f), 6) AS fidelity, count(f) AS measured, count(*) AS of_target FROM p GROUP BY target_name",
    "variance_table": f"WITH {RUNS} SELECT page_key, mode, count(*) AS n, min(score) AS low, max(score) AS high, max(score) - min(score) AS range FROM runs WHERE score IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "mean_spread": f"WITH {RUNS}, p AS (SELECT target_type, page_key, max(score) - min(score) AS r FROM runs GROUP BY ALL) SELECT target_type, {half_up('avg(r)', 2)} AS mean_range FROM p GROUP BY target_type",
    "arm_costs": f"WITH {RUNS} SELECT CASE WHEN grouping(mode) = 1 THEN '(all)' ELSE mode END AS mode, count(*) AS calls, CAST(sum(cost_cents) AS BIGINT) AS cost_cents FROM runs GROUP BY ROLLUP (mode)",
    "search_flags": f"WITH {RUNS} SELECT run_id, (run_id % 2 = 0)::BIGINT + (run_id % 3 = 0)::BIGINT + (run_id % 5 = 0)::BIGINT AS n_errors, run_id % 5 > 0 AND (run_id % 2 = 0 OR run_id % 3 = 0) AS retryable FROM runs",
    "product_counts": f"WITH {RUNS} SELECT target_name, count(*) AS probes, count(*) FILTER (run_id % 3 > 0) AS multi_page, {ratio('count(*) FILTER (run_id % 3 > 0)', 'count(*)', 2)} AS multi_page_share FROM runs GROUP BY target_name",
    "run_formats": f"""WITH {RUNS}, d AS (SELECT *, run_id * 7919 // 1000 AS s FROM runs) SELECT run_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END AS took,
      CASE WHEN run_id % 10 > 0 THEN printf('$%.2f', cost_cents / 100) ELSE 'unpriced' END AS money, score - fidelity AS gap, strftime(run_at, '%Y-%m-%d') AS day FROM d""",
}
QUERIES = [current_runs, primary_runs, retrieval_normalised, run_page_means, variance_table, mean_spread, arm_costs, search_flags, product_counts, run_formats]

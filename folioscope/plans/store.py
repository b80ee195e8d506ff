"""Queries over runs and their projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import cost, probes, store, views
from folioscope.plans.remap import CALLS, PRICE_ROWS, PRICES, RESULTS, RUNS, calls, half_up, ratio, results, runs

AT = "strftime(run_at, '%Y-%m-%d %H:%M:%S')"


def text_time(df):
    return df.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


def latest_per_artifact(spark, sf_dir):
    found = store.latest_artifacts(runs(spark, sf_dir), ["page_key"], ["at"])
    return found.select("page_key", "score", "audit_run", "fidelity_web", "run_web", "fidelity_closed", "run_closed", "fidelity", "mode", "band")


def target_rollup(spark, sf_dir):
    rows = runs(spark, sf_dir).withColumn("grader", F.col("grader_model")).withColumn("band", store.band(F.col("score")))
    return store.target_rollup(rows, ["target_type", "target_name"])


def run_health(spark, sf_dir):
    return store.run_health(runs(spark, sf_dir), ["page_key"])


def trend_points(spark, sf_dir):
    return text_time(store.trend_points(runs(spark, sf_dir)))


def trend_segments(spark, sf_dir):
    return store.trend_segments(store.trend_points(runs(spark, sf_dir))).select("target", "run_id", "score", "segment")


def trend_discontinuities(spark, sf_dir):
    return text_time(store.discontinuities(store.trend_points(runs(spark, sf_dir))))


def trend_delta(spark, sf_dir):
    return store.trend_delta(store.trend_points(runs(spark, sf_dir)))


def status_transitions(spark, sf_dir):
    """Statuses of a page's runs in order of time, as if they were one run's."""
    kind = F.get(F.array(*map(F.lit, ("queued", "running", "complete", "interrupted", "running"))), (F.col("run_id") % 5).cast("int"))
    events = runs(spark, sf_dir).select(F.col("page_key").alias("run_id"), F.col("run_id").alias("ord"), kind.alias("status"))
    return store.illegal_transitions(events)


def reconcile_runs(spark, sf_dir):
    rows = runs(spark, sf_dir).select("run_id", F.concat(F.lit("host"), F.col("page_key") % 7).alias("host"), (F.col("run_id") % 50).alias("pid"), F.when(F.col("status") == "partial", "running").otherwise(F.col("status")).alias("status"))
    alive = spark.range(100).select(F.concat(F.lit("host"), F.col("id") % 5).alias("host"), (F.col("id") % 50).alias("pid"), (F.col("id") % 3 > 0).alias("alive"))
    return store.reconcile(rows, alive).select("run_id", "host", "pid", "status")


def reusable_artifacts(spark, sf_dir):
    rows = runs(spark, sf_dir).select("page_key", "run_id", "at", (F.col("run_id") % 3).alias("content_hash"), "grader_model", (F.col("status") == "complete").alias("complete"))
    return store.reusable(rows.select("page_key", "content_hash", "grader_model", "at", "run_id"), rows, ["grader_model"]).select("page_key", "run_id", "reused_run")


def coverage_by_target(spark, sf_dir):
    return store.coverage(runs(spark, sf_dir), ["target_name"])


def append_points(spark, sf_dir):
    points = store.trend_points(runs(spark, sf_dir))
    again = points.where("run_id % 5 = 0").withColumn("score", F.col("score") + 1)
    return store.append_points(points.where("run_id % 7 > 0"), again).select("run_id", "target", "score")


def run_groups(spark, sf_dir):
    return views.run_groups(runs(spark, sf_dir), "target_name").withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


def prices(spark):
    return spark.createDataFrame(PRICE_ROWS, cost.PRICES)


def cost_tally_rollup(spark, sf_dir):
    return cost.tally(cost.priced(calls(spark, sf_dir), prices(spark)))


def usage_fold(spark, sf_dir):
    return cost.folded_usage(calls(spark, sf_dir), ["run_id"], "ord")


def cost_estimate(spark, sf_dir):
    return cost.estimate(runs(spark, sf_dir).select("target_name", "page_key").distinct(), ["target_name"], 6, "web")


def page_index(spark, sf_dir):
    found = store.latest_artifacts(runs(spark, sf_dir), ["page_key"], ["at"])
    return store.page_index(found, ["page_key", "score", "band", "fidelity", "mode"])


def corpus_summary(spark, sf_dir):
    found = store.latest_artifacts(runs(spark, sf_dir), ["page_key"], ["at"])
    key = F.col("page_key")
    return probes.corpus_summary(found.select("score", "fidelity", (key % 5).alias("hits"), (key % 5 + key % 3).alias("judged"), F.concat(F.lit("g"), key % 2).alias("grader")))


def recommendations_by_priority(spark, sf_dir):
    one = lambda p: F.struct(F.lit(p).cast("int").alias("priority"), F.lit("t").alias("title"))
    audits = runs(spark, sf_dir).select("target_name", F.filter(F.array(one(1), one(2), one(3)), lambda r: F.col("run_id") % (r["priority"] + 1) == 0).alias("recommendations"))
    return probes.recommendations(audits, ["target_name"])


def batch_results(spark, sf_dir):
    rows = runs(spark, sf_dir)
    sent = rows.select(F.col("run_id").alias("custom_id"), "page_key")
    back = rows.where("run_id % 4 > 0").select(F.col("run_id").alias("custom_id"), F.when(F.col("run_id") % 9 > 0, F.col("target_name")).alias("body"), F.when(F.col("run_id") % 9 == 0, "overloaded").alias("error"))
    return probes.batch_results(sent, back)


def regrade_means(spark, sf_dir):
    rows = results(spark, sf_dir).where("mode = 'web'").select("page_key", F.col("probe_id"), "fidelity").groupBy("page_key", "probe_id").agg(F.max("fidelity").alias("fidelity"))
    again = rows.withColumn("fidelity", F.when(F.col("probe_id") % 11 > 0, (F.col("fidelity") * 3 + F.col("probe_id")) % 101))
    return probes.regrade_means(rows, again, ["page_key"])


BAND = lambda x: f"CASE WHEN {x} >= 85 THEN 'excellent' WHEN {x} >= 70 THEN 'strong' WHEN {x} >= 55 THEN 'good' WHEN {x} >= 40 THEN 'fair' WHEN {x} >= 0 THEN 'poor' END"
NEWEST = lambda value, when: f"(max_by({value}, (run_at, run_id)) FILTER ({when}))"
POINTS = f"""WITH {RUNS}, points AS (SELECT run_id, run_at, target_type || ':' || target_name AS target, score, fidelity, concat_ws('|', grader_model, coalesce(probe_model, 'unknown'), coalesce(probe_effort, 'unknown'), mode, coalesce(grader_prompt_sha, 'unknown')) AS fingerprint, probe_model IS NOT NULL AND probe_effort IS NOT NULL AND grader_prompt_sha IS NOT NULL AS protocol_known
  FROM runs WHERE status = 'complete'), keyed AS (SELECT *, CASE WHEN protocol_known THEN fingerprint ELSE 'unknown:' || run_id END AS key FROM points)"""
CHANGED = ", ".join(f"CASE WHEN string_split(fingerprint, '|')[{i}] <> string_split(prior_fingerprint, '|')[{i}] THEN '{name} changed' END" for i, name in enumerate(("grader", "probe model", "effort", "mode", "grader prompt"), 1))
LINE = lambda total: half_up(total, 2)
UNITS = {"audit": "n * 0.1748::DOUBLE", "probe_generation": "n * 6 * 0.0583::DOUBLE", "probe_test": "n * 6 * 0.2737::DOUBLE"}
SQL = {
    "latest_per_artifact": f"""WITH {RUNS}, l AS (SELECT page_key, {NEWEST('score', 'score IS NOT NULL')} AS score, {NEWEST('run_id', 'score IS NOT NULL')} AS audit_run,
      {", ".join(f"{NEWEST(v, f'fidelity IS NOT NULL AND mode = {m!r}')} AS {n}_{m}" for m in ("web", "closed") for v, n in (("fidelity", "fidelity"), ("run_id", "run")))} FROM runs GROUP BY page_key)
      SELECT *, CASE WHEN run_web IS NOT NULL THEN fidelity_web ELSE fidelity_closed END AS fidelity, CASE WHEN run_web IS NOT NULL THEN 'web' WHEN run_closed IS NOT NULL THEN 'closed' END AS mode, {BAND('score')} AS band FROM l""",
    "target_rollup": f"""WITH {RUNS}, b AS (SELECT *, {BAND('score')} AS band FROM runs) SELECT target_type, target_name, count(*) AS pages, count(score) AS audited, {half_up('avg(score)', 1)} AS mean_score, min(score) AS min_score, max(score) AS max_score,
      {half_up('avg(fidelity)', 1)} AS mean_fidelity, string_agg(DISTINCT grader_model, ',' ORDER BY grader_model) AS graders, {", ".join(f"count(*) FILTER (band = '{x}') AS band_{x}" for x in ("excellent", "strong", "good", "fair", "poor"))} FROM b GROUP BY ALL""",
    "run_health": f"WITH {RUNS} SELECT page_key, CAST(sum(degraded) AS BIGINT) AS degraded, CAST(sum(failed) AS BIGINT) AS failed, bool_and(degraded = 0 AND failed = 0) AS clean FROM runs GROUP BY page_key",
    "trend_points": f'{POINTS} SELECT run_id, {AT} AS "at", target, score, fidelity, fingerprint, protocol_known FROM points',
    "trend_segments": f"""{POINTS}, f AS (SELECT *, CASE WHEN key IS NOT DISTINCT FROM lag(key) OVER w THEN 0 ELSE 1 END AS new FROM keyed WHERE score IS NOT NULL WINDOW w AS (PARTITION BY target ORDER BY run_at, run_id))
      SELECT target, run_id, score, CAST(sum(new) OVER (PARTITION BY target ORDER BY run_at, run_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM f""",
    "trend_discontinuities": f"""{POINTS}, p AS (SELECT *, lag(key) OVER w AS prior, lag(protocol_known) OVER w AS prior_known, lag(fingerprint) OVER w AS prior_fingerprint FROM keyed WINDOW w AS (PARTITION BY target ORDER BY run_at, run_id))
      SELECT target, run_id, {AT} AS "at", CASE WHEN NOT protocol_known OR NOT prior_known THEN 'protocol unknown' ELSE concat_ws(', ', {CHANGED}) END AS reason FROM p WHERE prior IS NOT NULL AND prior <> key""",
    "trend_delta": f"""{POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY run_at DESC, run_id DESC) AS r FROM keyed WHERE score IS NOT NULL)
      SELECT a.target, a.score AS last, CASE WHEN a.key = b.key THEN a.score - b.score END AS delta FROM r a LEFT JOIN r b ON a.target = b.target AND b.r = 2 WHERE a.r = 1""",
    "status_transitions": f"""WITH {RUNS}, e AS (SELECT page_key AS run_id, run_id AS ord, (['queued', 'running', 'complete', 'interrupted', 'running'])[run_id % 5 + 1] AS status FROM runs), p AS (SELECT *, lag(status) OVER (PARTITION BY run_id ORDER BY ord) AS prior FROM e)
      SELECT * FROM p WHERE prior IS NOT NULL AND (prior || '>' || status) NOT IN ('queued>running', 'queued>cancelled', 'running>complete', 'running>partial', 'running>cancelled', 'running>interrupted', 'interrupted>running')""",
    "reconcile_runs": f"""WITH {RUNS}, r AS (SELECT run_id, 'host' || (page_key % 7) AS host, run_id % 50 AS pid, CASE WHEN status = 'partial' THEN 'running' ELSE status END AS status FROM runs),
      a AS (SELECT 'host' || (i % 5) AS host, i % 50 AS pid, i % 3 > 0 AS alive FROM range(100) t(i))
      SELECT run_id, host, pid, CASE WHEN status = 'running' AND host IN (SELECT host FROM a) AND NOT EXISTS (SELECT 1 FROM a WHERE a.host = r.host AND a.pid = r.pid AND alive) THEN 'interrupted' ELSE status END AS status FROM r""",
    "reusable_artifacts": f"""WITH {RUNS} SELECT a.page_key, a.run_id, max_by(b.run_id, (b.run_at, b.run_id)) FILTER (b.run_at < a.run_at) AS reused_run FROM runs a LEFT JOIN runs b
      ON a.page_key = b.page_key AND a.run_id % 3 = b.run_id % 3 AND a.grader_model = b.grader_model AND b.status = 'complete' GROUP BY a.page_key, a.run_id""",
    "coverage_by_target": f"WITH {RUNS} SELECT target_name, count(*) AS pages, {ratio('count(score)', 'count(*)', 2)} AS scored, {ratio('count(fidelity)', 'count(*)', 2)} AS probed FROM runs GROUP BY target_name",
    "append_points": f"""{POINTS} SELECT run_id, target, CASE WHEN run_id % 5 = 0 THEN score + 1 ELSE score END AS score FROM points WHERE run_id % 7 > 0 OR run_id % 5 = 0""",
    "run_groups": f"WITH {RUNS} SELECT target_name, count(*) AS runs, strftime(max(run_at), '%Y-%m-%d %H:%M:%S') AS last_at, CAST(sum(cost_cents) AS BIGINT) AS cost_cents, count(*) FILTER (status <> 'complete') AS incomplete FROM runs GROUP BY target_name",
    "cost_tally_rollup": f"""WITH {CALLS}, {PRICES}, priced AS (SELECT c.*, (p.input * (input_tokens + greatest(cache_write - cache_write_1h, 0) * 1.25::DOUBLE + cache_write_1h * 2.0::DOUBLE + cache_read * 0.1::DOUBLE) + p.output * output_tokens) / 1e6 * CASE WHEN service_tier = 'batch' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS cost
      FROM calls c LEFT JOIN prices p ON regexp_replace(c.model, '-\\d{{8}}$', '') = p.model)
      SELECT CASE WHEN grouping(label) = 1 THEN '(all)' ELSE label END AS label, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CASE WHEN bool_and(cost IS NOT NULL) THEN {half_up('sum(cost)', 4)} END AS cost,
      {ratio('sum(cache_read)', 'sum(cache_read) + sum(input_tokens) + sum(cache_write)', 3)} AS cache_hit_rate FROM priced GROUP BY ROLLUP (label)""",
    "usage_fold": f"WITH {CALLS} SELECT run_id, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('input_tokens', 'output_tokens', 'cache_read', 'cache_write'))}, max_by(service_tier, ord) FILTER (service_tier IS NOT NULL) AS service_tier FROM calls GROUP BY run_id",
    "cost_estimate": f"""WITH {RUNS}, n AS (SELECT target_name, count(DISTINCT page_key) AS n FROM runs GROUP BY target_name), l AS (SELECT target_name, n AS pages, {", ".join(f"{half_up(v, 4)} AS {k}" for k, v in UNITS.items())} FROM n)
      SELECT *, {half_up('0.0::DOUBLE + audit + probe_generation + probe_test', 2)} AS total, {half_up('(0.0::DOUBLE + audit + probe_generation + probe_test) * (1 - 0.3::DOUBLE)', 2)} AS low, {half_up('(0.0::DOUBLE + audit + probe_generation + probe_test) * (1 + 0.3::DOUBLE)', 2)} AS high FROM l""",
}
LATEST = SQL["latest_per_artifact"]
SQL |= {
    "page_index": f"SELECT page_key, score, band, fidelity, mode FROM ({LATEST})",
    "corpus_summary": f"""WITH p AS (SELECT score, fidelity, page_key % 5 AS hits, page_key % 5 + page_key % 3 AS judged, 'g' || (page_key % 2) AS grader FROM ({LATEST})),
      a AS (SELECT count(*) AS pages, count(score) AS scored, count(fidelity) AS probed, {half_up('avg(score)', 1)} AS mean_score, {half_up('quantile_cont(score, 0.5)', 1)} AS median_score, {half_up('avg(fidelity)', 1)} AS mean_fidelity, {half_up('quantile_cont(fidelity, 0.5)', 1)} AS median_fidelity,
        {ratio('sum(hits)', 'sum(judged)', 2)} AS hit_rate, string_agg(DISTINCT grader, ',' ORDER BY grader) AS graders, count(DISTINCT grader) > 1 AS mixed_graders FROM p)
      SELECT *, concat_ws('; ', CASE WHEN scored < pages THEN (pages - scored) || ' page(s) without an audit' END, CASE WHEN probed < pages THEN (pages - probed) || ' page(s) without graded probes' END, CASE WHEN mixed_graders THEN 'graders differ' END) AS notes FROM a""",
    "recommendations_by_priority": f"WITH {RUNS}, r AS (SELECT target_name, unnest([1, 2, 3]) AS p, run_id FROM runs) SELECT target_name, count(*) FILTER (p = 1) AS p1, count(*) FILTER (p = 2) AS p2, count(*) FILTER (p = 3) AS p3, count(*) AS n FROM r WHERE run_id % (p + 1) = 0 GROUP BY target_name",
    "batch_results": f"WITH {RUNS} SELECT run_id AS custom_id, page_key, CASE WHEN run_id % 4 > 0 AND run_id % 9 > 0 THEN target_name END AS body, CASE WHEN run_id % 4 = 0 THEN 'missing from the batch' WHEN run_id % 9 = 0 THEN 'overloaded' END AS error FROM runs",
    "regrade_means": f"""WITH {RESULTS}, o AS (SELECT page_key, probe_id, max(fidelity) AS old FROM results WHERE mode = 'web' GROUP BY ALL), b AS (SELECT *, CASE WHEN probe_id % 11 > 0 THEN (old * 3 + probe_id) % 101 END AS new FROM o)
      SELECT page_key, count(*) AS n, {half_up('avg(old)', 1)} AS mean_before, {half_up('avg(new)', 1)} AS mean_after, {half_up('avg(new - old)', 1)} AS shift FROM b WHERE old IS NOT NULL AND new IS NOT NULL GROUP BY page_key""",
}
QUERIES = [page_index, corpus_summary, recommendations_by_priority, batch_results, regrade_means, latest_per_artifact, target_rollup, run_health, trend_points, trend_segments, trend_discontinuities, trend_delta, status_transitions, reconcile_runs, reusable_artifacts, coverage_by_target, append_points, run_groups, cost_tally_rollup, usage_fold, cost_estimate]

"""Queries with the semantics of a reader's tables: search, sort, pages, groups, selections, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import urls
from folioscope.functions.num import band
from folioscope.operators import views
from folioscope.plans.remap import RESULTS, RUNS, half_up, read, results, runs
from folioscope.sources import ledger


def table_search_sort_page(spark, sf_dir):
    found = views.search(runs(spark, sf_dir), "t1", ["target_name", "status"])
    return views.page_of(found, [views.order("score", ascending=False), F.asc("run_id")], 3, 50).select("run_id", "target_name", "status", "score")


def group_ordinal(spark, sf_dir):
    return views.groups(runs(spark, sf_dir), band(F.col("score")), ["excellent", "strong", "good", "fair", "poor"])


def group_summary(spark, sf_dir):
    return views.group_summary(runs(spark, sf_dir), "target_name")


def dimension_means(spark, sf_dir):
    dims = results(spark, sf_dir).select("page_key", F.col("archetype").alias("name"), F.col("accuracy").alias("score"))
    return views.dimension_means(dims, "page_key")


def systemic_dimensions(spark, sf_dir):
    dims = results(spark, sf_dir).select(F.col("page_key").alias("page"), (F.col("page_key") % 20).alias("product"), F.col("archetype").alias("name"), F.col("relevance").alias("score"))
    return views.systemic(dims, "product", "page")


def probe_matrix(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("model", F.concat(F.lit("m"), F.col("run_id") % 3)).withColumn("probe_id", F.col("probe_id") % 500)
    all_runs = rows.select("model", "mode", "run_id").distinct().withColumn("at", F.col("run_id") * 7 % 101)
    columns = [f"m{i}|{mode}" for i in range(3) for mode in ("closed", "web")]
    found = views.matrix(rows.select("probe_id"), all_runs, rows.select("run_id", "probe_id", "fidelity"), columns)
    return found.select("probe_id", *[F.col(f"`{c}`").alias(c.replace("|", "_")) for c in columns])


def uniqueness_violations(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return views.uniqueness_violations(pages.select(urls.page_key(F.col("url")).alias("page_key"), "url"), "page_key", "url").withColumn("values", F.array_join("values", " "))


def url_normalize(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", urls.normalize_url(F.col("url")).alias("key"), urls.host_of(F.col("url")).alias("host"), urls.page_key(F.col("url")).alias("page_key"), urls.slug(F.col("url")).alias("slug"), urls.product_of(F.col("url")).alias("product"))


def ledger_full_outer(spark, sf_dir):
    curated = read(spark, sf_dir, "part").where("p_partkey % 3 > 0").select((F.col("p_size") % 10).alias("product"), F.concat(F.lit("https://docs.example/"), F.col("p_partkey")).alias("url"))
    sitemap = read(spark, sf_dir, "part").where("p_partkey % 4 > 0").select((F.col("p_size") % 10).alias("product"), F.concat(F.lit("https://docs.example/"), F.col("p_partkey")).alias("url"))
    return ledger.ledger(curated, sitemap, "curated", ("product",))


def ledger_counts(spark, sf_dir):
    return ledger.ledger_counts(ledger_full_outer(spark, sf_dir), ("product",))


def changed_since(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    now = part.select(F.col("p_partkey").alias("url"), F.when(F.col("p_partkey") % 9 > 0, urls.short_hash(F.col("p_name"))).alias("content_hash"))
    before = part.where("p_partkey % 5 > 0").select(F.col("p_partkey").alias("url"), urls.short_hash(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.col("p_type"))).alias("content_hash"))
    return ledger.changed_since(now, before)


def context_budget_fill(spark, sf_dir):
    pages = read(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").alias("bytes"), F.ceil((F.length("text") + F.length("lang") + 20) / 3.6).cast("long").alias("cost"))
    return views.budget_fill(pages, ["source"], "bytes", "cost", ["doc_id"], 20_000)


def sample_selection(spark, sf_dir):
    found = results(spark, sf_dir).where("accuracy < 4").select("run_id", F.col("page_key").alias("url"), (10 - F.col("accuracy")).alias("impact"), F.col("probe_id").alias("ord"))
    return views.samples(found.groupBy("run_id", "url").agg(F.max("impact").alias("impact"), F.min("ord").alias("ord")), ["run_id"], 6)


def stratified_pick(spark, sf_dir):
    rows = runs(spark, sf_dir).where("score is not null").select("target_name", "run_id", "score")
    return views.even_spaced(rows, ["target_name"], ["score", "run_id"], 5)


def round_robin_sections(spark, sf_dir):
    rows = runs(spark, sf_dir).select("target_name", "run_id")
    return views.round_robin(rows, "target_name", [F.asc(F.col("run_id") * 7919 % 10007), F.asc("run_id")], 4)


def next_actions(spark, sf_dir):
    rows = runs(spark, sf_dir)
    return rows.select("run_id", views.next_action(F.col("run_id") % 3 > 0, F.col("fidelity").isNotNull()).alias("action"), views.recoverable(F.lit(10), F.when(F.col("run_id") % 11 < 10, F.col("run_id") % 11)).alias("recoverable"))


def stage_times(spark, sf_dir):
    names = ["extract", "audit", "probes", "test"]
    durations = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), (F.col("run_id") * (i + 3) % 1000).cast("long"))])
    return views.stage_times(runs(spark, sf_dir).withColumn("durations", durations), ["target_type"])


def last_lines(spark, sf_dir):
    return views.last_lines(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", 20)


def fatal_errors(spark, sf_dir):
    kinds = ["billing hard limit", "rate_limit exceeded while billing", "Overloaded", "invalid_api_key", "timeout", "quota has been exceeded", "status 529 billing", None]
    text = F.get(F.array(*[F.lit(k).cast("string") for k in kinds]), (F.col("event_id") % len(kinds)).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", urls.is_fatal(text).alias("fatal"))


def csv_lines(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_name"), F.lit(', "x"'))).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).alias("name"), "p_size")
    return part.select("p_partkey", F.concat_ws(",", *[urls.csv_field(F.col(c)) for c in ("p_partkey", "name", "p_size")]).alias("line"))


DIMENSION = lambda inner, outer, digits: f"SELECT name, count(*) AS {outer}, {half_up('avg(m)', digits)} AS mean FROM ({inner}) GROUP BY name"
LEDGER = """curated AS (SELECT DISTINCT p_size % 10 AS product, 'https://docs.example/' || p_partkey AS url, true AS c FROM part WHERE p_partkey % 3 > 0),
  sitemap AS (SELECT DISTINCT p_size % 10 AS product, 'https://docs.example/' || p_partkey AS url, true AS s FROM part WHERE p_partkey % 4 > 0),
  ledger AS (SELECT product, url, CASE WHEN c AND s THEN 'both' WHEN c THEN 'llms.txt' ELSE 'sitemap' END AS source, coalesce(c, false) AS included, CASE WHEN c IS NULL THEN 'not-in-curated-index' END AS reason FROM curated FULL JOIN sitemap USING (product, url))"""
PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
SEGMENTS = f"list_filter(string_split({PATH}, '/'), lambda s: s <> '')"
HOST = r"regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1), '^www\.', '')"
DASHED = lambda x: f"lower(regexp_replace(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9-]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'))"
KEY = DASHED(f"CASE WHEN len({SEGMENTS}) > 0 THEN array_to_string({SEGMENTS}, '-') ELSE {HOST} END")
FILL = """WITH RECURSIVE p AS (SELECT source, doc_id, CAST(ceil((length(text) + length(lang) + 20) / 3.6::DOUBLE) AS BIGINT) AS cost, row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id) AS i FROM documents),
  f AS (SELECT source, doc_id, cost, i, cost <= 20000 AS used, CASE WHEN cost <= 20000 THEN cost ELSE 0 END AS total FROM p WHERE i = 1
    UNION ALL SELECT p.source, p.doc_id, p.cost, p.i, f.total + p.cost <= 20000, CASE WHEN f.total + p.cost <= 20000 THEN f.total + p.cost ELSE f.total END FROM f JOIN p ON p.source = f.source AND p.i = f.i + 1)
  SELECT source, doc_id, cost, used FROM f"""
SQL = {
    "table_search_sort_page": f"WITH {RUNS} SELECT run_id, target_name, status, score FROM runs WHERE contains(lower(target_name), 't1') OR contains(lower(status), 't1') ORDER BY score DESC NULLS LAST, run_id LIMIT 50 OFFSET 100",
    "group_ordinal": f"""WITH {RUNS}, g AS (SELECT CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'strong' WHEN score >= 55 THEN 'good' WHEN score >= 40 THEN 'fair' WHEN score >= 0 THEN 'poor' ELSE '(none)' END AS "group", count(*) AS size FROM runs GROUP BY 1)
      SELECT "group", size, CAST(row_number() OVER (ORDER BY "group" = '(none)', list_position(['excellent', 'strong', 'good', 'fair', 'poor'], "group")) AS INTEGER) AS place FROM g""",
    "group_summary": f"WITH {RUNS} SELECT target_name, count(*) AS pages, {half_up('avg(score)', 1)} AS mean_score, count(fidelity) AS measured, {half_up('avg(fidelity)', 1)} AS mean_fidelity, {half_up('count(fidelity)::DOUBLE / count(*)', 2)} AS coverage FROM runs GROUP BY target_name",
    "dimension_means": f"WITH {RESULTS} " + DIMENSION("SELECT page_key, archetype AS name, avg(accuracy) AS m FROM results GROUP BY ALL", "n", 1),
    "systemic_dimensions": f"WITH {RESULTS} " + DIMENSION("SELECT page_key % 20 AS product, archetype AS name, avg(relevance) AS m FROM results GROUP BY ALL", "products", 2),
    "probe_matrix": f"""WITH {RESULTS}, r AS (SELECT run_id, mode, 'm' || (run_id % 3) AS model, probe_id % 500 AS probe_id, fidelity FROM results), n AS (SELECT model, mode, max_by(run_id, (run_id * 7 % 101, run_id)) AS run_id FROM r GROUP BY ALL)
      SELECT p.probe_id, {", ".join(f"max(fidelity) FILTER (model = 'm{i}' AND mode = '{m}') AS m{i}_{m}" for i in range(3) for m in ("closed", "web"))}
      FROM (SELECT DISTINCT probe_id FROM r) p LEFT JOIN (SELECT r.probe_id, n.model, n.mode, r.fidelity FROM r JOIN n ON r.run_id = n.run_id) c ON p.probe_id = c.probe_id GROUP BY p.probe_id""",
    "uniqueness_violations": f"WITH k AS (SELECT DISTINCT {KEY} AS page_key, url FROM pages) SELECT page_key, count(*) AS n, min(url) AS first, max(url) AS last, array_to_string(list_sort(list(url))[1:5], ' ') AS \"values\" FROM k GROUP BY page_key HAVING count(*) > 1",
    "url_normalize": f"""SELECT page_id, {HOST} || lower(regexp_replace(regexp_replace({PATH}, '/+$', ''), '\\.[mM][dD]$', '')) AS key, {HOST} AS host, {KEY} AS page_key, {DASHED(f"CASE WHEN len({SEGMENTS}) > 0 THEN array_to_string({SEGMENTS}[-2:], '-') ELSE {HOST} END")} AS slug,
      CASE WHEN len({SEGMENTS}) = 0 THEN '(site root)' ELSE regexp_replace({SEGMENTS}[1], '\\.md$', '') END AS product FROM pages""",
    "ledger_full_outer": f"WITH {LEDGER} SELECT * FROM ledger",
    "ledger_counts": f"""WITH {LEDGER}, n AS (SELECT product, count(*) AS discovered, count(*) FILTER (source IN ('both', 'llms.txt')) AS curated, count(*) FILTER (source IN ('both', 'sitemap')) AS sitemap, count(*) FILTER (included) AS in_scope, count(*) FILTER (NOT included) AS excluded FROM ledger GROUP BY product)
      SELECT *, CASE WHEN curated > 0 AND curated < sitemap THEN sitemap - curated END AS curated_gap FROM n""",
    "changed_since": """WITH n AS (SELECT p_partkey AS url, CASE WHEN p_partkey % 9 > 0 THEN substring(sha256(p_name), 1, 16) END AS content_hash FROM part), b AS (SELECT p_partkey AS url, substring(sha256(CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END), 1, 16) AS prior FROM part WHERE p_partkey % 5 > 0)
      SELECT url, content_hash, NOT coalesce(content_hash = prior, false) AS changed FROM n LEFT JOIN b USING (url)""",
    "context_budget_fill": FILL,
    "sample_selection": f"""WITH {RESULTS}, f AS (SELECT run_id, page_key AS url, max(10 - accuracy) AS impact, min(probe_id) AS ord FROM results WHERE accuracy < 4 GROUP BY ALL)
      SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY impact DESC, ord, url) AS INTEGER) AS place FROM f QUALIFY place <= 6""",
    "stratified_pick": f"""WITH {RUNS}, r AS (SELECT target_name, run_id, score, row_number() OVER (PARTITION BY target_name ORDER BY score, run_id) - 1 AS i, count(*) OVER (PARTITION BY target_name) AS n FROM runs WHERE score IS NOT NULL)
      SELECT target_name, run_id, score FROM r WHERE n <= 5 OR list_contains(list_transform(range(5), lambda j: CAST(floor((n - 1) * j / 4.0::DOUBLE + 0.5) AS BIGINT)), i)""",
    "round_robin_sections": f"WITH {RUNS} SELECT target_name, run_id, CAST(row_number() OVER (PARTITION BY target_name ORDER BY run_id * 7919 % 10007, run_id) AS INTEGER) AS turn FROM runs QUALIFY turn <= 4",
    "next_actions": f"""WITH {RUNS} SELECT run_id, CASE WHEN fidelity IS NOT NULL AND run_id % 3 > 0 THEN 'retest' WHEN fidelity IS NOT NULL THEN 'regenerate' WHEN run_id % 3 > 0 THEN 'test' ELSE 'generate' END AS action,
      CASE WHEN run_id % 11 < 10 THEN {half_up('10 * (10 - run_id % 11) / 10', 1)} ELSE 0.0::DOUBLE END AS recoverable FROM runs""",
    "stage_times": f"WITH {RUNS} " + " UNION ALL ".join(f"SELECT target_type, '{n}' AS stage, CAST(sum(run_id * {i + 3} % 1000) AS BIGINT) AS ms FROM runs GROUP BY target_type" for i, n in enumerate(["extract", "audit", "probes", "test"])),
    "last_lines": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20",
    "fatal_errors": "SELECT event_id, event_id % 8 IN (0, 3, 5) AS fatal FROM events",
    "csv_lines": "SELECT p_partkey, p_partkey || ',' || CASE p_partkey % 3 WHEN 0 THEN chr(34) || p_name || ', ' || chr(34) || chr(34) || 'x' || chr(34) || chr(34) || chr(34) WHEN 1 THEN p_name ELSE '' END || ',' || p_size AS line FROM part",
}
QUERIES = [table_search_sort_page, group_ordinal, group_summary, dimension_means, systemic_dimensions, probe_matrix, uniqueness_violations, url_normalize, ledger_full_outer, ledger_counts, changed_since, context_budget_fill, sample_selection, stratified_pick, round_robin_sections, next_actions, stage_times, last_lines, fatal_errors, csv_lines]

"""Queries whose inputs are texts and records made from keys: the expected facts follow from the keys by arithmetic, in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope.functions import urls
from folioscope.functions.num import half_up as half_up_column
from folioscope.operators import probes, retrieval, rollup, texts, views
from folioscope.operators import runs as run_ops
from folioscope.plans.remap import RUNS, half_up, mapped, read, runs
from folioscope.session import shared_folder, spread, workers_find_library
from folioscope.sources import ledger, reports, store

#: Assessments of `lineitem`: a product's pages under ten checks.
ASSESSMENTS = {
    "product": "l_suppkey % 20",
    "url": "concat('https://docs.example/', CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING))",
    "check": "concat('c', CAST(l_partkey % 10 AS STRING))",
    "ord": "CAST(l_partkey % 10 AS INT)",
    "weight": "CAST(l_partkey % 10 + 3 AS INT)",
    "verdict": "CASE WHEN l_partkey % 10 = 9 OR l_orderkey % 7 = 6 THEN NULL WHEN (l_orderkey + l_partkey) % 5 < 2 THEN 'pass' WHEN (l_orderkey + l_partkey) % 5 = 2 THEN 'warn' WHEN l_partkey % 10 = 8 THEN 'pass' ELSE 'fail' END",
    "detail": "l_returnflag",
}


def assessments(spark, sf_dir):
    return mapped(read(spark, sf_dir, "lineitem"), ASSESSMENTS)


def check_rollup(spark, sf_dir):
    """Checks of each product with their place, weakest first, and the first findings."""
    found = rollup.rollup_checks(assessments(spark, sf_dir), ["product"])
    return rollup.placed(found, ["product"]).select("product", "check", "place", "pass", "warn", "fail", "evaluated", "not_applicable", "points", F.array_join(F.transform("findings", lambda f: f["url"]), " ").alias("findings"))


def check_scores(spark, sf_dir):
    found = rollup.rollup_checks(assessments(spark, sf_dir), ["product"])
    return rollup.product_scores(found, ["product"])


def check_fixes(spark, sf_dir):
    """What each check could still bring, most first."""
    return rollup.potential_fixes(rollup.rollup_checks(assessments(spark, sf_dir), ["product"]), ["product"])


#: Texts that list pages: an index entry in one of five forms, and the site map that a page is in.
LINK = """CASE s_suppkey % 5 WHEN 0 THEN concat('https://docs.example/p', CAST(s_suppkey % 7 AS STRING), '/page', CAST(s_suppkey AS STRING)) WHEN 1 THEN concat('/p', CAST(s_suppkey % 7 AS STRING), '/page', CAST(s_suppkey AS STRING), '#top')
 WHEN 2 THEN concat('page', CAST(s_suppkey AS STRING), CASE WHEN s_suppkey % 3 = 0 THEN '.png' ELSE '' END) WHEN 3 THEN '#part' ELSE 'mailto:a@docs.example' END"""
LOCATION = "concat('https://docs.example/p', CAST(s_suppkey % 7 AS STRING), '/page', CAST(s_suppkey AS STRING), '/')"


def index_texts(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(F.expr(f"concat('- [page ', s_name, '](', {LINK}, ') and more')").alias("text"), F.lit("https://docs.example/p0/index").alias("base"))


def map_texts(spark, sf_dir):
    """Three site maps and one that lists them."""
    pages = read(spark, sf_dir, "supplier").where("s_suppkey % 4 > 0").select((F.col("s_suppkey") % 3).alias("m"), F.expr(f"concat('<url><loc> ', {LOCATION}, ' </loc></url>')").alias("entry"))
    maps = pages.groupBy("m").agg(F.concat_ws("\n", F.collect_list("entry")).alias("text")).select(F.format_string("https://docs.example/map%d.xml", "m").alias("location"), "text")
    return maps.union(maps.select(F.lit("https://docs.example/sitemap.xml"), F.concat_ws("", F.collect_list(F.concat(F.lit("<loc>"), "location", F.lit("</loc>"))))))


def ledger_of_texts(spark, sf_dir):
    prefix = "https://docs.example/p0"
    return ledger.ledger(ledger.curated_pages(index_texts(spark, sf_dir), prefix), ledger.sitemap_pages(map_texts(spark, sf_dir), prefix), "full")


def products_listed(spark, sf_dir):
    return ledger.products(index_texts(spark, sf_dir), "https://docs.example")


def links_found(spark, sf_dir):
    return index_texts(spark, sf_dir).select(F.explode(urls.links_from(F.col("text"), F.col("base"))).alias("url")).groupBy("url").agg(F.count("*").alias("n"))


def fetched_ledger(spark, sf_dir):
    """A ledger with what was fetched: pages without an answer, with an error, or without a body are not."""
    part = read(spark, sf_dir, "part")
    listed = part.select(F.format_string("https://docs.example/%d", "p_partkey").alias("url"), (F.col("p_partkey") % 7 > 0).alias("included"))
    pages = part.where("p_partkey % 3 > 0").select(F.format_string("https://docs.example/%d/#x", "p_partkey").alias("url"), F.col("p_type").alias("title"), F.expr("CASE WHEN p_partkey % 4 > 0 THEN p_name END").alias("markdown"), F.expr("CASE WHEN p_partkey % 5 = 0 THEN 'timeout' END").alias("error"))
    return ledger.fetched(listed, pages).select("url", "fetched", "content_hash", F.col("bytes").cast("long").alias("bytes"))


def stored(spark, sf_dir):
    """A store of runs in the shared folder: a manifest, an audit and what is left of an older one for each nation; one manifest doesn't parse."""
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    nations = read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows by the table's nature
    for row in nations:
        name = f"run-{row['n_nationkey']:02d}"
        body = '{"runId": ' if row["n_nationkey"] == 3 else f'{{"runId": "{name}", "target": {{"type": "product", "name": "{row["n_name"]}"}}, "status": "complete", "counts": {{"pages": {row["n_regionkey"]}}}}}'
        write = lambda text, at: spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(at)
        write(body, f"{root}/runs/{name}/manifest.json")
    return root


def manifests_listed(spark, sf_dir):
    """Runs of a store, newest first; those that don't parse are left out."""
    found = store.read_manifests(spark, stored(spark, sf_dir))
    return found.select("runId", F.col("target.name").alias("name"), "status", F.col("counts.pages").cast("long").alias("pages"))


def appended_runs(spark, sf_dir):
    """Two imports into a table of runs that overlap: runs are immutable, so that the second brings only new ones."""
    path = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    rows = runs(spark, sf_dir).select(F.col("target_name").alias("run_id"), F.col("run_id").alias("ord"), "cost_cents")
    first = store.append_runs(rows.where("run_id < 't2'"), path)
    second = store.append_runs(rows.withColumn("cost_cents", F.lit(0).cast("long")), path)
    new = first.select("run_id", F.lit(1).alias("import")).union(second.select("run_id", F.lit(2)))
    held = spark.read.parquet(path).groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.count("*").alias("n"), F.sum("cost_cents").alias("cost_cents"))
    return held.join(new, "run_id")


def archive_import(spark, sf_dir):
    """What an import of runs brought: the new ones and the measured cost of all."""
    path = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    rows = runs(spark, sf_dir).select(F.col("target_name").alias("run_id"), F.when(F.col("run_id") % 5 > 0, F.col("cost_cents")).alias("cost_cents"))
    store.append_runs(rows.where("run_id < 't2'"), path)
    new = store.append_runs(rows, path)
    return store.import_account(spark.read.parquet(path), new, "cost_cents")


def page_guards(spark, sf_dir):
    """Of each document whether it is thin, its estimated tokens, its hash, and its text without anything like a key."""
    text = F.coalesce("text", F.lit(""))
    keyed = F.concat(text, F.expr("CASE doc_id % 3 WHEN 0 THEN ' key sk-abc-0123456789abcdef ' WHEN 1 THEN ' sk-ABCDEFGHIJKLMNOPQRST1 topsecret9 ' ELSE ' sk-short topsecret9' END"))
    return read(spark, sf_dir, "documents").select("doc_id", texts.thin(F.col("text")).alias("thin"), texts.estimated_tokens(text).cast("long").alias("tokens"), urls.short_hash(text).alias("hash"), F.md5(urls.redact(keyed, F.array(F.lit("topsecret9"), F.lit("short")))).alias("redacted"))


def run_scalars(spark, sf_dir):
    """Small formulas over runs: fidelity of four scores, the ceiling, the time left, the gap, ids, half-up rounding."""
    a, b, c, d = (F.col("run_id") % n for n in (11, 7, 5, 3))
    usd, at = F.col("cost_cents") / 100, F.col("at").cast("timestamp")
    return runs(spark, sf_dir).select(
        "run_id", probes.fidelity(a, b, c, d).cast("long").alias("fidelity"), run_ops.over_ceiling(usd, 5.0).alias("over"), run_ops.gap(F.col("score"), F.col("fidelity")).cast("long").alias("gap"),
        run_ops.remaining_seconds(F.col("run_id") % 4, F.lit(10), F.col("cost_cents") * 10, 3).alias("left"), run_ops.run_ids(at, F.col("target_name")).alias("id"), half_up_column(usd / 3 - 1, 2).alias("rounded"),
    )


def run_results_without_usage(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("probe_id"), F.struct(F.col("l_partkey").alias("tokens")).alias("usage")))).alias("results"))
    return run_ops.without_usage(line).select("run_id", F.to_json("results").alias("results"))


def opportunities(spark, sf_dir):
    """Dimensions of runs by what they could still bring, most first, weaker ones before stronger ones of the same gain: the first five of each target."""
    rows = runs(spark, sf_dir).select("target_name", "run_id", (F.col("run_id") % 16).alias("weight"), F.expr("CASE WHEN run_id % 5 > 0 THEN run_id % 11 END").alias("score"))
    return views.by_opportunity(rows, ["target_name"], "weight", "score", ["run_id"], 5).select("target_name", "run_id", "gain", "place")


def largest_gaps(spark, sf_dir):
    """The twelve runs of each target whose score is most above their fidelity."""
    rows = runs(spark, sf_dir).withColumn("gap", run_ops.gap(F.col("score"), F.col("fidelity"))).where("gap is not null")
    return views.top_of(rows, ["target_name"], [F.desc("gap"), F.asc("run_id")], 12).select("target_name", "run_id", F.col("gap").cast("long").alias("gap"), "place")


def aligned_dimensions(spark, sf_dir):
    """Rows and dimension scores of one slug."""
    rows = read(spark, sf_dir, "supplier").select(F.format_string("https://docs.example/P%d/%d.md", F.col("s_suppkey") % 9, "s_suppkey").alias("url"), "s_suppkey")
    dims = read(spark, sf_dir, "supplier").where("s_suppkey % 3 > 0").select(F.format_string("p%d-%d-md", F.col("s_suppkey") % 9, "s_suppkey").alias("slug"), (F.col("s_suppkey") % 11).alias("score"))
    return views.aligned(rows, "url", dims, "slug").select("s_suppkey", "slug", "score")


def group_pages(spark, sf_dir):
    """The second page of targets, four whole groups a page, with all their runs."""
    return views.page_of_groups(runs(spark, sf_dir), "target_name", [F.asc("target_name")], 2, 4).select("target_name", "run_id", "place")


def focused_group(spark, sf_dir):
    return views.focus(runs(spark, sf_dir), "target_name", "t7").select("run_id", "score")


def unique_keys(spark, sf_dir):
    """Orders under a key that none shares: a key that several values share would fail the job with their names."""
    return views.require_unique(read(spark, sf_dir, "orders").select(F.format_string("k%d", "o_orderkey").alias("key"), F.col("o_orderkey").cast("string").alias("value")), "key", "value")


#: Answers of `lineitem`: what they cite, name and link, by case.
ANSWER = """CASE l_orderkey % 8 WHEN 0 THEN 'See https://docs.example/guide/start.' WHEN 1 THEN 'Read docs.example/guide/start for this' WHEN 2 THEN 'Read docs.example/guide/start-v2 for this' WHEN 3 THEN 'It is in docs.example/guide/next'
 WHEN 4 THEN 'Elsewhere: https://other.example/a' WHEN 5 THEN 'No link' WHEN 6 THEN 'See https://docs.example/guide/start/below' END"""


def answer_tiers(spark, sf_dir):
    one = lambda page: F.array(F.lit(f"https://docs.example/guide/{page}"))
    nothing = F.array().cast("array<string>")
    rows = spread(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).select(
        "l_orderkey", "l_linenumber", F.expr(ANSWER).alias("answer"), F.when(F.col("l_linenumber") == 2, F.array(F.lit("https://www.docs.example/guide/start/?q=1"))).when(F.col("l_linenumber") == 3, F.array(F.lit("docs.example/guide/next.md#x"))).otherwise(nothing).alias("cited_urls"),
        one("start").alias("expected_urls"), F.when(F.col("l_partkey") % 4 > 0, F.concat(one("start"), one("next"))).otherwise(nothing).alias("scope_urls"), F.expr("CASE WHEN l_suppkey % 5 = 0 THEN 'closed' ELSE 'web' END").alias("mode"),
    )
    return retrieval.verdicts(rows).select("l_orderkey", "l_linenumber", "hit", "via", "tier")


#: Reports of `orders`: a dimension row may be missing, weights may be wrong, analysis entries come in three forms, the whole may be fenced.
REPORT = """concat(CASE WHEN o_orderkey % 6 = 0 THEN '```markdown\n' ELSE '' END, '# Audit: Page ', CAST(o_orderkey AS STRING), '\n\n- **URL:** https://docs.example/', CAST(o_orderkey AS STRING), '\n- **Analyzed:** 2026-01-02\n**Content type:** guide\n\n## ABC Score: ', CAST(o_orderkey % 100 AS STRING), '.5/100 — Band ', CAST(o_custkey % 5 AS STRING),
 '\n\n| Dimension | Weight | Score | Weighted |\n|---|---|---|---|\n', {rows}, '| **Total** | **100** | | **', CAST(o_custkey % 90 AS STRING), '.5** |\n\n## Dimension analysis\n\n1. **Dimension a:** first\n   goes on\n- **Dimension b** — second\n**Dimension c:** third\n- **Other d:** no such\n**Dimension e and more:** longest\n\n## Prioritized recommendations\n\n### Tier 1\n\n',
 '- **[P1] Say it plainly** — *Maps to: Dimension a*\n  - **Where:** top\n  - **Issue:** long\n    line\n', CASE WHEN o_orderkey % 3 = 0 THEN '- **[P2] Another**\n  - **Change:** it\n  - **Why:** so\n' ELSE '' END, '\n## Anti-patterns found\n\n- one\n- two\n  more\n\n## Off-page notes\n\n- a note\n', CASE WHEN o_orderkey % 6 = 0 THEN '\n```\n' ELSE '' END)"""
DIMENSION = "CASE WHEN o_orderkey % 10 = 7 AND {i} = 2 THEN '' ELSE concat('| Dimension {c} | ', CASE WHEN {i} = 8 THEN CASE WHEN o_orderkey % 10 = 8 THEN '13' ELSE '12' END ELSE '11' END, ' | ', CAST((o_orderkey + {i}) % 11 AS STRING), '/10 | ', CAST(o_orderkey % 9 AS STRING), '.{i} |\n') END"


def audits_parsed(spark, sf_dir):
    """Reports to fields; a report that breaks a rule has an error."""
    workers_find_library(spark)
    rows = ", ".join(DIMENSION.format(i=i, c="abcdefghi"[i]) for i in range(9))
    made = spread(read(spark, sf_dir, "orders")).select("o_orderkey", F.expr(REPORT.replace("{rows}", rows)).alias("text"))
    found = reports.parse_reports(made, ["o_orderkey"])
    r = F.get("recommendations", F.lit(0))
    dims = F.array_join(F.transform("dimensions", lambda d: F.concat_ws(":", d["name"], d["weight"], d["score"], d["weighted"], F.coalesce(d["analysis"], F.lit("-")))), ";")
    return found.select(
        "o_orderkey", "title", "page_url", "analyzed_at", "content_type", "score", "band", "weighted_total", dims.alias("dimensions"), F.size("recommendations").cast("long").alias("n"), r["title"].alias("first"), r["maps_to"].alias("maps_to"), r["tier"].alias("tier"),
        r["where"].alias("place"), r["issue"].alias("issue"), F.get("recommendations", F.lit(1))["why"].alias("why"), F.array_join("anti_patterns", ";").alias("anti"), F.array_join("off_page_notes", ";").alias("notes"), "error",
    )


def page_details(spark, sf_dir):
    """Each page with its latest audit, the latest probes of each mode, and the run that each comes from as a map."""
    from folioscope.operators.store import page_details as details

    found = details(runs(spark, sf_dir), ["page_key"], ["at"])
    return found.select("page_key", "score", F.to_json("provenance").alias("provenance"), F.array_join(F.transform(F.array_sort(F.map_entries("fidelity_by_mode")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("fidelity"))


def product_aggregates(spark, sf_dir):
    """Scores, fidelity, graders and bands of products, weakest first; single pages and unmeasured targets are none."""
    from folioscope.operators.store import band, product_aggregates as aggregates

    rows = runs(spark, sf_dir).withColumn("grader", F.col("grader_model")).withColumn("band", band(F.col("score")))
    return aggregates(rows, ["target_type", "target_name"]).select("target_type", "target_name", "mean_score", "mean_fidelity", "graders", F.to_json("bands").alias("bands"), "place")


def runs_listed(spark, sf_dir):
    from folioscope.operators.store import run_list

    return run_list(runs(spark, sf_dir), ["target_type", "target_name"]).select("target", "runs", "complete", "cost_cents", "newest")


def sql_text(expression: str) -> str:
    return expression.replace("AS STRING", "AS VARCHAR")


A = f"a AS (SELECT {', '.join(f'{sql_text(e)} AS {n!r}'.replace(chr(39) + n + chr(39), chr(34) + n + chr(34)) for n, e in ASSESSMENTS.items())} FROM lineitem)"
CHECKED = f"""{A}, c AS (SELECT product, "check", ord, weight, count(*) FILTER (verdict = 'pass') AS pass, count(*) FILTER (verdict = 'warn') AS warn, count(*) FILTER (verdict = 'fail') AS fail, count(verdict) AS evaluated, count(*) - count(verdict) AS not_applicable,
  CASE WHEN count(verdict) > 0 THEN {half_up("(count(*) FILTER (verdict = 'pass') + 0.5::DOUBLE * count(*) FILTER (verdict = 'warn')) / count(verdict)", 3)} END AS points FROM a GROUP BY ALL)"""
CURATED = f"""SELECT DISTINCT regexp_replace(regexp_replace(CASE WHEN l LIKE 'http%' THEN l WHEN l LIKE '/%' THEN 'https://docs.example' || l ELSE 'https://docs.example/p0/' || l END, '#.*$', ''), '/+$', '') AS url
  FROM (SELECT {sql_text(LINK)} AS l FROM supplier) WHERE l NOT LIKE '#%' AND l NOT LIKE 'mailto:%'"""
IN_SCOPE = "(url = 'https://docs.example/p0' OR url LIKE 'https://docs.example/p0/%') AND url NOT LIKE '%.png'"
KEYED = "coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN ' key [redacted] ' WHEN 1 THEN ' [redacted] [redacted] ' ELSE ' sk-short [redacted]' END"
KEYLESS = f"regexp_replace(regexp_replace(replace({KEYED}, 'topsecret9', '[redacted]'), 'sk-[a-z]{{2,6}}-[A-Za-z0-9_-]{{10,}}', '[redacted]', 'g'), '\\bsk-[A-Za-z0-9]{{20,}}\\b', '[redacted]', 'g')"
GAIN = half_up("coalesce(weight * (10 - score) / 10.0::DOUBLE, 0)", 1)
CITED = "l_linenumber = 2 OR (l_orderkey % 8 = 0)"
OPEN = "l_suppkey % 5 > 0"
ANY_LINK = "l_linenumber IN (2, 3) OR l_orderkey % 8 IN (0, 4, 6)"
BROKEN = "o_orderkey % 10 IN (7, 8)"
GOOD = lambda value: f"CASE WHEN NOT ({BROKEN}) THEN {value} END"
SAID = {0: "first goes on", 1: "second", 2: "third", 4: "longest"}
DIMENSIONS = " || ';' || ".join(f"'Dimension {'abcdefghi'[i]}:{12 if i == 8 else 11}:' || ((o_orderkey + {i}) % 11) || ':' || (o_orderkey % 9) || '.{i}:{SAID.get(i, '-')}'" for i in range(9))
NEW = lambda value, when: f"(max_by({value}, (run_at, run_id)) FILTER ({when}))"
PROBED = lambda mode: f"fidelity IS NOT NULL AND mode = '{mode}'"
BANDS = {"excellent": "score >= 85", "strong": "score >= 70 AND score < 85", "good": "score >= 55 AND score < 70", "fair": "score >= 40 AND score < 55", "poor": "score < 40"}
SQL = {
    "check_rollup": f"""WITH {CHECKED}, f AS (SELECT product, "check", url, CASE verdict WHEN 'fail' THEN 0 ELSE 1 END AS rank FROM a WHERE verdict IN ('fail', 'warn') QUALIFY row_number() OVER (PARTITION BY product, "check" ORDER BY rank, url) <= 25),
      g AS (SELECT product, "check", string_agg(url, ' ' ORDER BY rank, url) AS findings FROM f GROUP BY ALL)
      SELECT product, "check", row_number() OVER (PARTITION BY product ORDER BY coalesce(points, 1), ord) AS place, pass, warn, fail, evaluated, not_applicable, points, findings FROM c LEFT JOIN g USING (product, "check")""",
    "check_scores": f"WITH {CHECKED} SELECT product, {half_up('sum(round(points * 1000)::BIGINT * weight) FILTER (points IS NOT NULL) / 1000.0::DOUBLE / sum(weight) FILTER (points IS NOT NULL) * 100', 1)} AS score, CAST(sum(weight) FILTER (points IS NOT NULL) AS BIGINT) AS scored_weight FROM c GROUP BY product",
    "check_fixes": f"""WITH {CHECKED}, w AS (SELECT *, sum(weight) FILTER (points IS NOT NULL) OVER (PARTITION BY product) AS total FROM c), r AS (SELECT product, "check", ord, {half_up('weight * (1 - points) / total * 100', 2)} AS recoverable FROM w)
      SELECT * FROM r WHERE recoverable > 0""",
    "ledger_of_texts": f"""WITH c AS (SELECT url FROM ({CURATED}) WHERE {IN_SCOPE}), s AS (SELECT DISTINCT 'https://docs.example/p' || (s_suppkey % 7) || '/page' || s_suppkey AS url FROM supplier WHERE s_suppkey % 4 > 0 AND s_suppkey % 7 = 0)
      SELECT coalesce(c.url, s.url) AS url, CASE WHEN c.url IS NULL THEN 'sitemap' WHEN s.url IS NULL THEN 'llms.txt' ELSE 'both' END AS source, s.url IS NOT NULL AS included, CASE WHEN s.url IS NULL THEN 'not-in-sitemap' END AS reason FROM c FULL JOIN s ON c.url = s.url""",
    "products_listed": f"SELECT DISTINCT split_part(url, '/', 4) AS product FROM ({CURATED})",
    "links_found": f"SELECT CASE WHEN l LIKE 'http%' THEN l WHEN l LIKE '/%' THEN 'https://docs.example' || l ELSE 'https://docs.example/p0/' || l END AS url, count(*) AS n FROM (SELECT {sql_text(LINK)} AS l FROM supplier) WHERE l NOT LIKE '#%' AND l NOT LIKE 'mailto:%' GROUP BY 1",
    "fetched_ledger": """WITH p AS (SELECT *, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 4 > 0 THEN p_name END AS body FROM part WHERE p_partkey % 7 > 0)
      SELECT 'https://docs.example/' || p_partkey AS url, body IS NOT NULL AND p_partkey % 5 > 0 AS fetched, substring(sha256(body), 1, 16) AS content_hash, length(body) AS bytes FROM p""",
    "manifests_listed": "SELECT printf('run-%02d', n_nationkey) AS \"runId\", n_name AS name, 'complete' AS status, CAST(n_regionkey AS BIGINT) AS pages FROM nation WHERE n_nationkey <> 3",
    "archive_import": f"WITH {RUNS}, r AS (SELECT target_name, sum(CASE WHEN run_id % 5 > 0 THEN cost_cents END) AS cost FROM runs GROUP BY target_name) SELECT count(*) FILTER (target_name >= 't2') AS imported, count(*) FILTER (target_name < 't2') AS already, count(*) AS total, sum(cost)::BIGINT AS recovered, (sum(cost) FILTER (target_name >= 't2'))::BIGINT AS recovered_now FROM r",
    "appended_runs": f"WITH {RUNS} SELECT target_name AS run_id, count(*) AS n, CASE WHEN target_name < 't2' THEN CAST(sum(cost_cents) AS BIGINT) ELSE 0 END AS cost_cents, CASE WHEN target_name < 't2' THEN 1 ELSE 2 END AS \"import\" FROM runs GROUP BY target_name",
    "page_guards": f"SELECT doc_id, length(coalesce(text, '')) < 800 AS thin, CAST(ceil(length(coalesce(text, '')) / 3.6::DOUBLE) AS BIGINT) AS tokens, substring(sha256(coalesce(text, '')), 1, 16) AS hash, md5({KEYLESS}) AS redacted FROM documents",
    "run_scalars": f"""WITH {RUNS} SELECT run_id, CAST(floor(2.5::DOUBLE * (run_id % 11 + run_id % 7 + run_id % 5 + run_id % 3) + 0.5) AS BIGINT) AS fidelity, cost_cents / 100.0::DOUBLE > 5 AS over, score - fidelity AS gap,
      CASE WHEN run_id % 4 > 0 THEN ceil((10 - run_id % 4) / 3.0::DOUBLE) * (cost_cents * 10) / 1000.0::DOUBLE END AS "left", strftime(run_at, '%Y-%m-%dT%H-%M-%S-000Z') || '-' || substring(sha256(target_name), 1, 4) AS id, {half_up('cost_cents / 100.0::DOUBLE / 3 - 1', 2)} AS rounded FROM runs""",
    "run_results_without_usage": """SELECT l_orderkey AS run_id, '[' || string_agg('{"probe_id":' || l_linenumber || '}', ',' ORDER BY l_linenumber) || ']' AS results FROM lineitem GROUP BY l_orderkey""",
    "opportunities": f"""WITH {RUNS}, d AS (SELECT target_name, run_id, run_id % 16 AS weight, CASE WHEN run_id % 5 > 0 THEN run_id % 11 END AS score FROM runs), g AS (SELECT *, {GAIN} AS gain FROM d)
      SELECT target_name, run_id, gain, row_number() OVER (PARTITION BY target_name ORDER BY gain DESC, score NULLS LAST, run_id) AS place FROM g QUALIFY place <= 5""",
    "largest_gaps": f"WITH {RUNS} SELECT target_name, run_id, score - fidelity AS gap, row_number() OVER (PARTITION BY target_name ORDER BY score - fidelity DESC, run_id) AS place FROM runs WHERE score IS NOT NULL AND fidelity IS NOT NULL QUALIFY place <= 12",
    "aligned_dimensions": "SELECT s_suppkey, 'p' || (s_suppkey % 9) || '-' || s_suppkey || '-md' AS slug, s_suppkey % 11 AS score FROM supplier WHERE s_suppkey % 3 > 0",
    "group_pages": f"WITH {RUNS} SELECT target_name, run_id, dense_rank() OVER (ORDER BY target_name) AS place FROM runs QUALIFY place BETWEEN 5 AND 8",
    "focused_group": f"WITH {RUNS} SELECT run_id, score FROM runs WHERE target_name = 't7'",
    "unique_keys": "SELECT 'k' || o_orderkey AS key, CAST(o_orderkey AS VARCHAR) AS value FROM orders",
    "answer_tiers": f"""SELECT l_orderkey, l_linenumber, CASE WHEN {OPEN} THEN coalesce({CITED} OR l_orderkey % 8 = 1, false) END AS hit, CASE WHEN {OPEN} THEN CASE WHEN {CITED} THEN 'citation' WHEN l_orderkey % 8 = 1 THEN 'mention' END END AS via,
      CASE WHEN {OPEN} AND l_partkey % 4 > 0 THEN CASE WHEN {CITED} OR l_orderkey % 8 = 1 THEN 'exact' WHEN l_linenumber = 3 OR l_orderkey % 8 = 3 THEN 'in-scope' WHEN {ANY_LINK} THEN 'out-of-scope' ELSE 'none' END END AS tier FROM lineitem""",
    "audits_parsed": f"""SELECT o_orderkey, {GOOD("'Page ' || o_orderkey")} AS title, {GOOD("'https://docs.example/' || o_orderkey")} AS page_url, {GOOD("'2026-01-02'")} AS analyzed_at, {GOOD("'guide'")} AS content_type, {GOOD('o_orderkey % 100 + 0.5::DOUBLE')} AS score, {GOOD("'Band ' || (o_custkey % 5)")} AS band,
      {GOOD('o_custkey % 90 + 0.5::DOUBLE')} AS weighted_total, {GOOD(DIMENSIONS)} AS dimensions, {GOOD('CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END')} AS n, {GOOD("'Say it plainly'")} AS first, {GOOD("'Dimension a'")} AS maps_to, {GOOD("'Tier 1'")} AS tier, {GOOD("'top'")} AS place, {GOOD("'long line'")} AS issue,
      {GOOD("CASE WHEN o_orderkey % 3 = 0 THEN 'so' END")} AS why, {GOOD("'one;two more'")} AS anti, {GOOD("'a note'")} AS notes, CASE o_orderkey % 10 WHEN 7 THEN '8 dimension rows, not 9' WHEN 8 THEN 'weights sum to 101' END AS error FROM orders""",
    "page_details": f"""WITH {RUNS}, d AS (SELECT page_key, {NEW('score', 'score IS NOT NULL')} AS score, {NEW('run_id', 'score IS NOT NULL')} AS audit, {NEW('run_id', PROBED('closed'))} AS closed, {NEW('run_id', PROBED('web'))} AS web, {NEW('fidelity', PROBED('closed'))} AS f_closed, {NEW('fidelity', PROBED('web'))} AS f_web FROM runs GROUP BY page_key)
      SELECT page_key, score, '{{' || concat_ws(',', '"audit":' || audit, '"closed":' || closed, '"web":' || web) || '}}' AS provenance, concat_ws(',', 'closed=' || f_closed, 'web=' || f_web) AS fidelity FROM d""",
    "product_aggregates": f"""WITH {RUNS}, g AS (SELECT target_type, target_name, {half_up('avg(score)', 1)} AS mean_score, {half_up('avg(fidelity)', 1)} AS mean_fidelity, string_agg(DISTINCT grader_model, ',' ORDER BY grader_model) AS graders,
      '{{' || concat_ws(',', {", ".join(f"'\"{b}\":' || count(*) FILTER ({c})" for b, c in BANDS.items())}) || '}}' AS bands FROM runs WHERE target_type <> 'page' GROUP BY ALL HAVING count(score) > 0)
      SELECT *, row_number() OVER (ORDER BY coalesce(mean_score, 999), target_type, target_name) AS place FROM g""",
    "runs_listed": f"WITH {RUNS} SELECT target_type || ':' || target_name AS target, count(*) AS runs, count(*) FILTER (status = 'complete') AS complete, CAST(sum(cost_cents) AS BIGINT) AS cost_cents, max_by(run_id, (run_at, run_id)) AS newest FROM runs GROUP BY ALL",
}
QUERIES = [
    check_rollup, check_scores, check_fixes, ledger_of_texts, products_listed, links_found, fetched_ledger, manifests_listed, appended_runs, archive_import, page_guards, run_scalars, run_results_without_usage, opportunities, largest_gaps, aligned_dimensions,
    group_pages, focused_group, unique_keys, answer_tiers, audits_parsed, page_details, product_aggregates, runs_listed,
]

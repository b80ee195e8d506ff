"""Queries over pages and texts: extraction, facts, checks, reports, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import checks, urls
from folioscope.functions.markdown import VAGUE, page_facts
from folioscope.functions.num import half_up as half_up_column
from folioscope.operators import rollup, texts
from folioscope.plans.remap import half_up, read
from folioscope.plans.tables import HOST
from folioscope.session import spread, workers_find_library
from folioscope.sources.html import read_pages


def facts(spark, sf_dir):
    workers_find_library(spark)
    return page_facts(read_pages(spread(read(spark, sf_dir, "pages").select("url", "html")), marks=True))


def page_checks(spark, sf_dir):
    rows = checks.assessments(facts(spark, sf_dir))
    return rows.withColumn("host", urls.host_of(F.col("url")))


def page_rollup_by_host(spark, sf_dir):
    """Score, scored weight and pages of each host."""
    rolled = rollup.rollup_checks(page_checks(spark, sf_dir), ["host"])
    return rollup.product_scores(rolled, ["host"], F.max(F.col("evaluated") + F.col("not_applicable")).alias("pages"))


def check_points_by_host(spark, sf_dir):
    found = rollup.rollup_checks(page_checks(spark, sf_dir), ["host"])
    return found.select("host", "check", "pass", "warn", "fail", "evaluated", "not_applicable", "points", F.size("findings").alias("findings"))


def potential_fixes(spark, sf_dir):
    return rollup.potential_fixes(rollup.rollup_checks(page_checks(spark, sf_dir), ["host"]), ["host"])


def page_structure(spark, sf_dir):
    return facts(spark, sf_dir).select("url", "structure.*").withColumn("headingLevelSkips", F.size("headingLevelSkips")).drop("unclosedFences")


def page_links(spark, sf_dir):
    return facts(spark, sf_dir).select("url", F.col("links.totalLinks").alias("total"), F.col("links.internalLinks").alias("internal"), F.col("links.externalLinks").alias("external"))


def facts_texts(spark, sf_dir):
    return texts.facts_text(facts(spark, sf_dir)).select("url", F.length("text").cast("long").alias("length"), F.md5("text").alias("md5"))


def facts_reports(spark, sf_dir):
    """All facts of the given pages as text, up to the specifics."""
    return texts.facts_report(facts(spark, sf_dir)).select("url", F.substring_index("text", "\n### Specifics", 1).alias("text"))


def page_texts(spark, sf_dir):
    workers_find_library(spark)
    found = texts.page_text(read_pages(spread(read(spark, sf_dir, "pages").select("url", "html"))))
    return found.select("url", texts.thin(F.col("text")).alias("thin"), texts.estimated_tokens(F.col("text")).alias("tokens"))


def probe_set_ids(spark, sf_dir):
    probes = read(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("page"), F.col("p_partkey").alias("id"), F.col("p_name").alias("prompt"))
    return texts.probe_set_ids(probes, "page", ["prompt", "id"])


def specifics_density(spark, sf_dir):
    """Numerals and vague quantifiers of documents without markup, in expressions only."""
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    numerals = F.regexp_count(text, F.lit(r"(?<![A-Za-z0-9_.])[0-9][0-9,]*(?:\.[0-9]+)?"))
    vague = sum((F.contains(low, F.lit(v)).cast("int") for v in VAGUE), F.lit(0))
    rows = read(spark, sf_dir, "documents").select("doc_id", words.cast("long").alias("words"), numerals.cast("long").alias("numerals"), vague.cast("long").alias("vague"))
    return rows.withColumn("density", F.when(F.col("words") > 0, half_up_column(F.col("numerals") / F.col("words") * 1000)).otherwise(0.0))


#: What the given pages hold: one article with one heading, no code, links, structured data or canonical address; a short article leaves the choice to the body, which has an advertisement too.
COUNTED = lambda text: f"len(list_filter(regexp_split_to_array(trim({text}), '\\s+'), lambda w: w <> ''))"
SPACED = lambda html: f"regexp_replace(regexp_replace({html}, '<(?:br|/?p|/h1)>', ' ', 'g'), '<[^>]*>', '', 'g')"
PAGES = f"""a AS (SELECT url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS article, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS heading, regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ad FROM pages),
  p AS (SELECT url, {HOST} AS host, {COUNTED(SPACED("article"))} AS n, {COUNTED("heading")} AS h, CASE WHEN length(trim(regexp_replace(article, '<[^>]*>', '', 'g'))) <= 200 THEN {COUNTED("ad")} ELSE 0 END AS ad,
    len(regexp_extract_all({SPACED("article")}, '(?:^|[^\\w.])([0-9][0-9,]*(?:\\.[0-9]+)?)')) AS numerals FROM a)"""
CHECKS = [("jsonld-valid", 8, "'warn'"), ("declared-language", 10, "NULL"), ("entity-metadata", 6, "NULL"), ("canonical", 4, "'warn'"), ("freshness", 3, "'warn'"), ("code-fence-validity", 5, "NULL"), ("heading-structure", 4, "'pass'"), ("code-runnability", 8, "NULL"), ("external-citations", 6, "NULL"), ("prose-specifics", 5, "CASE WHEN n + 1 + ad < 100 THEN NULL WHEN numerals > 0 THEN 'pass' ELSE 'warn' END")]
ROLLED = f"""{PAGES}, v AS ({" UNION ALL ".join(f"SELECT host, '{c}' AS \"check\", {i} AS ord, {w} AS weight, CAST({v} AS VARCHAR) AS verdict FROM p" for i, (c, w, v) in enumerate(CHECKS))}),
  c AS (SELECT host, "check", ord, weight, count(*) FILTER (verdict = 'pass') AS pass, count(*) FILTER (verdict = 'warn') AS warn, count(*) FILTER (verdict = 'fail') AS fail, count(verdict) AS evaluated, count(*) - count(verdict) AS not_applicable,
    CASE WHEN count(verdict) > 0 THEN {half_up("(count(*) FILTER (verdict = 'pass') + 0.5::DOUBLE * count(*) FILTER (verdict = 'warn')) / count(verdict)", 3)} END AS points FROM v GROUP BY ALL)"""
COUNT = "len(regexp_extract_all(coalesce(text, ''), '(?:^|[^A-Za-z0-9_.])([0-9][0-9,]*(?:\\.[0-9]+)?)'))"
VAGUE_SQL = " + ".join(f"contains(low, '{v}')::BIGINT" for v in VAGUE)
SQL = {
    "page_structure": f"""WITH {PAGES} SELECT url, 1 AS "headingCount", 1 AS "h1Count", 0 AS "headingLevelSkips", 1 AS "maxHeadingDepth", 1 AS "sectionCount", n - h AS "medianSectionWords", n - h AS "maxSectionWords", CASE WHEN n - h > 600 THEN 1 ELSE 0 END AS "oversizedSections",
      0 AS "tableCount", 0 AS "bulletCount", n + 1 + ad AS "wordCount", 0 AS "codeFences", 0 AS "untaggedFences" FROM p""",
    "facts_reports": f"""WITH {PAGES} SELECT url, concat_ws(chr(10), '### Metadata', '- structured data blocks: 0; types: -; unreadable: 0', '- canonical: unknown; language: unknown; description: unknown', '- published: unknown; modified: unknown; the same: false', '- programming language: unknown; fences: -; mismatch: unknown',
      '- keywords: 0; stopwords: -', '- about entries: 0; from a template: 0; repeated names: 0', '- og tags: 0; twitter tags: 0', '### Structure', '- headings: 1; first level: 1; deepest level: 1; level skips: 0',
      '- sections: 1; median words: ' || (n - h) || '; most words: ' || (n - h) || '; oversized: ' || CASE WHEN n - h > 600 THEN 1 ELSE 0 END, '- tables: 0; bullets: 0; words: ' || (n + 1 + ad), '### Code', '- blocks: 0; of three lines or more: 0; untagged: 0; unclosed at: -', '- languages: -',
      '- blocks that need imports: 0; without: 0', '- placeholders: 0; constants without a value: -', '### Citations', '- links: 0; internal: 0; external: 0; primary: 0', '- primary hosts: -', '- opaque texts: 0') AS text FROM p""",
    "page_links": 'SELECT url, 0 AS total, 0 AS internal, 0 AS "external" FROM pages',
    "check_points_by_host": f'WITH {ROLLED} SELECT host, "check", pass, warn, fail, evaluated, not_applicable, points, CASE WHEN warn + fail > 0 THEN least(25, warn + fail) END AS findings FROM c',
    "page_rollup_by_host": f"WITH {ROLLED} SELECT host, {half_up('sum(round(points * 1000)::BIGINT * weight) FILTER (points IS NOT NULL) / 1000.0::DOUBLE / sum(weight) FILTER (points IS NOT NULL) * 100', 1)} AS score, CAST(sum(weight) FILTER (points IS NOT NULL) AS BIGINT) AS scored_weight, max(evaluated + not_applicable) AS pages FROM c GROUP BY host",
    "potential_fixes": f"""WITH {ROLLED}, w AS (SELECT *, sum(weight) FILTER (points IS NOT NULL) OVER (PARTITION BY host) AS total FROM c), r AS (SELECT host, "check", ord, {half_up('weight * (1 - points) / total * 100', 2)} AS recoverable FROM w) SELECT * FROM r WHERE recoverable > 0""",
    "specifics_density": f"""WITH r AS (SELECT doc_id, lower(coalesce(text, '')) AS low, len(list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\\s+'), lambda w: w <> '')) AS words, {COUNT} AS numerals FROM documents)
      SELECT doc_id, words, numerals, {VAGUE_SQL} AS vague, CASE WHEN words > 0 THEN {half_up('numerals::DOUBLE / words * 1000', 0)} ELSE 0.0::DOUBLE END AS density FROM r""",
    "probe_set_ids": """SELECT p_partkey % 40 AS page, substring(sha256('[' || string_agg('{"id":' || p_partkey || ',"prompt":"' || p_name || '"}', ',' ORDER BY p_partkey) || ']'), 1, 12) AS probe_set_id FROM part GROUP BY 1""",
}
QUERIES = [page_rollup_by_host, check_points_by_host, potential_fixes, page_structure, page_links, facts_texts, facts_reports, page_texts, probe_set_ids, specifics_density]

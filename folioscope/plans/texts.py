"""Facts, checks and extraction of markdown and HTML texts made from `part`: what they hold follows from the key, in SQL by arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions.checks import assessments
from folioscope.functions.markdown import page_facts
from folioscope.operators import texts
from folioscope.plans.remap import read
from folioscope.session import spread, workers_find_library
from folioscope.sources.html import read_pages

URL = "concat('https://docs.example/part/', CAST(p_partkey AS STRING))"
LINKS = """CASE p_partkey % 4 WHEN 0 THEN '[here](/a) and [the spec](https://www.w3.org/x)' WHEN 1 THEN '[x](https://docs.example/b) [y](mailto:a@b.c)' WHEN 2 THEN '[z](https://other.example/q "t")' ELSE 'no link' END"""
CODE = """CASE p_partkey % 6 WHEN 0 THEN '```ts\nconst a = LIMIT_OF_CALLS;\nconst b = 2\nuse(a)\n```\n' WHEN 1 THEN '```ts\nconst a = LIMIT_OF_CALLS;\nconst b = 2\nuse(a)\n```\n' WHEN 2 THEN '```\nplain\n```\n' WHEN 3 THEN '````md\n```sh\nx\n```\n````\n' WHEN 4 THEN '~~~python\nimport os\nx = 1\ny = 2\n' ELSE '' END"""
MARKDOWN = f"""concat('# ', p_name, '\n\nIntro of ', CAST(p_partkey AS STRING), ' items takes ', CAST(p_partkey % 50 + 1 AS STRING), ' ms on v1.', CAST(p_partkey % 10 AS STRING), '.\n\n', CASE p_partkey % 3 WHEN 0 THEN '### Deep\n' WHEN 1 THEN '## Next\n' ELSE '' END,
 repeat('word ', CAST(p_partkey % 5 AS INT)), '\n\n', repeat('- point\n', CAST(p_partkey % 4 AS INT)), '\n', {LINKS}, '\n\n', CASE WHEN p_partkey % 5 = 0 THEN '| a | b |\n|---|---|\n| 1 | 2 |\n\n' ELSE '' END, {CODE})"""
JSON_LD = """CASE p_partkey % 4 WHEN 0 THEN '{"@type":"TechArticle","keywords":"chain, the, data","programmingLanguage":"TypeScript"}' WHEN 1 THEN '{"@graph":[{"@type":["WebPage"],"about":[{"name":"A","description":"Content about a"},{"name":"A"}],"datePublished":"2026","dateModified":"2026"}]}' WHEN 2 THEN '{oops' END"""
CANONICAL = "CASE WHEN p_partkey % 2 = 0 THEN '<link rel=\"canonical\" href=\"https://docs.example/c\">' ELSE '' END"
HTML = f"""concat('<!DOCTYPE html><html><head><title> ', p_name, ' </title>', CASE WHEN p_partkey % 2 = 0 THEN '<link href="https://docs.example/c" rel="canonical">' ELSE '' END, '<meta name="viewport" content="w"><meta property="og:title" content="t"><meta content="d" name="description">',
 coalesce(concat('<script type="application/ld+json"> ', {JSON_LD}, ' </script>'), ''), '</head><body><nav>menu</nav><main><h1>', p_name, '</h1><p>One <b>bold</b> <a href="/x">link</a><br>two</p><ul><li>a<li>b</ul><pre><code class="language-ts">let a\n</code></pre><table><tr><th>k<td>v</table><script>no()</script><p>',
 repeat('long words ', CAST(p_partkey % 7 + 30 AS INT)), '</p></main><footer>foot</footer></body></html>')"""


def made(spark, sf_dir):
    workers_find_library(spark)
    one = F.expr(JSON_LD)
    return spread(read(spark, sf_dir, "part").select("p_partkey", "p_name")).select(F.expr(URL).alias("url"), F.lit("html").alias("format"), F.nullif(F.expr(CANONICAL), F.lit("")).alias("head_html"), F.when(one.isNull(), F.array().cast("array<string>")).otherwise(F.array(one)).alias("json_ld"), F.expr(MARKDOWN).alias("markdown"))


def structure_facts(spark, sf_dir):
    found = page_facts(made(spark, sf_dir)).select("url", "structure.*")
    return found.withColumn("headingLevelSkips", F.array_join(F.transform("headingLevelSkips", lambda s: F.concat_ws(">", s["from"], s["to"], s["line"])), ",")).withColumn("unclosedFences", F.size("unclosedFences"))


def link_facts(spark, sf_dir):
    found = page_facts(made(spark, sf_dir)).select("url", "links.*")
    return found.withColumn("primarySourceHosts", F.array_join("primarySourceHosts", ",")).withColumn("externalHosts", F.array_join("externalHosts", ","))


def code_facts(spark, sf_dir):
    found = page_facts(made(spark, sf_dir)).select("url", "code.*")
    return found.withColumn("languages", F.array_join("languages", ",")).withColumn("undefinedConstants", F.array_join("undefinedConstants", ","))


def specific_facts(spark, sf_dir):
    found = page_facts(made(spark, sf_dir)).select("url", "specifics.*")
    return found.withColumn("versionStrings", F.array_join("versionStrings", ",")).withColumn("vagueQuantifiers", F.array_join("vagueQuantifiers", ","))


def metadata_facts(spark, sf_dir):
    m = page_facts(made(spark, sf_dir)).select("url", "metadata.*")
    joined = {c: F.array_join(c, ",") for c in ("types", "keywordStopwords")} | {"parseErrors": F.size("parseErrors"), "codeFenceLanguages": F.to_json("codeFenceLanguages")}
    return m.withColumns(joined).drop("ogTags", "twitterTags", "description", "inLanguage", "dateModified")


def check_verdicts(spark, sf_dir):
    return assessments(page_facts(made(spark, sf_dir))).select("url", "check", "verdict")


def html_extracted(spark, sf_dir):
    """Title, head, JSON-LD and markdown of HTML pages."""
    workers_find_library(spark)
    found = read_pages(spread(read(spark, sf_dir, "part").select("p_partkey", "p_name")).select(F.expr(URL).alias("url"), F.expr(HTML).alias("html")))
    return found.select("url", "format", "title", F.md5("head_html").alias("head"), F.array_join("json_ld", "|").alias("json_ld"), F.md5("markdown").alias("markdown"))


def markdown_passed_through(spark, sf_dir):
    """Pages whose address says that they are markdown already; their title is their first heading."""
    workers_find_library(spark)
    found = read_pages(spread(read(spark, sf_dir, "part").select("p_partkey", "p_name")).select(F.expr(f"concat({URL}, '.md', CASE WHEN p_partkey % 2 = 0 THEN '?a=1' ELSE '' END)").alias("url"), F.expr(MARKDOWN).alias("html")))
    return found.select("url", "format", "title", F.size("json_ld").cast("long").alias("blocks"), F.md5("markdown").alias("markdown"))


def page_content_texts(spark, sf_dir):
    """A page's title, address, head, structured data and content as one text, parts that are missing left out."""
    found = texts.page_text(made(spark, sf_dir).withColumn("title", F.when(F.length("url") % 2 == 0, F.lit("T"))))
    return found.select("url", F.md5("text").alias("text"))


def fact_lines(spark, sf_dir):
    """The lines on links and code of the text of a page's facts."""
    found = texts.facts_text(page_facts(made(spark, sf_dir)))
    return found.select("url", F.regexp_extract("text", r"(?s)(### Links\n.*)\n### Specifics", 1).alias("lines"))


def sql(expression: str) -> str:
    return expression.replace("AS STRING", "AS VARCHAR")


K, U = "p_partkey", sql(URL)
LINK_WORDS = f"CASE {K} % 4 WHEN 0 THEN 4 ELSE 2 END"
CODE_WORDS = f"CASE {K} % 6 WHEN 0 THEN 11 WHEN 1 THEN 11 WHEN 2 THEN 3 WHEN 3 THEN 5 WHEN 4 THEN 9 ELSE 0 END"
REST = f"({K} % 5 + 2 * ({K} % 4) + {LINK_WORDS} + CASE WHEN {K} % 5 = 0 THEN 11 ELSE 0 END + {CODE_WORDS})"
TITLE = "(1 + len(string_split(p_name, ' ')))"
HEADED = f"CASE {K} % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END"
WORDS = f"({TITLE} + 9 + CASE WHEN {K} % 3 < 2 THEN 2 ELSE 0 END + {REST})"
TWO = f"{K} % 3 < 2"
ONE_OF = lambda remainders, of: f"CASE WHEN {K} % {of} IN ({', '.join(map(str, remainders))}) THEN 1 ELSE 0 END"
MISMATCH = f"CASE WHEN {K} % 4 = 0 THEN CASE WHEN {K} % 6 IN (0, 1) THEN false WHEN {K} % 6 IN (3, 4) THEN true END END"
VERDICTS = {
    "jsonld-valid": f"CASE {K} % 4 WHEN 3 THEN 'warn' WHEN 2 THEN 'fail' ELSE 'pass' END",
    "declared-language": f"CASE WHEN {MISMATCH} THEN 'fail' WHEN NOT ({MISMATCH}) THEN 'pass' END",
    "entity-metadata": f"CASE WHEN {K} % 4 < 2 THEN 'warn' END",
    "canonical": f"CASE WHEN {K} % 2 = 0 THEN 'pass' ELSE 'warn' END",
    "freshness": "'warn'",
    "code-fence-validity": f"CASE {K} % 6 WHEN 5 THEN NULL WHEN 4 THEN 'fail' WHEN 2 THEN 'warn' ELSE 'pass' END",
    "heading-structure": f"CASE WHEN {K} % 3 = 0 THEN 'warn' ELSE 'pass' END",
    "code-runnability": f"CASE WHEN {K} % 6 < 2 THEN 'warn' WHEN {K} % 6 = 4 THEN 'pass' END",
    "external-citations": f"CASE {K} % 4 WHEN 3 THEN NULL WHEN 0 THEN 'pass' ELSE 'warn' END",
    "prose-specifics": "CAST(NULL AS VARCHAR)",
}
HEAD = f"'<title>' || p_name || '</title>' || CASE WHEN {K} % 2 = 0 THEN chr(10) || '<link rel=\"canonical\" href=\"https://docs.example/c\">' ELSE '' END || chr(10) || '<meta property=\"og:title\" content=\"t\">' || chr(10) || '<meta name=\"description\" content=\"d\">'"
EXTRACTED = f"'# ' || p_name || '\n\nOne **bold** [link](/x)\ntwo\n\n- a\n- b\n\n```ts\nlet a\n```\n\n| k | v |\n| --- | --- |\n\n' || trim(repeat('long words ', CAST({K} % 7 + 30 AS INT)))"
CANON = f"CASE WHEN {K} % 2 = 0 THEN '<link rel=\"canonical\" href=\"https://docs.example/c\">' END"
JSON = sql(JSON_LD)
SQL = {
    "structure_facts": f"""SELECT {U} AS url, 1 + {HEADED} AS "headingCount", 1 AS "h1Count", CASE WHEN {K} % 3 = 0 THEN '1>3>5' ELSE '' END AS "headingLevelSkips", CASE {K} % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS "maxHeadingDepth", 1 + {HEADED} AS "sectionCount",
      CASE WHEN {TWO} THEN CAST(floor((9 + {REST}) / 2.0::DOUBLE + 0.5) AS INT) ELSE 9 + {REST} END AS "medianSectionWords", CASE WHEN {TWO} THEN greatest(9, {REST}) ELSE 9 + {REST} END AS "maxSectionWords", 0 AS "oversizedSections", {ONE_OF([0], 5)} AS "tableCount", {K} % 4 AS "bulletCount", {WORDS} AS "wordCount",
      {ONE_OF([0, 1, 2, 3, 4], 6)} AS "codeFences", {ONE_OF([4], 6)} AS "unclosedFences", {ONE_OF([2], 6)} AS "untaggedFences" FROM part""",
    "link_facts": f"""SELECT {U} AS url, CASE {K} % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS "totalLinks", {ONE_OF([0, 1], 4)} AS "internalLinks", {ONE_OF([0, 2], 4)} AS "externalLinks", {ONE_OF([0], 4)} AS "primarySourceLinks", CASE WHEN {K} % 4 = 0 THEN 'w3.org' ELSE '' END AS "primarySourceHosts",
      CASE {K} % 4 WHEN 0 THEN 'w3.org' WHEN 2 THEN 'other.example' ELSE '' END AS "externalHosts", {ONE_OF([0], 4)} AS "opaqueLinkTexts" FROM part""",
    "code_facts": f"""SELECT {U} AS url, {ONE_OF([0, 1, 2, 3, 4], 6)} AS "codeBlocks", {ONE_OF([0, 1, 3, 4], 6)} AS "substantiveBlocks", CASE {K} % 6 WHEN 0 THEN 'ts' WHEN 1 THEN 'ts' WHEN 3 THEN 'md' WHEN 4 THEN 'python' ELSE '' END AS languages, {ONE_OF([0, 1, 4], 6)} AS "blocksNeedingImports", {ONE_OF([4], 6)} AS "blocksWithImports",
      {ONE_OF([0, 1], 6)} AS "blocksMissingImports", 0 AS "placeholderBlocks", CASE WHEN {K} % 6 < 2 THEN 'LIMIT_OF_CALLS' ELSE '' END AS "undefinedConstants" FROM part""",
    "specific_facts": f"""WITH s AS (SELECT *, {WORDS} - {CODE_WORDS} AS n, 2 + 2 * {ONE_OF([0], 5)} AS numerals FROM part) SELECT {U} AS url, n AS "proseWordCount", numerals AS "numeralCount", CASE {K} % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS "codeNumeralCount",
      CAST(floor(numerals / n::DOUBLE * 1000 + 0.5) AS INT) AS "numeralDensityPer1kWords", 1 AS "measurementCount", 'v1.' || ({K} % 10) AS "versionStrings", 0 AS "hexIdentifierCount", '' AS "vagueQuantifiers", 0 AS "vagueQuantifierCount" FROM s""",
    "metadata_facts": f"""SELECT {U} AS url, {ONE_OF([0, 1, 2], 4)} AS "jsonLdBlocks", {ONE_OF([2], 4)} AS "parseErrors", CASE {K} % 4 WHEN 0 THEN 'TechArticle' WHEN 1 THEN 'WebPage' ELSE '' END AS types, {K} % 4 < 2 AS "hasArticleType", CASE WHEN {K} % 2 = 0 THEN 'https://docs.example/c' END AS canonical, CASE WHEN {K} % 4 = 1 THEN '2026' END AS "datePublished",
      {K} % 4 = 1 AS "datesIdentical", CASE WHEN {K} % 4 = 0 THEN 'TypeScript' END AS "declaredProgrammingLanguage", CASE {K} % 6 WHEN 0 THEN '{{"ts":1}}' WHEN 1 THEN '{{"ts":1}}' WHEN 3 THEN '{{"sh":1}}' WHEN 4 THEN '{{"python":1}}' ELSE '{{}}' END AS "codeFenceLanguages", {MISMATCH} AS "programmingLanguageMismatch",
      3 * {ONE_OF([0], 4)} AS "keywordCount", {ONE_OF([0], 4)} AS "keywordStopwordCount", CASE WHEN {K} % 4 = 0 THEN 'the' ELSE '' END AS "keywordStopwords", 2 * {ONE_OF([1], 4)} AS "aboutEntries", {ONE_OF([1], 4)} AS "aboutTemplateArtifacts", {ONE_OF([1], 4)} AS "aboutDuplicateNames" FROM part""",
    "check_verdicts": " UNION ALL ".join(f"SELECT {U} AS url, '{check}' AS \"check\", {verdict} AS verdict FROM part" for check, verdict in VERDICTS.items()),
    "html_extracted": f"SELECT {U} AS url, 'html' AS format, p_name AS title, md5({HEAD}) AS head, coalesce({JSON}, '') AS json_ld, md5({EXTRACTED}) AS markdown FROM part",
    "markdown_passed_through": f"SELECT {U} || '.md' || CASE WHEN {K} % 2 = 0 THEN '?a=1' ELSE '' END AS url, 'markdown' AS format, p_name AS title, 0 AS blocks, md5({sql(MARKDOWN)}) AS markdown FROM part",
    "page_content_texts": f"""SELECT {U} AS url, md5(concat_ws(chr(10) || chr(10), '# ' || CASE WHEN length({U}) % 2 = 0 THEN 'T' ELSE {U} END, {U}, '## Head' || chr(10) || {CANON}, '## Structured data' || chr(10) || {JSON}, '## Content' || chr(10) || {sql(MARKDOWN)})) AS text FROM part""",
    "fact_lines": f"""SELECT {U} AS url, concat_ws(chr(10), '### Links', '- totalLinks: ' || CASE {K} % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END, '- externalLinks: ' || {ONE_OF([0, 2], 4)}, '- primarySourceLinks: ' || {ONE_OF([0], 4)}, '- opaqueLinkTexts: ' || {ONE_OF([0], 4)}, '### Code',
      '- codeBlocks: ' || {ONE_OF([0, 1, 2, 3, 4], 6)}, '- blocksNeedingImports: ' || {ONE_OF([0, 1, 4], 6)}, '- blocksMissingImports: ' || {ONE_OF([0, 1], 6)}, '- placeholderBlocks: 0') AS lines FROM part""",
}
QUERIES = [structure_facts, link_facts, code_facts, specific_facts, metadata_facts, check_verdicts, html_extracted, markdown_passed_through, page_content_texts, fact_lines]

"""Texts of facts and pages, content ids, and projections written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.urls import short_hash

#: What the text of a page's facts tells, by section.
FACT_LINES = {
    "Metadata": ["metadata.jsonLdBlocks", "metadata.canonical", "metadata.datePublished", "metadata.dateModified", "metadata.declaredProgrammingLanguage", "metadata.keywordStopwordCount", "metadata.aboutTemplateArtifacts"],
    "Structure": ["structure.headingCount", "structure.h1Count", "structure.headingLevelSkips", "structure.medianSectionWords", "structure.maxSectionWords", "structure.oversizedSections", "structure.codeFences", "structure.untaggedFences"],
    "Links": ["links.totalLinks", "links.externalLinks", "links.primarySourceLinks", "links.opaqueLinkTexts"],
    "Code": ["code.codeBlocks", "code.blocksNeedingImports", "code.blocksMissingImports", "code.placeholderBlocks"],
    "Specifics": ["specifics.proseWordCount", "specifics.numeralCount", "specifics.codeNumeralCount", "specifics.measurementCount", "specifics.vagueQuantifierCount"],
}
#: Facts that are lists; the text tells their length.
LISTS = {"structure.headingLevelSkips"}


def facts_text(facts: DataFrame) -> DataFrame:
    """(url, text): the measured facts of a page as short markdown; facts that are null are said to be unknown."""
    lines: list[Column] = []
    for section, names in FACT_LINES.items():
        lines.append(F.lit(f"### {section}"))
        lines += [F.concat(F.lit(f"- {n.split('.')[1]}: "), F.coalesce((F.size(n) if n in LISTS else F.col(n)).cast("string"), F.lit("unknown"))) for n in names]
    return facts.select("url", F.concat_ws("\n", *lines).alias("text"))


def shown(values: Column) -> Column:
    """The items of a list with commas, or a dash."""
    return F.when(F.size(values) > 0, F.array_join(F.transform(values, lambda v: v.cast("string")), ", ")).otherwise("-")


def facts_report(facts: DataFrame) -> DataFrame:
    """(url, text): all facts of a page as markdown, a line for what belongs together: numbers, lists with their items, fences by language, and "unknown" for what the page doesn't say."""
    m, s, k, c, p = (lambda n, part=part: F.col(f"{part}.{n}") for part in ("metadata", "structure", "links", "code", "specifics"))
    said = lambda x: F.coalesce(x.cast("string"), F.lit("unknown"))
    fences = F.transform(F.array_sort(F.map_entries(m("codeFenceLanguages"))), lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("string")))
    sections = {
        "Metadata": [
            [("structured data blocks", m("jsonLdBlocks")), ("types", shown(m("types"))), ("unreadable", F.size(m("parseErrors")))], [("canonical", m("canonical")), ("language", m("inLanguage")), ("description", m("description"))],
            [("published", m("datePublished")), ("modified", m("dateModified")), ("the same", m("datesIdentical"))], [("programming language", m("declaredProgrammingLanguage")), ("fences", shown(fences)), ("mismatch", m("programmingLanguageMismatch"))],
            [("keywords", m("keywordCount")), ("stopwords", shown(m("keywordStopwords")))], [("about entries", m("aboutEntries")), ("from a template", m("aboutTemplateArtifacts")), ("repeated names", m("aboutDuplicateNames"))], [("og tags", m("ogTags")), ("twitter tags", m("twitterTags"))],
        ],
        "Structure": [
            [("headings", s("headingCount")), ("first level", s("h1Count")), ("deepest level", s("maxHeadingDepth")), ("level skips", F.size(s("headingLevelSkips")))],
            [("sections", s("sectionCount")), ("median words", s("medianSectionWords")), ("most words", s("maxSectionWords")), ("oversized", s("oversizedSections"))], [("tables", s("tableCount")), ("bullets", s("bulletCount")), ("words", s("wordCount"))],
        ],
        "Code": [
            [("blocks", c("codeBlocks")), ("of three lines or more", c("substantiveBlocks")), ("untagged", s("untaggedFences")), ("unclosed at", shown(s("unclosedFences")))], [("languages", shown(c("languages")))],
            [("blocks that need imports", c("blocksNeedingImports")), ("without", c("blocksMissingImports"))], [("placeholders", c("placeholderBlocks")), ("constants without a value", shown(c("undefinedConstants")))],
        ],
        "Citations": [[("links", k("totalLinks")), ("internal", k("internalLinks")), ("external", k("externalLinks")), ("primary", k("primarySourceLinks"))], [("primary hosts", shown(k("primarySourceHosts")))], [("opaque texts", k("opaqueLinkTexts"))]],
        "Specifics": [
            [("numerals", p("numeralCount")), ("per thousand words", p("numeralDensityPer1kWords")), ("with units", p("measurementCount")), ("hexadecimal", p("hexIdentifierCount"))],
            [("numerals in code", p("codeNumeralCount")), ("in code only", (p("numeralCount") == 0) & (p("codeNumeralCount") > 0))], [("versions", shown(p("versionStrings")))], [("vague", shown(p("vagueQuantifiers")))],
        ],
    }
    lines = [x for name, groups in sections.items() for x in (F.lit(f"### {name}"), *(F.concat(F.lit("- "), F.concat_ws("; ", *[F.concat(F.lit(f"{n}: "), said(v)) for n, v in group])) for group in groups))]
    return facts.select("url", F.concat_ws("\n", *lines).alias("text"))


def page_text(pages: DataFrame) -> DataFrame:
    """(url, text): title, address, head, structured data and content of a page, each part only if there is one."""
    block = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), c))
    return pages.select("url", F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce("title", "url")), F.col("url"), block("Head", F.col("head_html")), block("Structured data", F.array_join("json_ld", "\n")), block("Content", F.col("markdown"))).alias("text"))


def thin(text: Column, least: int = 800) -> Column:
    return F.length(F.coalesce(text, F.lit(""))) < least


def estimated_tokens(text: Column) -> Column:
    """Tokens of a text at 3.6 characters each."""
    return F.ceil(F.length(text) / 3.6)


def probe_set_ids(probes: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, probe_set_id): a hash of a set's probes that depends neither on their order nor on that of a probe's fields. Sets are small."""
    body = F.to_json(F.array_sort(F.collect_list(F.struct(*sorted(columns)))))
    return probes.groupBy(by).agg(short_hash(body, 12).alias("probe_set_id"))


def write_projections(tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """Each table's allowed columns as JSON lines under its name, replacing what was there."""
    for name, (table, columns) in tables.items():
        table.select(*columns).write.mode("overwrite").json(f"{path}/{name}")

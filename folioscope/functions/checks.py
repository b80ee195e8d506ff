"""The checks: a registry of verdict and detail expressions over facts. A null verdict means that the check doesn't apply."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    id: str
    weight: int
    html_only: bool
    verdict: Column
    detail: Column


def one_of(*cases: tuple[Column, str | None, Column | str | None]) -> tuple[Column, Column]:
    """First matching (condition, verdict, detail); a condition that is null doesn't match."""
    verdict, detail = F.lit(None).cast("string"), F.lit(None).cast("string")
    for condition, v, d in reversed(cases):
        verdict = F.when(condition, F.lit(v).cast("string")).otherwise(verdict)
        detail = F.when(condition, (d if isinstance(d, Column) else F.lit(d)).cast("string")).otherwise(detail)
    return verdict, detail


def registry() -> list[Check]:
    m, s, k, c, p = (lambda n, part=part: F.col(f"{part}.{n}") for part in ("metadata", "structure", "links", "code", "specifics"))
    always = F.lit(True)
    said = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    rules = [
        ("jsonld-valid", 8, True, one_of((m("jsonLdBlocks") == 0, "warn", "no JSON-LD block"), (F.size(m("parseErrors")) > 0, "fail", said(F.size(m("parseErrors")), " block(s) do not parse")), (always, "pass", None))),
        ("declared-language", 10, True, one_of((m("programmingLanguageMismatch"), "fail", said("declares ", m("declaredProgrammingLanguage"), ", fences are ", F.array_join(F.array_sort(F.map_keys(m("codeFenceLanguages"))), "/"))), (~m("programmingLanguageMismatch"), "pass", None))),
        ("entity-metadata", 6, True, one_of(
            ((m("aboutEntries") == 0) & (m("keywordCount") == 0), None, None),
            ((m("aboutEntries") > 0) & (m("aboutTemplateArtifacts") == m("aboutEntries")), "fail", said(m("aboutTemplateArtifacts"), "/", m("aboutEntries"), " template about entries")),
            ((m("keywordStopwordCount") > 0) | (m("aboutTemplateArtifacts") > 0), "warn", said(m("keywordStopwordCount"), " stopword keyword(s), ", m("aboutTemplateArtifacts"), " template about entries")),
            (always, "pass", None))),
        ("canonical", 4, True, one_of((F.coalesce(m("canonical"), F.lit("")) != "", "pass", None), (always, "warn", "no canonical link"))),
        ("freshness", 3, True, one_of((m("datePublished").isNull() & m("dateModified").isNull(), "warn", "no dates"), (m("datesIdentical"), "warn", "published and modified are the same"), (always, "pass", None))),
        ("code-fence-validity", 5, False, one_of((s("codeFences") == 0, None, None), (F.size(s("unclosedFences")) > 0, "fail", said("unclosed fence at line ", F.get(s("unclosedFences"), F.lit(0)))), (s("untaggedFences") > 0, "warn", said(s("untaggedFences"), " untagged fence(s)")), (always, "pass", None))),
        ("heading-structure", 4, False, one_of((s("headingCount") == 0, None, None), (s("h1Count") != 1, "warn", said(s("h1Count"), " H1 headings")), (F.size(s("headingLevelSkips")) > 0, "warn", said(F.size(s("headingLevelSkips")), " level skip(s)")), (always, "pass", None))),
        ("code-runnability", 8, False, one_of((c("blocksNeedingImports") == 0, None, None), (c("blocksMissingImports") > 0, "warn", said(c("blocksMissingImports"), "/", c("blocksNeedingImports"), " blocks without imports")), (always, "pass", None))),
        ("external-citations", 6, False, one_of((k("totalLinks") == 0, None, None), (k("externalLinks") == 0, "warn", "no external links"), (k("primarySourceLinks") > 0, "pass", None), (always, "warn", "no primary source among external links"))),
        ("prose-specifics", 5, False, one_of((p("proseWordCount") < 100, None, None), ((p("numeralCount") == 0) & (p("codeNumeralCount") > 0), "warn", "numbers in code only"), (p("numeralCount") > 0, "pass", None), (always, "warn", "no numerals in prose"))),
    ]
    return [Check(name, weight, html, verdict, detail) for name, weight, html, (verdict, detail) in rules]


def assessments(facts: DataFrame, checks: list[Check] | None = None) -> DataFrame:
    """(keys of `facts`, check, ord, weight, verdict, detail): a row for each page and check, the verdict null where it doesn't apply."""
    checks = registry() if checks is None else checks
    rows = []
    for i, check in enumerate(checks):
        applies = F.lit(True) if not check.html_only else F.col("format") == "html"
        rows.append(F.struct(F.lit(check.id).alias("check"), F.lit(i).alias("ord"), F.lit(check.weight).alias("weight"), F.when(applies, check.verdict).alias("verdict"), F.when(applies, check.detail).alias("detail")))
    keys = [x for x in facts.columns if x not in ("format", "metadata", "structure", "links", "code", "specifics")]
    return facts.select(*keys, F.explode(F.array(*rows)).alias("a")).select(*keys, "a.*")

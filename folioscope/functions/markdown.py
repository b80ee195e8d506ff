"""Facts of markdown pages: fences, headings, sections, links, code, specifics, metadata. Measurements only, no verdicts.

Which lines are fenced depends on all lines before them, so that one small Arrow function marks them; all facts are expressions over the
lines of a row and their marks, and over JSON-LD as variants. Each page is independent: nothing is shuffled.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

from folioscope.functions.urls import host_of

#: Words, hosts, languages and patterns that the facts count.
STOPWORDS = "a an and are as at be but by for from how in is it of on or that the to was what when where which with you your".split()
VAGUE = ["many", "several", "various", "numerous", "a number of", "some", "most", "broad set of", "wide range", "significant", "substantial", "considerable", "high performance", "low latency", "fast", "quickly", "robust", "scalable"]
PRIMARY_HOSTS = ["ietf.org", "rfc-editor.org", "w3.org", "iso.org", "nist.gov", "github.com", "eips.ethereum.org", "ethereum.org", "arxiv.org", "developer.mozilla.org", "go.dev", "pkg.go.dev", "docs.soliditylang.org", "typescriptlang.org", "python.org", "rust-lang.org"]
NEEDS_IMPORTS = "ts tsx typescript js jsx javascript go golang python py rust rs solidity sol java".split()
ACRONYMS = "HTTP HTTPS JSON URL URI API UTF ABI EVM SDK TODO NOTE FIXME XML HTML CSV UUID CLI RPC REST GRPC".split()
BUILTINS = "MAX_SAFE_INTEGER MIN_SAFE_INTEGER MAX_VALUE MIN_VALUE POSITIVE_INFINITY NEGATIVE_INFINITY EPSILON NEGATIVE MAX_UINT256 MAX_INT256 STDOUT STDERR STDIN".split()
LANGUAGE_ALIASES = {"typescript": ["ts", "tsx", "typescript"], "javascript": ["js", "jsx", "javascript", "node"], "solidity": ["solidity", "sol"], "python": ["python", "py"], "golang": ["go", "golang"], "go": ["go", "golang"], "rust": ["rust", "rs"], "shell": ["sh", "bash", "shell", "zsh"], "json": ["json", "jsonc"]}
FENCE = r"^ {0,3}(`{3,}|~{3,})[ \t]*(.*)$"
HEADING = r"^ {0,3}(#{1,6})\s+(.+?)\s*#*\s*$"
TABLE = r"(?m)^\s*\|.+\|\s*\n\s*\|[\s:|-]+\|\s*$"
BULLET = r"(?m)^\s*[-*+]\s+"
LINK = r'\[([^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\)'
OPAQUE = r"(?i)^(?:here|this|link|click here|read more|docs?)$"
IMPORTS = [r"(?m)^\s*import\s", r"(?m)^\s*from\s+\S+\s+import", r"(?m)^\s*(?:const|let|var)\s+\{?[\w\s,]+\}?\s*=\s*require\(", r"(?m)^\s*#include\s", r"(?m)^\s*use\s+\w", r"(?m)^\s*pragma\s+solidity"]
PLACEHOLDER = r"(?i)(?:/\*|//|#)\s*(?:your|replace|todo|placeholder|base64-encoded|insert|add your|<[A-Z_]{3,}>)"
ASSIGNED = r"(?:const|let|var|=)\s*([A-Z][A-Z0-9_]{2,})\s*[=:]"
CONSTANT = r"\b([A-Z][A-Z0-9_]{3,})\b"
NUMERAL = r"(?<![\w.])[0-9][0-9,]*(?:\.[0-9]+)?"
MEASURE = r"(?i)\b[0-9][0-9,.]*\s?(?:ms|s|sec|seconds?|minutes?|hours?|days?|gwei|wei|eth|gb|mb|kb|bytes?|%|x)\b"
VERSION = r"\b(v?[0-9]+\.[0-9]+(?:\.[0-9]+)?)\b"
HEX = r"\b0x[a-fA-F0-9]{6,}\b"
FENCE_LANGUAGE = r"(?m)^ {0,3}(?:```|~~~)([A-Za-z][\w+-]*)"
ARTICLE = "(?i)Article|BlogPosting|LearningResource|WebPage"
TEMPLATE_ABOUT = "(?i)^Content about "
LANGUAGE_PROPERTY = "(?i)programming language"

TEXT, OPENS, BODY, CLOSES = range(4)
LONG_SECTION, MOST_CONSTANTS, MOST_VERSIONS, PREVIEW = 600, 12, 10, 120


FENCED = re.compile(FENCE)


def marks_of(text: str | None) -> list[int]:
    """Of each line whether it is text, opens a fenced block, is inside or closes one. Only the same character closes, at least as often, and nothing behind it."""
    out, opener = [], None
    for line in (text or "").split("\n"):
        found = FENCED.match(line)
        if opener is None:
            out.append(OPENS if found else TEXT)
            opener = found[1] if found else None
        elif found and found[1].startswith(opener) and not found[2].strip():
            out.append(CLOSES)
            opener = None
        else:
            out.append(BODY)
    return out


@pandas_udf(ArrayType(IntegerType()))
def line_marks(text: pd.Series) -> pd.Series:
    return text.map(marks_of)


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def listed(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def some(column: str, wanted) -> Column:
    return F.filter(column, wanted)


def with_lines(pages: DataFrame) -> DataFrame:
    """`pages` with the lines of the text, the headings (line from 0, level) and the blocks (line from 1, tag, whether closed, body) of each."""
    rows = (pages if "marks" in pages.columns else pages.withColumn("marks", line_marks("text"))).withColumn("lines", F.split("text", "\n", -1))
    at = lambda kind: F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("marks", i) == kind)
    rows = rows.withColumn("opens", at(OPENS)).withColumn("closes", at(CLOSES)).withColumn("outside", at(TEXT))
    level = lambda i: F.length(F.regexp_extract(F.get("lines", i), HEADING, 1))
    rows = rows.withColumn("heads", F.filter(F.transform("outside", lambda i: F.struct(i.alias("at"), level(i).alias("level"))), lambda h: h["level"] > 0))
    # blocks follow one another, so that the n-th opening line belongs to the n-th closing one
    tag = lambda i: F.lower(F.get(F.split(F.trim(F.regexp_extract(F.get("lines", i), FENCE, 2)), r"\s+"), F.lit(0)))
    body = lambda i, n: F.array_join(F.slice("lines", i + 2, F.coalesce(F.get("closes", n), F.size("lines")) - i - 1), "\n")
    blocks = F.transform("opens", lambda i, n: F.struct((i + 1).alias("line"), tag(i).alias("tag"), F.get("closes", n).isNotNull().alias("closed"), body(i, n).alias("body")))
    prose = F.regexp_replace(F.array_join(F.transform("outside", lambda i: F.get("lines", i)), "\n"), "`[^`]*`", "")
    return rows.withColumn("blocks", blocks).withColumn("prose", prose)


def structure() -> Column:
    level_before = lambda n: F.get("heads", n - 1)["level"]
    skips = F.filter(F.transform("heads", lambda h, n: F.struct(F.when(n > 0, level_before(n)).alias("from"), h["level"].alias("to"), (h["at"] + 1).alias("line"))), lambda s: s["to"] > s["from"] + 1)
    per_line = F.transform("lines", words)
    end = lambda n: F.coalesce(F.get("heads", n + 1)["at"], F.size("lines"))
    sizes = F.array_sort(F.transform("heads", lambda h, n: total(F.slice("line_words", h["at"] + 2, end(n) - h["at"] - 1))))
    middle = lambda of: F.floor(F.size(of) / 2).cast("int")
    median = F.when(F.size("sections") == 0, 0).when(F.size("sections") % 2 == 1, F.get("sections", middle("sections"))).otherwise(F.floor((F.get("sections", middle("sections") - 1) + F.get("sections", middle("sections"))) / 2 + 0.5))
    most = lambda values: F.coalesce(F.array_max(values), F.lit(0))
    return {"line_words": per_line, "sections": sizes}, F.struct(
        F.size("heads").alias("headingCount"), F.size(some("heads", lambda h: h["level"] == 1)).alias("h1Count"), skips.alias("headingLevelSkips"), most(F.transform("heads", lambda h: h["level"])).alias("maxHeadingDepth"),
        F.size("sections").alias("sectionCount"), median.cast("int").alias("medianSectionWords"), most(F.col("sections")).alias("maxSectionWords"), F.size(some("sections", lambda w: w > LONG_SECTION)).alias("oversizedSections"),
        F.regexp_count("text", F.lit(TABLE)).alias("tableCount"), F.regexp_count("text", F.lit(BULLET)).alias("bulletCount"), words(F.col("text")).alias("wordCount"), F.size("blocks").alias("codeFences"),
        F.transform(some("blocks", lambda b: ~b["closed"]), lambda b: b["line"]).alias("unclosedFences"), F.size(some("blocks", lambda b: b["tag"] == "")).alias("untaggedFences"),
    )


def links() -> tuple[dict[str, Column], Column]:
    """The links as (label, href, host), and facts of them. A host counts as primary if it is a listed one or below it."""
    label, href = (F.regexp_extract_all("text", F.lit(LINK), n) for n in (1, 2))
    absolute = lambda h: h.rlike("(?i)^https?://")
    found = F.zip_with(label, href, lambda a, h: F.struct(F.trim(a).alias("label"), h.alias("href"), F.when(absolute(h), F.coalesce(host_of(h), F.lit(""))).alias("host")))
    outer = F.filter("found_links", lambda x: x["host"].isNotNull() & ((x["host"] == "") | ~F.coalesce(x["host"] == host_of(F.col("url")), F.lit(False))))
    inner = F.filter("found_links", lambda x: F.when(x["host"].isNull(), ~x["href"].rlike("(?i)^(?:mailto|tel):")).otherwise((x["host"] != "") & F.coalesce(x["host"] == host_of(F.col("url")), F.lit(False))))
    primary = F.filter("outer_hosts", lambda h: F.exists(listed(PRIMARY_HOSTS), lambda p: (h == p) | h.endswith(F.concat(F.lit("."), p))))
    return {"found_links": found, "outer_hosts": F.transform(outer, lambda x: x["host"])}, F.struct(
        F.size("found_links").alias("totalLinks"), F.size(inner).alias("internalLinks"), F.size("outer_hosts").alias("externalLinks"), F.size(primary).alias("primarySourceLinks"), F.array_distinct(primary).alias("primarySourceHosts"),
        F.array_distinct(F.filter("outer_hosts", lambda h: h != "")).alias("externalHosts"), F.size(F.filter("found_links", lambda x: x["label"].rlike(OPAQUE))).alias("opaqueLinkTexts"),
    )


def code(acronyms: list[str]) -> tuple[dict[str, Column], Column]:
    """The blocks of three lines or more in a language that imports, and facts of the code. Constants are those that a block uses and doesn't assign."""
    solid = F.filter("blocks", lambda b: F.size(F.split(F.regexp_replace(b["body"], r"^\s+|\s+$", ""), "\n", -1)) >= 3)
    imports = lambda b: b["body"].rlike(IMPORTS[0]) | b["body"].rlike(IMPORTS[1]) | b["body"].rlike(IMPORTS[2]) | b["body"].rlike(IMPORTS[3]) | b["body"].rlike(IMPORTS[4]) | b["body"].rlike(IMPORTS[5])
    having = F.size(F.filter("importable", imports))
    unknown = lambda b: F.array_except(F.array_except(F.regexp_extract_all(b["body"], F.lit(CONSTANT), 1), F.regexp_extract_all(b["body"], F.lit(ASSIGNED), 1)), listed([*acronyms, *BUILTINS]))
    return {"solid": solid, "importable": F.filter("solid", lambda b: b["tag"].isin(NEEDS_IMPORTS))}, F.struct(
        F.size("blocks").alias("codeBlocks"), F.size("solid").alias("substantiveBlocks"), F.array_distinct(F.filter(F.transform("blocks", lambda b: b["tag"]), lambda t: t != "")).alias("languages"),
        F.size("importable").alias("blocksNeedingImports"), having.alias("blocksWithImports"), (F.size("importable") - having).alias("blocksMissingImports"),
        F.size(F.filter("blocks", lambda b: b["body"].rlike(PLACEHOLDER))).alias("placeholderBlocks"), F.slice(F.array_distinct(F.flatten(F.transform("importable", unknown))), 1, MOST_CONSTANTS).alias("undefinedConstants"),
    )


def specifics() -> Column:
    n, numerals = words(F.col("prose")), F.regexp_count("prose", F.lit(NUMERAL))
    vague = F.filter(listed(VAGUE), lambda v: F.contains(F.lower("prose"), v))
    return F.struct(
        n.alias("proseWordCount"), numerals.alias("numeralCount"), total(F.transform("blocks", lambda b: F.regexp_count(b["body"], F.lit(NUMERAL)))).alias("codeNumeralCount"), F.when(n > 0, F.floor(numerals / n * 1000 + 0.5)).otherwise(0).cast("int").alias("numeralDensityPer1kWords"),
        F.regexp_count("prose", F.lit(MEASURE)).alias("measurementCount"), F.slice(F.array_distinct(F.regexp_extract_all("prose", F.lit(VERSION), 1)), 1, MOST_VERSIONS).alias("versionStrings"), F.regexp_count("prose", F.lit(HEX)).alias("hexIdentifierCount"),
        vague.alias("vagueQuantifiers"), F.size(vague).alias("vagueQuantifierCount"),
    )


def field(node: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(node, path, kind)


def metadata() -> tuple[dict[str, Column], Column]:
    """The nodes of the JSON-LD blocks as variants, the one that describes the article, and facts of them and of the head. A block that doesn't parse is an error, not a loss.
    The head is read in the form that sources/html.py writes, whatever order the page's own attributes have: one tag a line, the name before the content.
    """
    is_object = lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    opened = lambda v: F.coalesce(field(v, "$['@graph']", "array<variant>"), F.array(v))
    kind = lambda v: F.coalesce(field(v, "$['@type'][0]"), field(v, "$['@type']"))
    steps = {
        "parsed": F.transform("json_ld", F.try_parse_json),
        "nodes": F.filter(F.flatten(F.transform(F.filter("parsed", lambda v: v.isNotNull()), opened)), lambda v: v.isNotNull() & is_object(v)),
        "article": F.get(F.filter("nodes", lambda v: F.coalesce(kind(v).rlike(ARTICLE), F.lit(False))), F.lit(0)),
        "fence_languages": F.transform(F.regexp_extract_all("text", F.lit(FENCE_LANGUAGE), 1), F.lower),
        "declared": F.coalesce(field(F.col("article"), "$.programmingLanguage"), F.get(F.transform(F.filter(field(F.col("article"), "$.additionalProperty", "array<variant>"), lambda p: F.coalesce(field(p, "$.name").rlike(LANGUAGE_PROPERTY), F.lit(False))), lambda p: field(p, "$.value")), F.lit(0))),
        "keywords": F.coalesce(field(F.col("article"), "$.keywords", "array<string>"), F.filter(F.transform(F.split(field(F.col("article"), "$.keywords"), ","), lambda w: F.trim(w)), lambda w: w != ""), F.array().cast("array<string>")),
        "about": F.coalesce(field(F.col("article"), "$.about", "array<variant>"), F.array().cast("array<variant>")),
        "head_lines": F.split(F.coalesce("head_html", F.lit("")), "\n"),
    }
    errors = F.filter(F.transform("json_ld", lambda raw, n: F.struct(n.alias("index"), F.when(F.get("parsed", n).isNull(), "not JSON").alias("message"), F.left(raw, F.lit(PREVIEW)).alias("preview"))), lambda e: e["message"].isNotNull())
    said = lambda path: field(F.col("article"), path)
    declared = F.lower(F.trim("declared"))
    aliases = F.create_map(*[x for name, known in LANGUAGE_ALIASES.items() for x in (F.lit(name), listed(known))])
    accepted = F.coalesce(F.try_element_at(aliases, declared), F.array(declared))
    mismatch = F.when((F.size("fence_languages") > 0) & F.col("declared").isNotNull(), ~F.arrays_overlap(accepted, "fence_languages"))
    counts = F.map_from_entries(F.transform(F.array_distinct("fence_languages"), lambda t: F.struct(t, F.size(F.filter("fence_languages", lambda u: u == t)))))
    stops = F.filter("keywords", lambda w: F.regexp_replace(F.lower(w), "[.,]", "").isin(STOPWORDS))
    names = F.filter(F.transform("about", lambda a: field(a, "$.name")), lambda n: n.isNotNull())
    line = lambda pattern: F.regexp_extract(F.get(F.filter("head_lines", lambda t: t.rlike(pattern)), F.lit(0)), pattern, 1)
    tagged = lambda start: F.size(F.filter("head_lines", lambda t: F.startswith(t, F.lit(start))))
    return steps, F.struct(
        F.size("json_ld").alias("jsonLdBlocks"), errors.alias("parseErrors"), F.filter(F.transform("nodes", kind), lambda t: t.isNotNull()).alias("types"), F.col("article").isNotNull().alias("hasArticleType"),
        line('^<link rel="canonical" href="(.*)">$').alias("canonical"), tagged('<meta property="og:').alias("ogTags"), tagged('<meta name="twitter:').alias("twitterTags"), line('^<meta name="description" content="(.*)">$').alias("description"),
        said("$.inLanguage").alias("inLanguage"), said("$.datePublished").alias("datePublished"), said("$.dateModified").alias("dateModified"), F.coalesce(said("$.datePublished") == said("$.dateModified"), F.lit(False)).alias("datesIdentical"),
        F.col("declared").alias("declaredProgrammingLanguage"), counts.alias("codeFenceLanguages"), mismatch.alias("programmingLanguageMismatch"), F.size("keywords").alias("keywordCount"), F.size(stops).alias("keywordStopwordCount"), stops.alias("keywordStopwords"),
        F.size("about").alias("aboutEntries"), F.size(F.filter("about", lambda a: F.coalesce(field(a, "$.description").rlike(TEMPLATE_ABOUT), F.lit(False)))).alias("aboutTemplateArtifacts"), (F.size(names) - F.size(F.array_distinct(names))).alias("aboutDuplicateNames"),
    )


def page_facts(pages: DataFrame, acronyms: list[str] = ACRONYMS) -> DataFrame:
    """(url, format, metadata, structure, links, code, specifics) of (url, format, head_html, json_ld, markdown); a missing format is html, a missing text
    empty. `acronyms` are words in capitals that are no constants; a documentation set adds its own. Pages that come with the `marks` of their lines keep them.
    """
    marked = ["marks"] if "marks" in pages.columns else []
    rows = with_lines(pages.select(*marked, "url", F.coalesce("format", F.lit("html")).alias("format"), "head_html", F.coalesce("json_ld", F.array().cast("array<string>")).alias("json_ld"), F.coalesce("markdown", F.lit("")).alias("text")))
    facts = {"specifics": specifics()}
    for name, (steps, found) in {"structure": structure(), "links": links(), "code": code(acronyms), "metadata": metadata()}.items():
        for step, column in steps.items():
            rows = rows.withColumn(step, column)
        facts[name] = found
    return rows.select("url", "format", *[facts[n].alias(n) for n in ("metadata", "structure", "links", "code", "specifics")])

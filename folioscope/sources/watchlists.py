"""Watchlists and target texts: every violation as a row, and what is valid as pages. Both are Columns; nothing is parsed in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSIONS = [1]
KINDS = ["product", "watchlist", "page"]
HREF = r"^([A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#\\\s]*)?)([^\s]*)$"


def is_url(url: Column) -> Column:
    """Whether an address has a scheme, and a host where its scheme needs one."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#\s]+[^\s]*$") | (url.rlike(HREF) & ~url.rlike(r"(?i)^https?:")), F.lit(False))


def origin_of(url: Column) -> Column:
    """Scheme and host in lower case, without the port that the scheme has anyway."""
    low = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*)", 1))
    return F.regexp_replace(low, r"^(http://[^/]*):80$|^(https://[^/]*):443$", "$1$2")


def href(url: Column) -> Column:
    """An address as a browser writes it: scheme and host in lower case, a slash where nothing follows the host."""
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*)", 1)
    rest = F.substring(url, F.length(head) + 1, F.length(url))
    return F.when(head == "", url).otherwise(F.concat(origin_of(url), F.when(rest.rlike(r"^[?#]|^$"), F.concat(F.lit("/"), rest)).otherwise(rest)))


def watchlist_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the files at a path."""
    name = F.regexp_extract("_metadata.file_path", r"([^/]+?)(?:\.json)?(?:/part-[^/]*)?$", 1)
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.regexp_replace(name, r"^file=", "").alias("file"), F.col("value").alias("text"))


def problem(kind: str, condition: Column, position: Column | None = None, value: Column | None = None) -> Column:
    nothing = F.lit(None).cast("string")
    return F.when(condition, F.struct(F.lit(kind).alias("problem"), (F.lit(None).cast("int") if position is None else position).alias("position"), (nothing if value is None else value).alias("value")))


def examined(texts: DataFrame, origin: str | None = None) -> DataFrame:
    """(file, name, description, pages, problems) of watchlists: all problems of each at once, in one pass over its JSON. A page's problem has its position, from 0;
    of pages with one address all but the first are duplicates. What isn't JSON, or no object, has that problem only, and no version, name or list is looked for in it.
    """
    rows = texts.withColumn("body", F.try_parse_json("text"))
    kind = F.schema_of_variant("body")
    get = lambda path, to: F.try_variant_get(F.col("body"), path, to)
    rows = rows.select(
        "file", F.col("body").isNull().alias("unread"), F.coalesce(kind.startswith("OBJECT"), F.lit(False)).alias("object"), get("$.version", "variant").alias("v"), get("$.name", "variant").alias("n"), get("$.description", "string").alias("description"), get("$.pages", "array<variant>").alias("p"),
    )
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    number = F.when(F.schema_of_variant("v") == "BIGINT", F.try_variant_get("v", "$", "int"))
    pages = F.transform("p", lambda v: F.struct(text(v).alias("url"), F.to_json(v).alias("shown")))
    rows = rows.select("*", number.alias("version"), text(F.col("n")).alias("name"), F.coalesce(pages, F.array().cast("array<struct<url: string, shown: string>>")).alias("pages"))
    rows = rows.withColumn("keys", F.transform("pages", lambda p: F.when(is_url(p["url"]), href(p["url"]))))
    own = F.lower(F.lit(origin_only(origin))) if origin else None

    def of_page(page: Column, i: Column) -> Column:
        url, key = page["url"], F.get("keys", i)
        found = [
            problem("not-text", url.isNull(), i, page["shown"]), problem("not-an-address", url.isNotNull() & ~is_url(url), i, url),
            problem("duplicate", key.isNotNull() & (F.array_position("keys", key) <= i), i, url),
        ]
        if own is not None:
            found.append(problem("off-origin", key.isNotNull() & (origin_of(url) != own), i, url))
        return F.array_compact(F.array(*found))

    whole = F.array_compact(F.array(
        problem("version", F.col("version").isNull() | ~F.col("version").isin(VERSIONS), value=F.to_json("v")), problem("name", F.coalesce("name", F.lit("")) == ""), problem("pages", F.size("pages") == 0),
    ))
    inside = F.concat(whole, F.flatten(F.transform("pages", of_page)))
    problems = F.when(F.col("unread"), F.array(problem("not-json", F.lit(True)))).when(~F.col("object"), F.array(problem("not-an-object", F.lit(True)))).otherwise(inside)
    return rows.select("file", "name", "description", F.transform("pages", lambda p: p["url"]).alias("pages"), problems.alias("problems"))


def origin_only(origin: str) -> str:
    scheme, _, rest = origin.partition("://")
    return f"{scheme}://{rest.split('/')[0]}"


def watchlist_problems(texts: DataFrame, origin: str | None = None) -> DataFrame:
    """(file, problem, position, value): a row for each violation."""
    return examined(texts, origin).select("file", F.explode("problems").alias("p")).select("file", "p.problem", "p.position", "p.value")


def watchlist_pages(texts: DataFrame, origin: str | None = None) -> DataFrame:
    """(name, ord, url, source, included) of valid watchlists. One with a problem fails the job with all that is wrong with it."""
    said = F.concat(F.col("file"), F.lit(": "), F.array_join(F.transform("problems", lambda p: F.concat_ws(" ", p["problem"], p["position"], p["value"])), "; "))
    checked = examined(texts, origin).withColumn("name", F.when(F.size("problems") == 0, F.col("name")).otherwise(F.raise_error(said)))
    return checked.select("name", F.posexplode("pages").alias("ord", "url")).select("name", "ord", "url", F.lit("watchlist").alias("source"), F.lit(True).alias("included"))


def targets(specs: DataFrame, spec: str = "spec") -> DataFrame:
    """`specs` with the kind and the rest of each target text, split at its first colon, so that an address keeps its own, and what is wrong with it; a page must be an http address."""
    at = F.instr(F.col(spec), ":")
    kind, rest = F.substring(spec, F.lit(1), at - 1), F.substring(spec, at + 1, F.length(spec))
    wrong = (
        F.when(F.coalesce(F.trim(spec), F.lit("")) == "", "empty").when(at == 0, "no kind").when(~kind.isin(KINDS), "unknown kind").when(rest == "", "no name")
        .when((kind == "page") & ~(is_url(rest) & rest.rlike("(?i)^https?:")), "no address")
    )
    return specs.select("*", F.when(wrong.isNull(), kind).alias("kind"), F.when(wrong.isNull(), rest).alias("name"), wrong.alias("problem"))


def page_targets(resolved: DataFrame) -> DataFrame:
    """(name, ord, url, source, included) of the targets that are a page: a ledger of one row each."""
    return resolved.where("kind = 'page'").select("name", F.lit(0).alias("ord"), F.col("name").alias("url"), F.lit("explicit").alias("source"), F.lit(True).alias("included"))

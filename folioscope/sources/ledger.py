"""Page ledgers: what a curated index and a site map list, watchlists, single pages, and what has changed since."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import urls

NOT_A_PAGE = r"(?i)\.(?:txt|xml|json|png|jpe?g|svg|gif|pdf|zip)$"


def curated_pages(index: DataFrame, prefix: str) -> DataFrame:
    """(url) listed by markdown index texts (text, base) under a product's prefix."""
    found = index.select(F.explode(urls.links_from(F.col("text"), F.col("base"))).alias("url"))
    return under_prefix(found, prefix)


def sitemap_pages(maps: DataFrame, prefix: str) -> DataFrame:
    """(url) of site maps (location, text) under a prefix; an index of site maps is followed one level, within the table."""
    listed = maps.select("location", F.explode(urls.sitemap_locations(F.col("text"))).alias("url"))
    inner = listed.join(maps.select(F.col("location").alias("url"), "text"), "url").select(F.explode(urls.sitemap_locations(F.col("text"))).alias("url"))
    return under_prefix(listed.select("url").union(inner).where(~F.col("url").rlike(r"(?i)\.xml$")), prefix)


def under_prefix(found: DataFrame, prefix: str) -> DataFrame:
    page = urls.ledger_key(F.col("url"))
    return found.select(page.alias("url")).where(~F.col("url").rlike(NOT_A_PAGE) & urls.under(F.col("url"), F.lit(prefix.rstrip("/")))).distinct()


def ledger(curated: DataFrame, sitemap: DataFrame, scope: str = "curated", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, url, source, included, reason) of all pages that either side lists; both sides are (keys, url)."""
    if scope not in ("curated", "full", "bundle"):
        raise ValueError(f"unknown scope {scope}")
    on = [*keys, "url"]
    sides = curated.select(*on).distinct().withColumn("in_curated", F.lit(True)).join(sitemap.select(*on).distinct().withColumn("in_sitemap", F.lit(True)), on, "full_outer")
    included = F.coalesce("in_sitemap" if scope == "full" else "in_curated", F.lit(False))
    source = F.when(F.col("in_curated") & F.col("in_sitemap"), "both").when(F.col("in_curated"), "llms.txt").otherwise("sitemap")
    reason = F.when(~included, "not-in-sitemap" if scope == "full" else "not-in-curated-index")
    return sides.select(*on, source.alias("source"), included.alias("included"), reason.alias("reason"))


def ledger_counts(pages: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """discovered, curated, sitemap, in_scope, excluded, and the pages that the index leaves out, by the keys of a ledger."""
    curated, sitemap = F.count_if(F.col("source").isin("both", "llms.txt")), F.count_if(F.col("source").isin("both", "sitemap"))
    counted = pages.groupBy(*keys).agg(F.count("*").alias("discovered"), curated.alias("curated"), sitemap.alias("sitemap"), F.count_if("included").alias("in_scope"), F.count_if(~F.col("included")).alias("excluded"))
    return counted.withColumn("curated_gap", F.when((F.col("curated") > 0) & (F.col("curated") < F.col("sitemap")), F.col("sitemap") - F.col("curated")))


def changed_since(now: DataFrame, before: DataFrame, keys: tuple[str, ...] = ("url",)) -> DataFrame:
    """(keys, content_hash, changed): a page is unchanged only if both hashes are known and equal."""
    prior = before.select(*keys, F.col("content_hash").alias("prior_hash"))
    return now.join(prior, list(keys), "left").select(*keys, "content_hash", (~F.coalesce(F.col("content_hash") == F.col("prior_hash"), F.lit(False))).alias("changed"))


def fetched(ledger_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Included ledger rows with their page (url, title, markdown, error); a page that is missing is not fetched."""
    page = pages.select(urls.ledger_key(F.col("url")).alias("url"), "title", "markdown", "error")
    text = F.col("markdown")
    return ledger_rows.where("included").join(page, "url", "left").withColumn("fetched", F.col("error").isNull() & text.isNotNull()).withColumn("content_hash", urls.short_hash(text)).withColumn("bytes", F.length(text))


def watchlist(spark: SparkSession, path: str, origin: str) -> DataFrame:
    """(name, ord, url) of watchlist files; version 1 only, no page twice, none off the origin, else the read fails."""
    rows = spark.read.schema("version int, name string, description string, pages array<string>").json(path, multiLine=True)
    normal = F.transform("pages", urls.normalize_url)
    problem = (
        F.when(F.coalesce("version", F.lit(0)) != 1, F.concat(F.lit("unsupported version in "), F.coalesce("name", F.lit("?"))))
        .when(F.size(F.array_distinct(normal)) < F.size("pages"), F.concat(F.lit("duplicate page in "), F.col("name")))
        .when(F.exists("pages", lambda p: ~urls.under(p, F.lit(origin.rstrip("/")))), F.concat(F.lit("page off the origin in "), F.col("name")))
    )
    checked = rows.withColumn("name", F.when(problem.isNull(), F.col("name")).otherwise(F.raise_error(F.coalesce(problem, F.lit("")))))
    return checked.select("name", F.posexplode("pages").alias("ord", "url"))


def target(spec: str) -> tuple[str, str]:
    """(type, name) of a target text, split at its first colon; a web address is a page."""
    if spec.startswith(("http://", "https://")):
        return "page", spec
    kind, colon, name = spec.partition(":")
    if not colon or kind not in ("product", "watchlist", "page") or not name or (kind == "page" and not name.startswith(("http://", "https://"))):
        raise ValueError(f"not a target: {spec}")
    return kind, name


def products(index: DataFrame, origin: str) -> DataFrame:
    """Distinct product names of a root index (text, base)."""
    found = index.select(F.explode(urls.links_from(F.col("text"), F.col("base"))).alias("url")).where(urls.under(F.col("url"), F.lit(origin.rstrip("/"))))
    return found.select(urls.product_of(F.col("url")).alias("product")).where("product not in ('(none)', '(site root)')").distinct().orderBy("product")

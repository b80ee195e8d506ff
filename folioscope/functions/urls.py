"""URL keys and URL-bearing text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"(?i)^[a-z][a-z0-9+.-]*://"


def with_scheme(url: Column) -> Column:
    url = F.trim(url)
    return F.when(url.rlike(SCHEME), url).otherwise(F.concat(F.lit("https://"), url))


def host_of(url: Column) -> Column:
    """Lower-cased host without www; null where there is none."""
    host = F.regexp_extract(F.lower(with_scheme(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\s]+)", 1)
    return F.when(host != "", F.regexp_replace(host, r"^www\.", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(with_scheme(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def normalize_url(url: Column) -> Column:
    """host + path: no scheme, www, query, fragment, trailing slash or .md, all lower case; null for what is no URL."""
    path = F.lower(F.regexp_replace(F.regexp_replace(path_of(url), "/+$", ""), r"(?i)\.md$", ""))
    return F.concat(host_of(url), path)


#: Fixed patterns: addresses in a text, the punctuation that closes them, and two shapes of keys.
BODY_URL, CLOSING = r"""(https?://[^\s)\]}"'`<>]+)""", "[.,;:!?]+$"
KEYS = [r"sk-[a-z]{2,6}-[A-Za-z0-9_-]{10,}", r"\bsk-[A-Za-z0-9]{20,}\b"]


def body_urls(text: Column) -> Column:
    """Distinct http(s) URLs of a text in order, without closing punctuation."""
    found = F.regexp_extract_all(text, F.lit(BODY_URL), 1)
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, CLOSING, "")))


def mentions(answer: Column, key: Column) -> Column:
    """Whether the answer names the page of this key, with or without scheme, and neither a sibling nor a child of it."""
    escaped = F.regexp_replace(key, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    pattern = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_.-])(?:https?://)?(?:www\.)?"), escaped, F.lit(r"(?:\.md)?(?!/?[A-Za-z0-9_-])"))
    return F.regexp_like(answer, pattern)


def segments(url: Column) -> Column:
    return F.filter(F.split(path_of(url), "/"), lambda s: s != "")


def dashed(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9-]+", "-"), "-+", "-"), "^-|-$", ""))


def page_key(url: Column) -> Column:
    """Key of all path segments, or of the host for a root; the host is not in it, so that keys can collide (see uniqueness_violations)."""
    return dashed(F.when(F.size(segments(url)) > 0, F.array_join(segments(url), "-")).otherwise(host_of(url)))


def slug(url: Column) -> Column:
    """Short name of the last two path segments, or of the host."""
    parts = segments(url)
    return dashed(F.when(F.size(parts) > 0, F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), "-")).otherwise(host_of(url)))


def product_of(url: Column) -> Column:
    """First path segment without .md; sentinels for a site root and for no URL."""
    first = F.get(segments(url), F.lit(0))
    return F.when(url.isNull() | host_of(url).isNull(), "(none)").when(first.isNull(), "(site root)").otherwise(F.regexp_replace(first, r"\.md$", ""))


def product_of_run(kind: Column, name: Column) -> Column:
    return F.when(name.isNull(), "(none)").when(kind == "product", name).when(kind == "page", product_of(name)).otherwise(F.concat(name, F.lit(" ("), kind, F.lit(")")))


def ledger_key(url: Column) -> Column:
    """A ledger's URL: without fragment first, then without trailing slashes, so that `a/#x` and `a` are one."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "/+$", "")


def under(url: Column, prefix: Column) -> Column:
    """Equal to the prefix or below it; `ab` does not cover `abc`."""
    return (url == prefix) | F.startswith(url, F.concat(prefix, F.lit("/")))


def links_from(text: Column, base: Column) -> Column:
    """Absolute URLs of a markdown text's inline links; relative ones are set on the base's host or folder."""
    hrefs = F.regexp_extract_all(text, F.lit(r"\]\(([^)\s]+)"), 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_replace(base, r"(?<!/)/[^/]*$", "/")
    absolute = lambda h: F.when(h.rlike(SCHEME), h).when(F.startswith(h, F.lit("/")), F.concat(origin, h)).otherwise(F.concat(folder, h))
    return F.array_distinct(F.transform(F.filter(hrefs, lambda h: ~h.rlike("^(?:#|mailto:|tel:)")), absolute))


def sitemap_locations(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)


def redact(text: Column, secrets: Column | None = None) -> Column:
    """Key-shaped substrings, and each literal of `secrets` of over 8 characters, as [redacted]."""
    if secrets is not None:
        text = F.aggregate(F.filter(secrets, lambda s: F.length(s) > 8), text, lambda acc, s: F.replace(acc, s, F.lit("[redacted]")))
    return F.regexp_replace(F.regexp_replace(text, KEYS[0], "[redacted]"), KEYS[1], "[redacted]")


def short_hash(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def csv_field(value: Column) -> Column:
    """RFC 4180 quoting; null is an empty field."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


#: Fixed patterns of account-level failures, and of passing ones that never count as such.
FATAL = "credit balance is too low|billing|quota (?:has been )?exceeded|authentication_error|could not resolve authentication method|invalid[_ ]api[_ ]key|permission[_ ]error|account.*(?:suspended|disabled)"
PASSING = r"rate[_ ]limit|overloaded|\b529\b"


def is_fatal(error: Column) -> Column:
    text = F.coalesce(error, F.lit(""))
    return text.rlike(f"(?i)(?:{FATAL})") & ~text.rlike(f"(?i)(?:{PASSING})")

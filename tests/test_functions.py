"""Known answers of scalar functions and of page facts."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import num, urls
from folioscope.functions.markdown import page_facts
from folioscope.sources.html import extract


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], kinds).select(column).first()[0]


@pytest.mark.parametrize(("x", "digits", "want"), [(-2.5, 0, -2.0), (2.5, 0, 3.0), (-0.25, 1, -0.2), (0.125, 2, 0.13), (None, 1, None)])
def test_half_up(spark, x, digits, want):
    assert spark.createDataFrame([(x,)], "x double").select(num.half_up(F.col("x"), digits)).first()[0] == want


def test_ratio_needs_a_denominator(spark):
    rows = spark.createDataFrame([(1, 0), (1, None), (1, 3)], "a int, b int").select(num.ratio(F.col("a"), F.col("b"), 2)).collect()
    assert [r[0] for r in rows] == [None, None, 0.33]


def test_correlation_guards(spark):
    frame = lambda rows: spark.createDataFrame(rows, "x double, y double")
    assert frame([(1.0, 2.0), (1.0, 3.0)]).agg(num.correlation(F.col("x"), F.col("y"))).first()[0] is None
    assert frame([(1.0, 2.0)]).agg(num.correlation(F.col("x"), F.col("y"))).first()[0] is None
    assert frame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 4.0)]).agg(num.correlation(F.col("x"), F.col("y"))).first()[0] == pytest.approx(0.8)
    assert frame([(1.0, 2.0), (2.0, 4.0)]).agg(num.slope(F.col("x"), F.col("y"))).first()[0] == 2.0


@pytest.mark.parametrize(("url", "want"), [("https://www.Docs.example/A/B.md/?q#f", "docs.example/a/b"), ("docs.example/a.md", "docs.example/a"), ("http://docs.example", "docs.example"), ("", None), (None, None)])
def test_normalize_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(urls.normalize_url(F.col("u"))).first()[0] == want


@pytest.mark.parametrize(("text", "want"), [("see docs.example/g/start.", True), ("see docs.example/g/start-v2", False), ("docs.example/g/start/more", False), ("`https://www.docs.example/g/start.md`", True), ("xdocs.example/g/start", False)])
def test_mentions(spark, text, want):
    assert one(spark, urls.mentions(F.col("t"), F.lit("docs.example/g/start")), t=text) is want


def test_url_helpers(spark):
    url = "https://docs.example/Data-Feeds/api/v1.2/"
    row = spark.createDataFrame([(url,)], "u string").select(urls.page_key(F.col("u")), urls.slug(F.col("u")), urls.product_of(F.col("u")), urls.ledger_key(F.lit("https://a.example/x/#y"))).first()
    assert tuple(row) == ("data-feeds-api-v1-2", "api-v1-2", "Data-Feeds", "https://a.example/x")
    assert one(spark, urls.body_urls(F.col("t")), t="a https://x.example/1, (https://y.example/2) https://x.example/1.") == ["https://x.example/1", "https://y.example/2"]
    assert one(spark, urls.csv_field(F.col("t")), t='a "b", c') == '"a ""b"", c"'
    assert one(spark, urls.redact(F.col("t"), F.col("s")), t="key mysecretvalue sk-abcdefghij0123456789xyz", s=["mysecretvalue"]) == "key [redacted] [redacted]"
    assert one(spark, urls.links_from(F.col("t"), F.lit("https://a.example/x/llms.txt")), t="[a](/p) [b](q.md) [c](https://b.example/z) [d](mailto:x)") == ["https://a.example/p", "https://a.example/x/q.md", "https://b.example/z"]


@pytest.mark.parametrize(("error", "want"), [("billing hard limit", True), ("rate_limit while billing", False), ("status 529 billing", False), (None, False), ("timeout", False)])
def test_fatal(spark, error, want):
    assert spark.createDataFrame([(error,)], "e string").select(urls.is_fatal(F.col("e"))).first()[0] is want


PAGE = """# Title

Intro 12 items take 30 ms on v1.2.

````md
```ts
inner
```
````

### Skipped

```sh
# no heading
```

```python
x = 1
y = MISSING_NAME
z = 3
```

```js
"""


def facts(spark, text, url="https://docs.example/p", head=None, blocks=()):
    row = page_facts(spark.createDataFrame([(url, "html", head, list(blocks), text)], "url string, format string, head_html string, json_ld array<string>, markdown string")).first()
    return row.asDict(recursive=True)


def test_structure_and_code(spark):
    found = facts(spark, PAGE)
    s, c, p = found["structure"], found["code"], found["specifics"]
    assert s["headingCount"] == 2 and s["h1Count"] == 1 and s["headingLevelSkips"] == [{"from": 1, "to": 3, "line": 11}] and s["maxHeadingDepth"] == 3
    assert s["codeFences"] == 4 and s["unclosedFences"] == [23] and s["untaggedFences"] == 0
    assert c["blocksNeedingImports"] == 1 and c["blocksMissingImports"] == 1 and c["undefinedConstants"] == ["MISSING_NAME"] and c["languages"] == ["md", "sh", "python", "js"]
    assert p["numeralCount"] == 2 and p["measurementCount"] == 1 and p["versionStrings"] == ["v1.2"]
    assert facts(spark, "some awesome\n\n```sh\n1 2\n```")["specifics"]["codeNumeralCount"] == 2


def test_runnable_code(spark):
    text = "```ts\nconst tx = { to: CHAIN_SELECTOR };\nconst n = Number.MAX_SAFE_INTEGER;\nuse(tx, n, HTTP);\n```\n```js\nimport a from 'a';\nconst LIMIT = 3\n// your key\nLIMIT\n```\n````\n```\nnot closed by the shorter one\n```\n````"
    c = facts(spark, text)["code"]
    assert (c["codeBlocks"], c["substantiveBlocks"], c["blocksNeedingImports"], c["blocksWithImports"], c["placeholderBlocks"], c["undefinedConstants"]) == (3, 3, 2, 1, 1, ["CHAIN_SELECTOR"])


def test_tables_bullets_and_sections(spark):
    text = "# A\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n- x\n* y\n1. z\n\n## B\none two three\n```\n- in code\n```\n## C\n" + "w " * 700
    s = facts(spark, text)["structure"]
    assert (s["tableCount"], s["bulletCount"], s["sectionCount"], s["maxSectionWords"], s["oversizedSections"], s["untaggedFences"]) == (1, 3, 3, 700, 1, 1)


def test_links(spark):
    text = "[here](/a) [rfc](https://www.rfc-editor.org/x) [x](https://docs.example/b) [fake](https://notgithub.com/) [m](mailto:a@b)"
    found = facts(spark, text)["links"]
    assert (found["totalLinks"], found["internalLinks"], found["externalLinks"], found["primarySourceLinks"], found["opaqueLinkTexts"]) == (5, 2, 2, 1, 1)


def test_metadata(spark):
    good = '{"@graph": [{"@type": ["TechArticle"], "keywords": "chain, the, data", "about": [{"name": "A", "description": "Content about a"}, {"name": "A"}], "datePublished": "2026", "dateModified": "2026", "additionalProperty": [{"name": "Programming Language", "value": "TypeScript"}]}]}'
    head = extract("https://x.example/p", '<head><link href="https://x.example/" rel="canonical"><meta content="d" name="description"><meta property="og:title" content="t"><meta name="twitter:card" content="c"></head>')["head_html"]
    found = facts(spark, "```ts\nx\n```", head=head, blocks=["{oops", good])["metadata"]
    assert [(e["index"], e["preview"]) for e in found["parseErrors"]] == [(0, "{oops")] and found["hasArticleType"] and found["types"] == ["TechArticle"] and found["keywordStopwords"] == ["the"]
    assert found["aboutTemplateArtifacts"] == 1 and found["aboutDuplicateNames"] == 1 and found["datesIdentical"] and found["codeFenceLanguages"] == {"ts": 1}
    assert found["programmingLanguageMismatch"] is False and (found["canonical"], found["description"], found["ogTags"], found["twitterTags"]) == ("https://x.example/", "d", 1, 1)
    assert facts(spark, "")["metadata"]["programmingLanguageMismatch"] is None
    odd = facts(spark, "", blocks=["[1, null]", '"x"', '{"@type": "Article", "additionalProperty": 3, "about": [1], "keywords": ["a", 2]}'])["metadata"]
    assert odd["aboutEntries"] == 1 and odd["keywordCount"] == 2 and odd["types"] == ["Article"]


def test_extract():
    body = "<html><head><title>T</title><meta name='description' content='d'><script type='application/ld+json'> {} </script></head><body><nav>no</nav><main><h1>H</h1><p>a <b>b</b><br>c</p><ul><li>x<li>y</ul><pre><code class='language-ts'>let a\n</code></pre><table><tr><th>k<td>v</table><p>" + "w " * 150
    page = extract("https://x.example/", body)
    assert page["title"] == "T" and page["json_ld"] == ["{}"] and "no" not in page["markdown"].split()
    for part in ("# H", "a **b**\nc", "- x\n- y", "```ts\nlet a\n```", "| k | v |"):
        assert part in page["markdown"], part
    assert extract("u", "")["markdown"] == "" and extract("u", "<div><p>open")["markdown"] == "open"


def test_extract_of_deep_nesting():
    page = extract("u", "<article><h1>H</h1>" + "<p><b>one<br>two" * 400 + "</article>")["markdown"]
    assert page.replace("**", "").split() == ["#", "H", *["one", "two"] * 400] and page.count("one\ntwo") == 400
    assert extract("u", "<main><p>" + "<span>" * 5000 + "word " * 60)["markdown"] == ("word " * 60).strip()
    assert extract("u", "<main>" + "<div>" * 5000 + "<ul><li>a<li>b</ul>" + "word " * 60)["markdown"] == "- a\n- b\n\n" + ("word " * 60).strip()

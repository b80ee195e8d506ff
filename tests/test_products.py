"""Products from odd files, and texts of all facts."""

import json

from folioscope.functions.markdown import page_facts
from folioscope.operators import texts
from folioscope.sources import products
from folioscope.sources.html import read_pages

AUDIT = "# P\n\n**Generated:** 2026-03-04\n\n## Summary\n\n  One.\n\nTwo.\n\n## Recommendations\n\n- **[P1] Do it** — *effort: low*\n- **[P2] No remark**\n- **[P3]  Spaces ** — *a* and *b*\n"
SET = {"probes": [{"id": "1", "expected_source_urls": ["https://d.example/a"]}, {"id": "2"}], "scope_urls": ["https://d.example/a", "https://d.example/s"], "context_strategy": "bundle"}


def lay(root, files):
    for name, value in files.items():
        at = root / "results" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(root / "results")


def test_a_broken_file_takes_only_its_part(spark, tmp_path):
    result = lambda i, **r: {"probe_id": i, "fidelity": 1, "retrieval": r}
    root = lay(tmp_path, {
        "products/a/rollup.json": {"score": 61.5, "scope": "full", "counts": {"fetched": 3}}, "products/a/pages.json": {"counts": {"fetched": 9, "inScope": 4}, "notes": ["n"]}, "products/a/audit.md": AUDIT, "products/a/probes.json": SET, "products/a/rollup-old.json": "{",
        "products/a/probe-results-1.json": {"mode": "web", "run_at": "1", "results": [result("1", tier="none"), result("1", cited_urls=["https://d.example/s"]), result("2", cited_urls=["https://d.example/s"]), result("3", tier="exact")]}, "products/a/probe-results-2.json": "{", "products/a/probe-results-3.json": {"mode": "closed", "results": [result("1", tier="exact")]},
        "products/b/rollup.json": {"score": None}, "products/b/pages.json": "nope", "products/b/probes.json": "{}", "products/b/audit.md": "no headline", "products/c/rollup.json": "{", "products/c/audit.md": AUDIT, "products/d/probes.json": SET, "page/rollup.json": {"score": 1},
    })
    files = products.product_files(spark, root)
    got = {r["product"]: r for r in products.products(files).collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a["score"], a["counts"], a["notes"], a["unread"]) == (61.5, {"fetched": 3, "inScope": 4}, ["n"], ["probe-results-2.json"])
    assert (a["audit"]["generated"], a["audit"]["summary"]) == ("2026-03-04", "One.\n\nTwo.")
    assert [tuple(r) for r in a["audit"]["recommendations"]] == [(1, "Do it", "effort: low"), (3, "Spaces", "a")]
    assert (a["probe_set"]["probe_count"], a["probe_set"]["scope_pages"], a["probe_set"]["context_strategy"], a["probe_set"]["multi_page_probes"]) == (2, 2, "bundle", 0)
    assert (b["score"], b["counts"], b["probe_set"], b["unread"]) == (None, {}, None, ["pages.json"]) and (b["audit"]["generated"], b["audit"]["summary"], b["audit"]["recommendations"]) == (None, None, [])
    runs = {r["file"][-6]: r for r in products.product_runs(files).collect()}
    assert set(runs) == {"1", "3"}
    one = runs["1"]  # the third result's probe has no expected page, so that a page of the scope is in scope; the fourth's is unknown
    assert (one["exact"], one["in_scope"], one["none"], one["judged"], one["exact_rate"], one["in_scope_rate"], one["recomputed"]) == (0, 2, 1, 3, 0.0, 0.67, True)
    assert runs["3"]["judged"] is None and runs["3"]["graded"] == 1


def test_all_facts_as_text(spark):
    code = "```ts\nconst x = MISSING_VALUE;\ny();\nz();\n```\n\n```\n# your key\n```\n\n```py\nopen"
    page = f"# One\n\n### Three\n\nSee [here](https://github.com/a), version v1.2.3, 30 ms, many things.\n\n- a\n\n{code}"
    head = "<title>T</title><script type=\"application/ld+json\">{\"@type\": \"Article\", \"programmingLanguage\": \"Python\", \"keywords\": \"the, api\", \"datePublished\": \"2026\", \"dateModified\": \"2026\"}</script><script type=\"application/ld+json\">{</script>"
    pages = read_pages(spark.createDataFrame([("https://d.example/a", head), ("https://d.example/b.md", page)], "url string, html string"), marks=True)
    got = {r["url"][-1]: r["text"].split("\n") for r in texts.facts_report(page_facts(pages)).collect()}
    assert "- structured data blocks: 2; types: Article; unreadable: 1" in got["a"] and "- published: 2026; modified: 2026; the same: true" in got["a"] and "- keywords: 2; stopwords: the" in got["a"]
    for line in (
        "- programming language: unknown; fences: py 1, ts 1; mismatch: unknown", "- headings: 2; first level: 1; deepest level: 3; level skips: 1", "- blocks: 3; of three lines or more: 1; untagged: 1; unclosed at: 19", "- languages: ts, py",
        "- blocks that need imports: 1; without: 1", "- placeholders: 1; constants without a value: MISSING_VALUE", "- links: 1; internal: 0; external: 1; primary: 1", "- primary hosts: github.com", "- opaque texts: 1", "- versions: v1.2.3", "- vague: many",
    ):
        assert line in got["d"], (line, got["d"])

"""Semantics of operators on small inputs."""

import random

import pytest
import report_oracle
from pyspark.sql import functions as F

from folioscope import catalog
from folioscope.functions.checks import assessments, registry
from folioscope.functions.markdown import page_facts
from folioscope.operators import cost, probes, resampling, retrieval, rollup, stats, store, views
from folioscope.plans.artifacts import ROWS
from folioscope.plans.made import REPORT as MADE
from folioscope.sources import ledger, reports
from folioscope.sources import store as files


REPORT = """# Audit: Getting started

- **URL:** https://docs.example/guide/start
- **Analyzed:** 2026-01-02

## ABC Score: 71.5/100 — Strong

| Dimension | Weight | Score | Weighted |
|---|---|---|---|
""" + "".join(f"| Dimension {'abcdefghi'[i]} | {12 if i == 8 else 11} | {i} | {i * (1.2 if i == 8 else 1.1):.1f} |\n" for i in range(9)) + """| **Total** | **100** | | **40.4** |

## Dimension analysis

1. **Dimension a:** first
   goes on
- **Dimension b** — second
**Dimension c:** third

## Prioritized recommendations

### Tier 1

- **[P1] Say it plainly** — *Maps to: Dimension a*
  - **Where:** top
  - **Issue:** long
    line

## Anti-patterns found

- one
- two
"""

ANSWERS = [
    ("a", "See https://docs.example/guide/start.", ["https://www.docs.example/guide/start/"], ["https://docs.example/guide/start"], ["https://docs.example/guide/next"], "web"),
    ("b", "Read docs.example/guide/start for this", [], ["https://docs.example/guide/start"], ["https://docs.example/guide/next"], "web"),
    ("c", "Read docs.example/guide/start-v2 for this", [], ["https://docs.example/guide/start"], ["https://docs.example/guide/next"], "web"),
    ("d", "It is in docs.example/guide/next", ["https://docs.example/guide/next.md?x=1"], ["https://docs.example/guide/start"], ["https://docs.example/guide/next"], "web"),
    ("e", "Elsewhere: https://other.example/a", ["https://other.example/a"], ["https://docs.example/guide/start"], ["https://docs.example/guide/next"], "web"),
    ("f", "No link", [], ["https://docs.example/guide/start"], ["https://docs.example/guide/next"], "web"),
    ("g", "See https://docs.example/guide/start", [], ["https://docs.example/guide/start"], [], "closed"),
    ("h", None, None, None, None, "web"),
]


def test_facts_hold_no_verdict(spark):
    names = page_facts(spark.createDataFrame([], "url string, format string, head_html string, json_ld array<string>, markdown string")).schema.simpleString().lower()
    assert not any(word in names for word in ("score", "grade", "severity", "verdict", "pass", "fail", "status"))


def test_checks_and_rollup(spark):
    schema = "url string, format string, head_html string, json_ld array<string>, markdown string"
    text = "# A\n\n" + "word " * 120 + "7\n\n[x](https://github.com/a)"
    pages = spark.createDataFrame([("https://d.example/a", "html", None, [], text), ("https://d.example/b", "markdown", None, [], "# A\n\n## B\n\n```\nx\n```"), ("https://d.example/c", None, None, ["{oops"], "")], schema)
    rows = assessments(page_facts(pages)).withColumn("product", F.lit("p")).cache()
    by = {(r["url"][-1], r["check"]): r["verdict"] for r in rows.collect()}
    assert by["a", "jsonld-valid"] == "warn" and by["b", "jsonld-valid"] is None and by["c", "jsonld-valid"] == "fail"
    assert by["b", "code-fence-validity"] == "warn" and by["a", "prose-specifics"] == "pass" and by["b", "prose-specifics"] is None
    assert by["a", "external-citations"] == "pass" and by["c", "heading-structure"] is None
    rolled = rollup.rollup_checks(rows, ["product"]).cache()
    for r in rolled.collect():
        assert r["evaluated"] + r["not_applicable"] == 3
    points = {r["check"]: r["points"] for r in rolled.collect()}
    assert points["jsonld-valid"] == 0.25 and points["code-runnability"] is None
    weights = {c.id: c.weight for c in registry()}
    own = {c: p for c, p in points.items() if p is not None}
    want = sum(weights[c] * p for c, p in own.items()) / sum(weights[c] for c in own) * 100
    assert rollup.product_scores(rolled, ["product"]).first()["score"] == pytest.approx(want, abs=0.051)
    fixes = rollup.potential_fixes(rolled, ["product"]).collect()
    assert all(f["recoverable"] > 0 for f in fixes) and "prose-specifics" not in {f["check"] for f in fixes}


def test_probe_summary(spark):
    schema = "run string, fidelity int, refusal boolean, error string, subject_identified boolean, hit boolean, via string, search_degraded boolean, live_search_failed boolean, accuracy int, hallucination_free int, relevance int, structure int"
    rows = [("r", 80, False, None, None, True, "citation", False, False, 8, 8, 8, 8), ("r", 40, False, None, True, False, None, True, False, 4, 4, 4, 4), ("r", 60, False, None, True, True, "mention", False, False, 6, 6, 6, 6), ("r", None, True, None, None, False, None, False, False, None, None, None, None), ("c", 50, False, None, False, None, None, None, None, 5, 5, 5, 5)]
    found = {r["run"]: r for r in probes.summarize(spark.createDataFrame(rows, schema), ["run"]).collect()}
    r = found["r"]
    assert (r["graded_count"], r["refusal_count"], r["avg_fidelity"], r["hit_rate"], r["effective_hit_rate"], r["mention_hits"], r["inconclusive_count"]) == (3, 1, 60.0, 0.5, 0.67, 1, 1)
    c = found["c"]
    assert c["hit_rate"] is None and c["effective_hit_rate"] is None and c["avg_fidelity"] is None and c["avg_fidelity_all"] == 50.0 and c["unattributed_count"] == 1


def test_latest_artifacts_keep_what_later_runs_lack(spark):
    rows = [("p", "2026-01-01", "r1", 70, "web", 55), ("p", "2026-01-02", "r2", 80, None, None)]
    found = store.latest_artifacts(spark.createDataFrame(rows, "page string, at string, run_id string, score int, mode string, fidelity int"), ["page"], ["at"]).first()
    assert (found["score"], found["audit_run"], found["fidelity"], found["run_web"], found["mode"], found["band"]) == (80, "r2", 55, "r1", "web", "strong")


def test_trend(spark):
    schema = "run_id string, at string, target_type string, target_name string, status string, grader_model string, probe_effort string, score double, fidelity double"
    rows = [("1", "a", "product", "x", "complete", "g", "low", 50.0, None), ("2", "b", "product", "y", "complete", "g", "low", 10.0, None), ("3", "c", "product", "x", "complete", "g", "low", 60.0, None), ("4", "d", "product", "x", "complete", "h", "low", 70.0, None), ("5", "e", "product", "x", "complete", None, None, 75.0, None), ("6", "f", "product", "x", "partial", "h", "low", 99.0, None)]
    whole = spark.createDataFrame(rows, schema).selectExpr("*", "'m' AS probe_model", "'web' AS mode", "'sha' AS grader_prompt_sha")
    points = store.trend_points(whole).cache()
    assert points.count() == 5 and points.where("run_id = '1'").first()["fingerprint"] == "g|m|low|web|sha"
    segments = {r["run_id"]: (r["target"], r["segment"]) for r in store.trend_segments(points).collect()}
    assert segments["1"] == segments["3"] and len({segments[i] for i in "1345"}) == 3 and segments["2"][0] == "product:y"
    assert sorted((r["run_id"], r["reason"]) for r in store.discontinuities(points).collect()) == [("4", "grader changed"), ("5", "protocol unknown")]
    delta = {r["target"]: r["delta"] for r in store.trend_delta(points.where("run_id <> '5' and run_id <> '4'")).collect()}
    assert delta == {"product:x": 10.0, "product:y": None}
    again = store.append_points(points, points.where("run_id = '1'").withColumn("score", F.lit(51.0)))
    assert again.count() == 5 and again.where("run_id = '1'").first()["score"] == 51.0


def test_points_of_other_prompts_or_models_are_not_joined(spark):
    rows = [("1", "a", "g", "m", "p"), ("2", "b", "g", "m", "q"), ("3", "c", "g", "n", "q"), ("4", "d", "g", "n", None), ("5", "e", "g", "n", "q"), ("6", "f", "g", "n", "q")]
    points = store.trend_points(spark.createDataFrame(rows, "run_id string, at string, grader_model string, probe_model string, grader_prompt_sha string").selectExpr("*", "'product' AS target_type", "'x' AS target_name", "'complete' AS status", "'low' AS probe_effort", "'web' AS mode", "1D AS score", "1D AS fidelity"))
    assert [r["segment"] for r in store.trend_segments(points).orderBy("at").collect()] == [1, 2, 3, 4, 5, 5]
    assert [r["reason"] for r in store.discontinuities(points).orderBy("at").collect()] == ["grader prompt changed", "probe model changed", "protocol unknown", "protocol unknown"]


def test_a_shared_key_fails_with_the_names(spark):
    df = spark.createDataFrame([("k", "a"), ("k", "b"), ("j", "c"), ("j", "c")], "key string, value string")
    assert views.require_unique(df.where("key = 'j'"), "key", "value").count() == 2
    with pytest.raises(Exception, match="key k is shared by 2: a, b"):
        views.require_unique(df, "key", "value").collect()


def test_reusable_artifacts(spark):
    held = spark.createDataFrame([("p", "h", "g", 1, 1, True), ("p", "h", "g", 2, 3, True), ("p", "h", "g", 3, 2, False), ("p", "x", "g", 1, 4, True), ("p", None, "g", 1, 5, True)], "page_key string, content_hash string, grader string, at int, run_id int, complete boolean")
    asked = spark.createDataFrame([("p", "h", "g", 1, 10), ("p", "h", "g", 2, 11), ("p", "h", "g", 9, 12), ("p", None, "g", 9, 13), ("q", "h", "g", 9, 14)], "page_key string, content_hash string, grader string, at int, run_id int")
    assert {r["run_id"]: r["reused_run"] for r in store.reusable(asked, held, ["grader"]).collect()} == {10: None, 11: 1, 12: 3, 13: None, 14: None}


def test_transitions_and_reconcile(spark):
    events = spark.createDataFrame([("a", 1, "queued"), ("a", 2, "running"), ("a", 3, "complete"), ("a", 4, "running"), ("b", 1, "interrupted"), ("b", 2, "running"), ("c", 1, "odd"), ("c", 2, "running")], "run_id string, ord int, status string")
    assert sorted((r["run_id"], r["ord"]) for r in store.illegal_transitions(events).collect()) == [("a", 4), ("c", 2)]
    runs = spark.createDataFrame([("1", "h", 1, "running"), ("2", "h", 2, "running"), ("3", "z", 1, "running"), ("4", "h", 9, "complete")], "run_id string, host string, pid int, status string")
    alive = spark.createDataFrame([("h", 1, True), ("h", 2, False)], "host string, pid int, alive boolean")
    assert {r["run_id"]: r["status"] for r in store.reconcile(runs, alive).collect()} == {"1": "running", "2": "interrupted", "3": "running", "4": "complete"}


def test_cost(spark):
    schema = "label string, model string, input_tokens long, output_tokens long, cache_read long, cache_write long, cache_write_1h long, service_tier string"
    million = 1_000_000
    rows = [("a", "large-20260101", million, 0, 0, 0, 0, None), ("a", "large", 0, 0, million, 0, 0, None), ("b", "large", 0, 0, 0, million, 0, None), ("b", "large", 0, 0, 0, million, million, "batch"), ("c", "none", 1, 1, 0, 0, 0, None)]
    prices = spark.createDataFrame([("large", 5.0, 25.0)], cost.PRICES)
    priced = cost.priced(spark.createDataFrame(rows, schema), prices).cache()
    assert sorted(r["cost"] for r in priced.collect() if r["cost"] is not None) == pytest.approx([0.5, 5.0, 5.0, 6.25])
    found = {r["label"]: r["cost"] for r in cost.tally(priced).collect()}
    assert found["a"] == 5.5 and found["c"] is None and found["(all)"] is None


def test_statistics(spark):
    rows = spark.createDataFrame([("g", 1.0, 1.0), ("g", 2.0, 2.0), ("g", 2.0, 3.0), ("g", 3.0, 4.0), ("h", 1.0, 1.0)], "k string, x double, y double")
    ranks = sorted(r["r"] for r in resampling.with_mid_ranks(rows.where("k = 'g'"), ["k"], {"r": "x"}).collect())
    assert ranks == [1.0, 2.5, 2.5, 4.0]
    assert {r["k"]: r["rho"] for r in stats.spearman(rows, "x", "y", ["k"]).collect()} == {"g": 0.949, "h": None}


def test_views(spark):
    rows = spark.createDataFrame([(1, "Alpha", 3), (2, None, None), (3, "beta", 1), (4, "ALPS", 2)], "id int, name string, score int")
    assert [r["id"] for r in views.search(rows, "alp", ["name"]).orderBy("id").collect()] == [1, 4]
    for ascending in (True, False):
        assert [r["id"] for r in rows.orderBy(views.order("score", ascending)).collect()][-1] == 2
    assert [r["id"] for r in views.page_of(rows, [F.asc("id")], 2, 3).collect()] == [4]
    pages = spark.createDataFrame([("s", 1, 5, 60), ("s", 2, 6, 50), ("s", 3, 7, 30), ("s", 4, 8, 10)], "k string, id int, size int, cost long")
    assert {r["id"]: r["used"] for r in views.budget_fill(pages, ["k"], "size", "cost", ["id"], 100).collect()} == {1: True, 2: False, 3: True, 4: True}
    assert rows.select(views.recoverable(F.lit(12), F.col("score"))).collect()[0][0] == 8.4


def test_ledger(spark):
    one = lambda *urls: spark.createDataFrame([(u,) for u in urls], "url string")
    found = {r["url"]: (r["source"], r["included"], r["reason"]) for r in ledger.ledger(one("a", "b"), one("b", "c"), "full").collect()}
    assert found == {"a": ("llms.txt", False, "not-in-sitemap"), "b": ("both", True, None), "c": ("sitemap", True, None)}
    index = spark.createDataFrame([("[a](https://d.example/feeds/a) [b](https://d.example/feedsx/b) [c](https://d.example/feeds/a/#x)", "https://d.example/feeds/llms.txt")], "text string, base string")
    assert [r["url"] for r in ledger.curated_pages(index, "https://d.example/feeds/").collect()] == ["https://d.example/feeds/a"]
    maps = spark.createDataFrame([("https://d.example/sitemap-index.xml", "<loc>https://d.example/s.xml</loc>"), ("https://d.example/s.xml", "<loc> https://d.example/feeds/x/ </loc>")], "location string, text string")
    assert [r["url"] for r in ledger.sitemap_pages(maps, "https://d.example/feeds").collect()] == ["https://d.example/feeds/x"]
    hashes = lambda *rows: spark.createDataFrame(rows, "url string, content_hash string")
    changed = {r["url"]: r["changed"] for r in ledger.changed_since(hashes(("a", "1"), ("b", None), ("c", "2"), ("d", "4")), hashes(("a", "1"), ("b", None), ("c", "3"))).collect()}
    assert changed == {"a": False, "b": True, "c": True, "d": True}
    assert ledger.target("product:a:b") == ("product", "a:b") and ledger.target("https://x.example/") == ("page", "https://x.example/")
    with pytest.raises(ValueError):
        ledger.target("nothing")


def test_watchlist(spark, tmp_path):
    write = lambda name, pages, version=1: (tmp_path / name).write_text(f'{{"version": {version}, "name": "{name}", "pages": {pages}}}')
    write("good.json", '["https://d.example/a", "https://d.example/b"]')
    assert ledger.watchlist(spark, str(tmp_path / "good.json"), "https://d.example").count() == 2
    for name, pages, version in (("v.json", '["https://d.example/a"]', 2), ("d.json", '["https://d.example/a", "https://d.example/a/"]', 1), ("o.json", '["https://e.example/a"]', 1)):
        write(name, pages, version)
        with pytest.raises(Exception, match="version|duplicate|origin"):
            ledger.watchlist(spark, str(tmp_path / name), "https://d.example").collect()


def test_store_files(spark, tmp_path):
    for run in ("r1", "r2"):
        folder = tmp_path / "runs" / run / "pages" / "p"
        folder.mkdir(parents=True)
        (tmp_path / "runs" / run / "manifest.json").write_text(f'{{"runId": "{run}", "status": "complete"}}' if run == "r1" else f'{{"runId": "{run}", "cost": 1.5}}')
        (folder / "audit.md").write_text("x")
        (folder / "audit-b-old.md").write_text("y")
    (tmp_path / "runs" / "r3").mkdir()
    (tmp_path / "runs" / "r3" / "manifest.json").write_text("{oops")
    assert [r["runId"] for r in files.read_manifests(spark, str(tmp_path)).collect()] == ["r2", "r1"]
    pages = files.page_files(spark, str(tmp_path))
    assert pages.count() == 2 and files.preferred_audit(pages).count() == 2
    new = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, v int")
    path = str(tmp_path / "table")
    assert files.append_runs(new, path).count() == 2 and files.append_runs(new, path).count() == 0
    assert spark.read.parquet(path).count() == 2
    files.write_csv(spark.createDataFrame([(1, 'a"b'), (2, None)], "id int, t string"), str(tmp_path / "csv"), ["id"])
    lines = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert lines == b'id,t\r\n1,"a""b"\r\n2,\r\n'


def test_report_variants(spark):
    texts = {"good": REPORT, "total": REPORT.replace("| **Total**", "| Sum"), "weights": REPORT.replace("| Dimension a | 11", "| Dimension a | 12"), "score": REPORT.replace("## ABC Score", "## Marks"), "short": REPORT.replace("| Dimension c | 11 | 2 | 2.2 |\n", ""), "none": None}
    got = {r["id"]: r for r in reports.parse_reports(spark.createDataFrame(list(texts.items()), "id string, text string"), ["id"]).collect()}
    good = got["good"]
    assert good["score"] == 71.5 and good["band"] == "Strong" and [d["analysis"] for d in good["dimensions"]][:3] == ["first goes on", "second", "third"]
    assert good["recommendations"][0]["issue"] == "long line" and good["recommendations"][0]["tier"] == "Tier 1" and good["anti_patterns"] == ["one", "two"]
    assert {k: r["error"] for k, r in got.items()} == {"good": None, "total": "no Total row", "weights": "weights sum to 101", "score": "no score line", "short": "8 dimension rows, not 9", "none": "no title"}
    assert got["short"]["title"] is None and got["short"]["dimensions"] is None


def test_reports_equal_a_reading_by_lines(spark, sf_dir):
    rng = random.Random(1)
    more = ["  - **Why:** because\n    of this", "  - **Change:** x\n\n    y", "### Tier 9", "- **[P4] T** — *Maps to: Z*", "- **[P5] bad** tail", "- loose", "", "**Dimension d:** more", "- **dimension**: short", "2) **Dimension b** : other", "text", "## Off-page notes", "- n1\n  n2", "| x | 1 | 2/10 | 3 |", "## Probe-informed diagnosis\n\n**ABC score vs probe fidelity:** off by 3", "**URL:** u2"]
    base = [REPORT, f"```markdown\n{REPORT}\n```\n", *[r[0] for r in spark.read.parquet(f"{sf_dir}/orders.parquet").limit(40).select(F.expr(MADE.replace("{rows}", ROWS))).collect()]]
    texts = list(base)
    for _ in range(300):
        lines = rng.choice(base).split("\n")
        for _ in range(rng.randint(1, 5)):
            at = rng.randrange(len(lines))
            lines[at : at + (rng.random() < 0.4)] = rng.choice(more).split("\n") if rng.random() < 0.6 else []
        texts.append("\n".join(lines))
    got = {r["i"]: r.asDict(True) for r in reports.parse_reports(spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4), ["i"]).collect()}
    for i, text in enumerate(texts):
        try:
            want = report_oracle.parse(text) | {"error": None}
        except ValueError as error:
            want = dict.fromkeys(report_oracle.FIELDS) | {"error": str(error)}
        assert got[i] == want | {"i": i}, text


def test_tiers_of_answers(spark):
    rows = spark.createDataFrame(ANSWERS, "id string, answer string, cited_urls array<string>, expected_urls array<string>, scope_urls array<string>, mode string")
    want = {"a": (True, "citation", "exact"), "b": (True, "mention", "exact"), "c": (False, None, "none"), "d": (False, None, "in-scope"), "e": (False, None, "out-of-scope"), "f": (False, None, "none"), "g": (None, None, None), "h": (False, None, None)}
    assert {r["id"]: (r["hit"], r["via"], r["tier"]) for r in retrieval.verdicts(rows).collect()} == want


def test_parts_of_a_protocol_may_hold_bars(spark):
    schema = "run_id int, at string, status string, target_type string, target_name string, score int, fidelity int, grader_model string, probe_model string, probe_effort string, mode string, grader_prompt_sha string"
    rows = [(i, str(i), "complete", "page", "p", 1, 1, g, m, "low", "web", "s") for i, (g, m) in enumerate([("g|a", "x"), ("g|b", "x"), ("g", "a|x"), ("g%7Ca", "x")])]
    points = store.trend_points(spark.createDataFrame(rows, schema))
    assert points.select("fingerprint").distinct().count() == 4
    got = [r["reason"] for r in store.discontinuities(points).orderBy("at").collect()]
    assert got == ["grader changed", "grader changed, probe model changed", "grader changed, probe model changed"]


def test_shares_and_places_of_groups(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("A",), ("z",)], "g string")
    assert {r["g"]: r["share"] for r in views.shares(rows, "g").collect()} == {"a": 0.1667, "b": 0.3333, None: 0.1667, "A": 0.1667, "z": 0.1667}
    got = [(r["group"], r["size"]) for r in views.groups(rows, F.col("g"), ["z"]).orderBy("place").collect()]
    assert got == [("z", 1), ("b", 2), ("A", 1), ("a", 1), ("(none)", 1)]


def test_long_parts_of_reports(spark):
    """A field and an entry of 20,000 lines are read whole; at one recursion a line they overflowed the stack."""
    table = "".join(f"| D{i} | {12 if i == 8 else 11} | 5/10 | 1.0 |\n" for i in range(9))
    below = "\n".join(f"    x{i}" for i in range(20_000))
    text = f"# Audit: T\n## ABC Score: 5/100 — B\n{table}| **Total** | 100 | | 9.5 |\n## Dimension analysis\n- **D1:** a\n{below}\n## Prioritized recommendations\n### Tier 1\n- **[P1] A**\n  - **Where:** b\n{below}\n"
    found = reports.parse_reports(spark.createDataFrame([(1, text)], "i int, text string"), ["i"]).first()
    rest = " ".join(f"x{i}" for i in range(20_000))
    assert found["error"] is None
    assert found["dimensions"][1]["analysis"] == f"a {rest}" and found["recommendations"][0]["where"] == f"b {rest}"


def test_resume_states(spark):
    """Those of `resume_plan`, by one aggregate: no join, and null keys meet nothing."""
    rows = spark.createDataFrame([(1, "a", 1, 2, None), (1, "a", 1, 3, None), (1, "a", 2, 2, "late"), (1, "b", 1, 3, None), (2, "b", 1, None, None), (2, "b", 2, 4, None), (2, None, 2, 4, None), (3, "b", None, 4, None)], "page_key int, mode string, probe_id int, run_id int, error string")
    key = ["page_key", "mode"]
    found = probes.resume_states(rows, key, F.expr("run_id % 2 = 0"))
    assert sorted(map(str, found.collect())) == sorted(map(str, probes.resume_plan(rows.select(*key, "probe_id").distinct(), rows.where("run_id % 2 = 0"), key).collect()))
    plan = catalog.queries()["resume_plan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan

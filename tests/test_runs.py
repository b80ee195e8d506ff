"""Run history, texts and projections on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions.markdown import page_facts
from folioscope.operators import probes, retrieval, runs, store, texts
from folioscope.sources import store as files
from folioscope.sources.html import extract, read_pages


def test_harness_defaults_leave_counters_null(spark):
    rows = spark.createDataFrame([(None, None, None)], "retries int, search_degraded boolean, searches_attempted int")
    assert tuple(runs.normal_harness(rows).select("retries", "search_degraded", "searches_attempted").first()) == (0, False, None)


def test_stored_verdicts_stand_before_recomputed_ones(spark):
    schema = "id int, prompt string, via string, hit boolean, new_hit boolean, new_via string"
    rows = spark.createDataFrame([(1, "p", "mention", True, False, None), (2, "p", None, False, True, "citation"), (3, "old", None, True, False, None)], schema)
    found = runs.normal_retrieval(rows, spark.createDataFrame([(1, "p"), (2, "p"), (3, "new")], "id int, prompt string"), ["id"])
    assert {r["id"]: (r["via"], r["hit"], r["origin"]) for r in found.collect()} == {1: ("mention", True, "stored"), 2: ("citation", True, "recomputed"), 3: (None, True, "grader")}


def test_current_and_primary_runs(spark):
    results = spark.createDataFrame([("p", "r1", 1, "a"), ("p", "r1", 2, "b"), ("p", "r2", 1, "a"), ("p", "r2", 2, "x")], "page string, run_id string, probe_id int, prompt string")
    now = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b")], "page string, probe_id int, prompt string")
    assert {r["run_id"]: r["current"] for r in runs.current_runs(results, now, ["run_id"], ["page"]).collect()} == {"r1": True, "r2": False}
    all_ = spark.createDataFrame([("p", "r1", "web", "1", True), ("p", "r2", "closed", "2", True), ("p", "r3", "web", "3", False), ("q", "r4", "web", "4", False)], "page string, run_id string, mode string, at string, current boolean")
    assert [(r["page"], r["run_id"]) for r in runs.primary_runs(all_, ["page"]).collect()] == [("p", "r1")]


def test_formats(spark):
    row = spark.range(1).select(runs.duration_text(F.lit(59_000)), runs.duration_text(F.lit(61_000)), runs.duration_text(F.lit(7_260_000)), runs.money_text(F.lit(1.5)), runs.money_text(F.lit(None).cast("double")), runs.day(F.lit("2026-01-02T23:00:00Z")), runs.day(F.lit("soon")), runs.same_page(F.lit("https://www.a.example/x/"), F.lit("a.example/x.md")), runs.same_page(F.lit(""), F.lit("")), runs.remaining_seconds(F.lit(0), F.lit(5), F.lit(10.0), 2), runs.remaining_seconds(F.lit(1), F.lit(6), F.lit(1000.0), 3)).first()
    assert tuple(row) == ("59s", "1m 1s", "2h 1m", "$1.50", "unpriced", "2026-01-02", "(none)", True, False, None, 2.0)
    with pytest.raises(ValueError):
        runs.over_ceiling(F.lit(1.0), 0)


def test_usage_is_stripped(spark):
    rows = spark.createDataFrame([("r", [("p", (1, 2))])], "run_id string, results array<struct<probe:string,usage:struct<a:int,b:int>>>")
    assert runs.without_usage(rows).schema["results"].dataType.elementType.names == ["probe"]


def test_search_flags(spark):
    rows = spark.createDataFrame([(1, ["unavailable"]), (2, ["unavailable", "bad"]), (3, [])], "id int, search_errors array<string>")
    assert {r["id"]: (r["n_errors"], r["retryable"]) for r in runs.search_flags(rows).collect()} == {1: (1, True), 2: (2, False), 3: (0, False)}


def test_probe_set_ids_ignore_order(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("b", 2, "y"), ("b", 1, "x"), ("c", 1, "z")]
    found = {r["k"]: r["probe_set_id"] for r in texts.probe_set_ids(spark.createDataFrame(rows, "k string, id int, prompt string"), "k", ["prompt", "id"]).collect()}
    assert found["a"] == found["b"] != found["c"] and len(found["a"]) == 12


def test_page_and_fact_texts(spark):
    pages = read_pages(spark.createDataFrame([("https://d.example/a", "<title>T</title><p>hello"), ("https://d.example/b.md", "# B\n\ntext"), ("https://d.example/c", None)], "url string, html string"))
    found = {r["url"][-4:]: r["text"] for r in texts.page_text(pages).collect()}
    assert "# T" in found["le/a"] and "hello" in found["le/a"] and "## Structured data" not in found["le/a"] and "# B" in found["b.md"]
    facts = texts.facts_text(page_facts(pages)).collect()
    assert all(len(r["text"]) < 4000 and "canonical: unknown" in r["text"] for r in facts)


def test_projections_hold_allowed_columns_only(spark, tmp_path):
    table = spark.createDataFrame([("a", 1.0, "secret")], "page_key string, score double, body string")
    texts.write_projections({"index": (table, ["page_key", "score"])}, str(tmp_path))
    lines = [json.loads(line) for p in (tmp_path / "index").glob("part-*") for line in p.read_text().splitlines()]
    assert lines == [{"page_key": "a", "score": 1.0}] and runs.row_bytes(table.drop("body")).first()[0] < 500
    assert [r["page_key"] for r in store.page_index(spark.createDataFrame([("a", 5.0), ("b", None), ("c", 1.0)], "page_key string, score double"), ["page_key", "score"]).collect()] == ["b", "c", "a"]


def test_batches_and_regrades(spark):
    sent = spark.createDataFrame([(1,), (2,), (3,)], "custom_id int")
    back = spark.createDataFrame([(1, "x", None), (2, None, "overloaded")], "custom_id int, body string, error string")
    assert {r["custom_id"]: r["error"] for r in probes.batch_results(sent, back).collect()} == {1: None, 2: "overloaded", 3: "missing from the batch"}
    old = spark.createDataFrame([("k", 1, 50), ("k", 2, None)], "k string, probe_id int, fidelity int")
    new = spark.createDataFrame([("k", 1, 60), ("k", 2, 70)], "k string, probe_id int, fidelity int")
    assert tuple(probes.regrade_means(old, new, ["k"]).first()) == ("k", 1, 50.0, 60.0, 10.0)


def test_closed_mode_has_no_verdict(spark):
    rows = spark.createDataFrame([("x https://a.example/p", None, ["https://a.example/p"], ["https://a.example/q"], "closed")], "answer string, cited_urls array<string>, expected_urls array<string>, scope_urls array<string>, mode string")
    r = retrieval.verdicts(rows).first()
    assert r["hit"] is None and r["via"] is None and r["tier"] is None


def test_wrapped_probe_sets(spark):
    rows = spark.createDataFrame([("a", '{"probes": [1]}'), ("b", '{"probes": {"probes": [1]}}')], "probe_set_id string, body string")
    assert {r["probe_set_id"]: r["probes"] for r in files.unwrapped_probes(rows).collect()} == {"a": "[1]", "b": "[1]"}


def test_facts_of_random_texts(spark):
    rng = random.Random(4)
    texts_ = ["".join(rng.choices("`~# \nab1.[](/<p>-|", k=rng.randrange(120))) for _ in range(300)]
    pages = spark.createDataFrame([("https://x.example/", None, None, None, t) for t in texts_], "url string, format string, head_html string, json_ld array<string>, markdown string")
    for row in page_facts(pages).collect():
        s, c = row["structure"], row["code"]
        assert s["sectionCount"] == s["headingCount"] and s["codeFences"] == c["codeBlocks"] and len(s["unclosedFences"]) <= 1 and s["medianSectionWords"] <= s["maxSectionWords"]
    assert all(isinstance(extract("https://x.example/", t)["markdown"], str) for t in texts_)

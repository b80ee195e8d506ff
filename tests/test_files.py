"""Stores, results folders, watchlists, published versions and progress: odd files, failures, late events."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioscope.plans.made import REPORT
from folioscope.plans.artifacts import ROWS
from folioscope.sources import artifacts, publish, watchlists
from folioscope.streaming import progress


def report(spark, score):
    """A report that keeps all rules; the tens digit and 'k % 10 = 1' make it whole."""
    return spark.range(1).select(F.expr(REPORT.replace("{rows}", ROWS).replace("o_orderkey", f"({score}L)").replace("o_custkey", "3L"))).first()[0]


def lay(root, files):
    for name, text in files.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def run(mode, at, probes, **more):
    return json.dumps({"mode": mode, "model_tested": "m", "run_at": at, "results": [{"probe_id": i, "prompt": p, "fidelity": 1} for i, p in probes]} | more)


SET = [("a", "x"), ("b", "y")]


def test_store_pages_survive_bad_files(spark, tmp_path):
    probes = json.dumps({"probes": [{"id": i, "prompt": p} for i, p in SET]})
    lay(tmp_path, {
        "runs/r1/pages/p+1 x/audit.md": report(spark, 61), "runs/r1/pages/p+1 x/audit-old.md": "old", "runs/r1/pages/p+1 x/probe-results-web.json": "{", "runs/r1/pages/p+1 x/probe-results-m-closed.json": run("closed", "2", SET), "runs/r1/pages/p+1 x/probes.json": probes,
        "runs/r1/pages/p2/audit.md": "# nothing", "runs/r1/pages/p2/probe-results-web.json": run("web", "1", []), "runs/r1/pages/p2/probes.json": "[]", "runs/r2/pages/p2/stage-state.json": "{}", "runs/r2/pages/p2/probe-results-web-old.json": run("web", "1", SET),
        "runs/r1/manifest.json": "{}", "index.json": "{}",
    })
    got = {(r["run_id"], r["page_key"]): r for r in artifacts.store_pages(artifacts.store_files(spark, str(tmp_path))).collect()}
    assert set(got) == {("r1", "p+1 x"), ("r1", "p2"), ("r2", "p2")}
    whole = got["r1", "p+1 x"]
    assert (whole["score"], [r["file"] for r in whole["runs"]], whole["probe_count"]) == (61.5, ["probe-results-m-closed.json"], 2)
    assert (got["r1", "p2"]["score"], len(got["r1", "p2"]["runs"]), got["r1", "p2"]["probe_count"]) == (None, 1, 0)
    assert (got["r2", "p2"]["score"], got["r2", "p2"]["runs"]) == (None, [])


def test_collected_pages_and_their_primary_runs(spark, tmp_path):
    ident = spark.range(1).select(artifacts.probe_set_id(F.array(*[F.struct(F.lit(i).alias("id"), F.lit(p).alias("prompt")) for i, p in SET]))).first()[0]
    probes = json.dumps({"probes": [{"prompt": p, "id": i, "archetype": "z"} for i, p in reversed(SET)]})  # neither order nor other fields count
    lay(tmp_path / "results", {
        "a/audit.md": report(spark, 61), "a/audit-probe-informed.md": report(spark, 42), "a/audit-second.md": "no report", "a/probes.json": probes, "a/probe-results-1.json": run("web", "2026-01-01", SET, probe_set_id=ident),
        "a/probe-results-2.json": run("closed", "2026-01-02", SET), "a/probe-results-3.json": run("web", "2026-01-03", [("a", "older")]), "a/probe-results-4.json": run("web", "2026-01-04", SET, probe_set_id="stale"),
        "b/audit-z.md": report(spark, 11), "b/audit-y.md": report(spark, 12), "b/probe-results-1.json": run("web", "1", SET), "c/probes.json": probes, "d/audit.md": "# short", "d/probes.json": probes, "d/probe-results-1.json": run("closed", "1", SET),
        "products/x/audit.md": report(spark, 13), "readme.md": "x",
    })
    got = {r["page_key"]: r for r in artifacts.primary_run(artifacts.collected_pages(artifacts.result_files(spark, str(tmp_path / "results") + "/"))).collect()}
    assert set(got) == {"a", "b", "d"}
    a = got["a"]
    assert (a["audit_file"], a["score"], a["rescored_from"], a["variants"]) == ("audit-probe-informed.md", 42.5, 61.5, 3)
    assert [(r["file"][14], r["current"]) for r in a["runs"]] == [("4", False), ("3", False), ("2", True), ("1", True)]
    assert a["primary_run_index"] == 3 and a["primary_run"]["run_at"] == "2026-01-01"  # a search counts before what is newer
    assert (got["b"]["audit_file"], got["b"]["primary_run_index"], got["b"]["primary_run"]) == ("audit-y.md", -1, None)  # no set: no run is current
    assert (got["d"]["score"], got["d"]["error"] is None, got["d"]["primary_run_index"]) == (None, False, 0)


def test_runs_are_judged_anew_only_where_they_are_old(spark, tmp_path):
    result = lambda i, prompt, r, **more: {"probe_id": i, "prompt": prompt, "fidelity": 5, "retrieval": r} | more
    probes = {"probes": [{"id": "a", "prompt": "x", "expected_source_urls": ["https://d.example/p"]}, {"id": "b", "prompt": "y"}]}
    hit = {"cited_urls": ["https://www.d.example/p/"], "hit_expected_source": False}
    web = [result("a", "x", hit), result("a", "older", hit), result("a", "x", hit | {"via": None}), result("b", "y", {"hit_expected_source": True}), result("c", "z", {}), result("a", "x", None, answer="see d.example/p", harness={"search_degraded": True})]
    lay(tmp_path / "results", {
        "p/probes.json": json.dumps(probes), "p/probe-results-1.json": json.dumps({"mode": "web", "results": web, "retrieval_hit_rate_effective": None, "avg_fidelity": 44.5}), "p/probe-results-2.json": json.dumps({"mode": "closed", "results": web[:1]}), "p/probe-results-3.json": "{", "p/probe-results-4.json": "[1]", "p/probe-results-5.json": "{}",
    })
    files = artifacts.result_files(spark, str(tmp_path / "results"))
    got = [(r["hit"], r["via"], r["recomputed"]) for r in artifacts.normal_probes(files, ["page_key"]).where("file like '%1.json'").orderBy("ord").collect()]
    assert got == [(True, "citation", True), (False, None, False), (False, None, False), (False, None, True), (False, None, False), (True, "mention", True)]
    runs = {r["file"][14]: r for r in artifacts.normal_runs(files, ["page_key"]).collect()}
    assert set(runs) == {"1", "2", "5"}
    assert (runs["1"]["hit_rate"], runs["1"]["hit_rate_effective"], runs["1"]["hit_corrections"], runs["1"]["avg_fidelity"], runs["1"]["degraded"]) == (0.33, 0.33, 3, 44.5, None)
    assert (runs["2"]["hit_rate"], runs["2"]["hit_rate_effective"], runs["2"]["avg_fidelity"], runs["5"]["probe_count"], runs["5"]["avg_fidelity"]) == (None, None, 5.0, 0, None)


def test_shared_values_are_held_once(spark):
    rows = spark.createDataFrame([(1, ("a", [1])), (2, None), (3, ("b", [])), (4, ("a", [1])), (5, (None, [1]))], "k int, v struct<n: string, xs: array<int>>")
    refs, table = artifacts.shared(rows, "v", "index")
    assert table.count() == 3 and sorted(r["v_index"] for r in table.collect()) == [0, 1, 2]
    again = refs.join(table, "v_index", "left").select("k", "v")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, rows.collect()))


def test_a_failed_version_leaves_the_one_before(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        publish.snapshot(spark, path)
    good = spark.createDataFrame([(1, "a", "hidden")], "k int, v string, secret string")
    assert publish.publish({"index": (good, ["k", "v"]), "more": (good, ["k"])}, path) == 1
    bad = good.withColumn("v", F.when(F.col("k") > 0, F.raise_error(F.lit("stop"))).otherwise("x"))
    with pytest.raises(Exception, match="stop"):
        publish.publish({"more": (good.withColumn("k", F.lit(9)), ["k"]), "index": (bad, ["k", "v"])}, path)
    read = publish.snapshot(spark, path)
    assert read("index").collect() == [(1, "a")] and read("more").collect() == [(1,)]  # the new table of the failed version isn't seen
    with pytest.raises(KeyError):
        read("secret")
    assert publish.publish({"index": (good.withColumn("k", F.lit(2)), ["k"])}, path) == 2
    assert read("index").collect() == [(1, "a")] and publish.snapshot(spark, path)("index").columns == ["k"]


def test_every_problem_of_a_watchlist_is_a_row(spark):
    page = "https://docs.example/a"
    lists = {
        "ok": {"version": 1, "name": "ok", "description": "d", "pages": [page, "https://docs.example/b?x=1", "https://docs.example"]},
        "many": {"version": 2, "pages": [page, page, "https://other.example/a", "http://docs.example/a", 7, None, "no", "https://", "HTTPS://docs.example:443/a", {"url": page}]}, "empty": {"version": 1, "name": "", "pages": []},
        "kinds": {"version": "1", "name": 5, "pages": "x"}, "none": {}, "list": [1], "null": None,
    }
    texts = spark.createDataFrame([(k, json.dumps(v)) for k, v in lists.items()] + [("broken", "{"), ("void", None)], "file string, text string")
    got = {}
    for r in watchlists.watchlist_problems(texts, "https://docs.example/start").collect():
        got.setdefault(r["file"], []).append((r["problem"], r["position"]))
    assert sorted(got.pop("many"), key=repr) == sorted([("version", None), ("name", None), ("duplicate", 1), ("off-origin", 2), ("off-origin", 3), ("not-text", 4), ("not-text", 5), ("not-an-address", 6), ("not-an-address", 7), ("duplicate", 8), ("not-text", 9)], key=repr)
    assert got == {
        "empty": [("name", None), ("pages", None)], "kinds": [("version", None), ("name", None), ("pages", None)], "none": [("version", None), ("name", None), ("pages", None)],
        "list": [("not-an-object", None)], "null": [("not-an-object", None)], "broken": [("not-json", None)], "void": [("not-json", None)],
    }
    good = watchlists.watchlist_pages(texts.where("file = 'ok'"), "https://docs.example").orderBy("ord").collect()
    assert [(r["name"], r["url"]) for r in good] == [("ok", u) for u in lists["ok"]["pages"]]
    with pytest.raises(Exception, match="many: version 2; name; duplicate 1"):
        watchlists.watchlist_pages(texts.where("file = 'many'"), "https://docs.example").collect()


def test_target_texts(spark):
    specs = ["product:a", "page:https://x.example/a:b", "page:ftp://x.example", "watchlist:w:1", "x:y", "plain", "", "  ", None, "page:", ":a"]
    got = [tuple(r) for r in watchlists.targets(spark.createDataFrame([(i, s) for i, s in enumerate(specs)], "i int, spec string")).orderBy("i").select("kind", "name", "problem").collect()]
    assert got == [("product", "a", None), ("page", "https://x.example/a:b", None), (None, None, "no address"), ("watchlist", "w:1", None), (None, None, "unknown kind"), (None, None, "no kind"), (None, None, "empty"), (None, None, "empty"), (None, None, "empty"), (None, None, "no name"), (None, None, "unknown kind")]


DAY = datetime(2026, 1, 1)


def streamed(spark, tmp_path, batches, **options):
    """What a progress stream has given out after each micro-batch of (run, event, day, page, ok, expected)."""
    schema = "run_id long, event_id long, at timestamp, page long, ok boolean, expected long"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", progress.PROVIDER)
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for rows in batches:
        spark.createDataFrame([(r, e, DAY + timedelta(days=d), p, ok, n) for r, e, d, p, ok, n in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = progress.progress(source, **options).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(progress.upsert(str(tmp_path / "out"))).trigger(availableNow=True).start()
        query.awaitTermination()
        yield {r["run_id"]: tuple(r)[1:] for r in progress.current(spark.read.parquet(str(tmp_path / "out"))).select("run_id", "version", "done", "failed", "expected", "status").collect()}


def test_progress_of_late_and_repeated_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    batches = [
        [(1, 10, 0, 1, True, 3), (1, 11, 0, 2, False, None), (2, 1, 0, 1, True, None)],
        [(1, 9, 0, 2, True, None), (1, 10, 0, 1, True, 3)],  # an earlier event of a page that has a later outcome, and one that comes again
        [(1, 12, 1, 2, True, None), (1, 13, 1, 3, False, None), (3, 1, 1, 1, False, 1)],
    ]
    got = list(streamed(spark, tmp_path, batches))
    assert got[0] == {1: (1, 1, 1, 3, "running"), 2: (1, 1, 0, None, "running")}
    assert got[1] == {1: (2, 1, 1, 3, "running"), 2: (1, 1, 0, None, "running")}
    assert got[2] == {1: (3, 2, 1, 3, "finished"), 2: (1, 1, 0, None, "running"), 3: (1, 0, 1, 1, "finished")}
    # a batch that is written again changes nothing
    table = spark.read.parquet(str(tmp_path / "out"))
    again = spark.createDataFrame(table.where("batch = 0").drop("batch").collect(), table.drop("batch").schema)
    progress.upsert(str(tmp_path / "out"))(again, 0)
    assert {r["run_id"]: r["version"] for r in progress.current(spark.read.parquet(str(tmp_path / "out"))).collect()} == {1: 3, 2: 1, 3: 1}


def test_quiet_runs_are_interrupted_until_they_go_on(spark, tmp_path):
    (tmp_path / "in").mkdir()
    batches = [[(1, 1, 0, 1, True, 3), (2, 1, 0, 1, True, 1)], [(3, 1, 40, 1, True, 9)], [(3, 2, 41, 2, True, 9)], [(1, 2, 42, 2, True, None)]]
    got = list(streamed(spark, tmp_path, batches, late="1 day", quiet_ms=10 * 86_400_000))
    assert got[2][1][1:] == (1, 0, 3, "interrupted") and got[2][2][1:] == (1, 0, 1, "finished")
    assert got[3][1][1:] == (2, 0, 3, "running")

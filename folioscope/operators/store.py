"""Projections of immutable runs: the latest artifact of each kind, targets, health, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.num import band, half_up, ratio
from folioscope.operators.sampling import numbered

#: The columns of the page index, and the legal changes of a run's status.
INDEX_FIELDS = ["page_key", "url", "title", "score", "band", "fidelity", "mode", "run_id", "at"]
#: The parts of a protocol, in order, and what a change of each is called.
PROTOCOL = {"grader_model": "grader", "probe_model": "probe model", "probe_effort": "effort", "mode": "mode", "grader_prompt_sha": "grader prompt"}
TRANSITIONS = {"queued": ["running", "cancelled"], "running": ["complete", "partial", "cancelled", "interrupted"], "complete": [], "partial": [], "cancelled": [], "interrupted": ["running"]}


def latest_artifacts(pages: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per page the newest audit and the newest probe run of each mode, each with its own run; a later run without an
    artifact doesn't hide an earlier one. `pages`: (keys, order..., run_id, score, mode, fidelity).
    """
    at = F.struct(*order, "run_id")
    newest = lambda value, when: F.max_by(value, F.when(when, at))
    audit = F.col("score").isNotNull()
    parts = [newest(F.col("score"), audit).alias("score"), newest(F.col("run_id"), audit).alias("audit_run")]
    for mode in ("web", "closed"):
        probed = F.col("fidelity").isNotNull() & (F.col("mode") == mode)
        parts += [newest(F.col("fidelity"), probed).alias(f"fidelity_{mode}"), newest(F.col("run_id"), probed).alias(f"run_{mode}")]
    out = pages.groupBy(*keys).agg(*parts)
    web = F.col("run_web").isNotNull()
    return out.withColumn("fidelity", F.when(web, F.col("fidelity_web")).otherwise(F.col("fidelity_closed"))).withColumn("mode", F.when(web, "web").when(F.col("run_closed").isNotNull(), "closed")).withColumn("band", band(F.col("score")))


def target_rollup(pages: DataFrame, by: list[str]) -> DataFrame:
    """Mean, least and largest score, mean fidelity, graders, and pages in each band."""
    bands = [F.count_if(F.col("band") == b).alias(f"band_{b}") for b in ("excellent", "strong", "good", "fair", "poor")]
    return pages.groupBy(*by).agg(F.count("*").alias("pages"), F.count("score").alias("audited"), half_up(F.avg("score"), 1).alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), half_up(F.avg("fidelity"), 1).alias("mean_fidelity"), F.array_join(F.array_sort(F.collect_set("grader")), ",").alias("graders"), *bands)


def run_health(runs: DataFrame, by: list[str]) -> DataFrame:
    """Degraded and failed probes of a run; clean without either, unknown without probes."""
    return runs.groupBy(*by).agg(F.sum("degraded").alias("degraded"), F.sum("failed").alias("failed"), F.bool_and((F.col("degraded") == 0) & (F.col("failed") == 0)).alias("clean"))


def fingerprint(*parts: Column) -> Column:
    """The parts of a protocol in one text; a bar inside a part is written as a browser would, so that parts can be told apart again."""
    plain = lambda p: F.replace(F.replace(p, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C"))
    return F.concat_ws("|", *[plain(F.coalesce(p.cast("string"), F.lit("unknown"))) for p in parts])


def trend_points(runs: DataFrame) -> DataFrame:
    """Points of complete runs only, with target label, the fingerprint of the whole protocol, and whether all its parts are known."""
    known = F.lit(True)
    for part in PROTOCOL:
        known = known & F.col(part).isNotNull()
    return runs.where("status = 'complete'").select("run_id", "at", F.concat_ws(":", "target_type", "target_name").alias("target"), "score", "fidelity", fingerprint(*map(F.col, PROTOCOL)).alias("fingerprint"), known.alias("protocol_known"))


def segment_key() -> Column:
    """An unknown protocol is a segment of its own."""
    return F.when(F.col("protocol_known"), F.col("fingerprint")).otherwise(F.concat(F.lit("unknown:"), F.col("run_id").cast("string")))


def trend_segments(points: DataFrame, field: str = "score") -> DataFrame:
    """Points of a measured field with their segment: within a target in order of time, a new one wherever the protocol changes."""
    order = Window.partitionBy("target").orderBy("at", "run_id")
    rows = points.where(F.col(field).isNotNull()).withColumn("key", segment_key())
    new = (~F.col("key").eqNullSafe(F.lag("key").over(order))).cast("long")
    return rows.withColumn("segment", F.sum(F.coalesce(new, F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def discontinuities(points: DataFrame) -> DataFrame:
    """Where a target's protocol changes, and what changes."""
    order = Window.partitionBy("target").orderBy("at", "run_id")
    rows = points.withColumn("key", segment_key()).withColumn("prior", F.lag("key").over(order)).withColumn("prior_known", F.lag("protocol_known").over(order)).withColumn("prior_fingerprint", F.lag("fingerprint").over(order))
    now, prior = F.split("fingerprint", r"\|"), F.split("prior_fingerprint", r"\|")
    changed = F.concat_ws(", ", *[F.when(F.get(now, F.lit(i)) != F.get(prior, F.lit(i)), f"{name} changed") for i, name in enumerate(PROTOCOL.values())])
    reason = F.when(~F.col("protocol_known") | ~F.col("prior_known"), "protocol unknown").otherwise(changed)
    return rows.where("prior is not null and prior <> key").select("target", "run_id", "at", reason.alias("reason"))


def trend_delta(points: DataFrame, field: str = "score") -> DataFrame:
    """Per target the change between its last two measured points of one protocol; null if they can't be compared."""
    order = Window.partitionBy("target").orderBy(F.desc("at"), F.desc("run_id"))
    rows = points.where(F.col(field).isNotNull()).withColumn("key", segment_key()).withColumn("r", F.row_number().over(order)).where("r <= 2")
    last, before = (F.max(F.when(F.col("r") == r, F.struct(field, "key"))) for r in (1, 2))
    pair = rows.groupBy("target").agg(last.alias("l"), before.alias("b"))
    return pair.select("target", F.col(f"l.{field}").alias("last"), F.when(F.col("l.key") == F.col("b.key"), F.col(f"l.{field}") - F.col(f"b.{field}")).alias("delta"))


def append_points(points: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new points, one for each run, the new one first: appending twice changes nothing."""
    both = points.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.max_by(F.struct(*points.columns), "_new").alias("_last")
    return both.groupBy("run_id").agg(last).select("_last.*")


def illegal_transitions(events: DataFrame) -> DataFrame:
    """Status changes that no run may make; `events` (run_id, ord, status)."""
    order = Window.partitionBy("run_id").orderBy("ord")
    legal = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))])
    rows = events.withColumn("prior", F.lag("status").over(order)).where("prior is not null")
    return rows.where(~F.coalesce(F.array_contains(F.try_element_at(legal, F.col("prior")), F.col("status")), F.lit(False)))


def reconcile(runs: DataFrame, alive: DataFrame) -> DataFrame:
    """Running runs whose owner (host, pid) is known to be dead become interrupted; those of unknown hosts stay."""
    known = alive.groupBy("host").agg(F.collect_set(F.when(F.col("alive"), F.col("pid"))).alias("pids"))
    dead = F.col("pids").isNotNull() & ~F.array_contains("pids", F.col("pid"))
    return runs.join(known, "host", "left").withColumn("status", F.when((F.col("status") == "running") & dead, "interrupted").otherwise(F.col("status"))).drop("pids")


def reusable(pages: DataFrame, artifacts: DataFrame, protocol: list[str]) -> DataFrame:
    """Each page with the newest earlier artifact of the same content hash and protocol, or with none: one ordered pass over both, no join of a hot hash's pairs."""
    on = ["page_key", "content_hash", *protocol]
    asked = pages.select(*on, "at", "run_id", F.lit(None).cast(dict(artifacts.dtypes)["run_id"]).alias("_run"), F.lit(0).alias("_held"))
    held = artifacts.where("complete").select(*on, "at", "run_id", F.col("run_id").alias("_run"), F.lit(1).alias("_held"))
    # of one time the questions come first, so that only earlier artifacts answer; unknown hashes and protocols answer nothing
    before = Window.partitionBy(*on).orderBy("at", "_held", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    met = asked.unionByName(held).withColumn("reused_run", F.when(known, F.last("_run", ignorenulls=True).over(before)))
    return met.where("_held = 0").select(*pages.columns, "reused_run")


def coverage(pages: DataFrame, by: list[str]) -> DataFrame:
    return pages.groupBy(*by).agg(F.count("*").alias("pages"), ratio(F.count("score"), F.count("*"), 2).alias("scored"), ratio(F.count("fidelity"), F.count("*"), 2).alias("probed"))


def page_index(latest: DataFrame, columns: list[str]) -> DataFrame:
    """The allowed columns of the latest artifacts, weakest pages first, those without a score as 0."""
    return latest.select(*columns).orderBy(F.coalesce("score", F.lit(0)), "page_key")


def page_details(pages: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest artifacts with the run of each (audit, closed, web; missing ones have no entry) and the fidelity of each mode as maps."""
    found = latest_artifacts(pages, keys, order)
    entries = lambda *pairs: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in pairs]), lambda e: e["value"].isNotNull()))
    return found.withColumn("provenance", entries(("audit", "audit_run"), ("closed", "run_closed"), ("web", "run_web"))).withColumn("fidelity_by_mode", entries(("closed", "fidelity_closed"), ("web", "fidelity_web")))


def product_aggregates(pages: DataFrame, by: list[str]) -> DataFrame:
    """Rollups of targets with an audit that are no single pages, with the pages of each band as a map, and their place, weakest first. There are as many rows as targets."""
    names = ("excellent", "strong", "good", "fair", "poor")
    found = target_rollup(pages.where("target_type <> 'page'"), by).where("audited > 0")
    bands = F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"band_{n}"))])
    found = found.withColumn("_rank", F.coalesce("mean_score", F.lit(999.0)))
    return numbered(found.withColumn("bands", bands), [], ["_rank", *by], "_place").withColumn("place", (F.col("_place") + 1).cast("int")).drop("_rank", "_place")


def run_list(runs: DataFrame, by: list[str]) -> DataFrame:
    """Per target its runs, the complete ones, their cost and the newest."""
    return runs.groupBy(F.concat_ws(":", *by).alias("target")).agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "complete").alias("complete"), F.sum("cost_cents").alias("cost_cents"), F.max_by("run_id", F.struct("at", "run_id")).alias("newest"))

"""Probe runs of a page: normal forms of older results, which run is current and which comes first, per-run means, formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.num import half_up, ratio
from folioscope.functions.urls import normalize_url, short_hash

#: Error codes of searches that may pass when tried again.
RETRYABLE = ["too_many_requests", "unavailable"]


def normal_harness(results: DataFrame) -> DataFrame:
    """Counters that an older result lacks stay null; only retries and the degraded flag have a default."""
    return results.withColumn("retries", F.coalesce("retries", F.lit(0))).withColumn("search_degraded", F.coalesce("search_degraded", F.lit(False)))


def normal_retrieval(results: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    """A stored `via` stands; else the recomputed verdict (new_hit, new_via) if the probe still has the same prompt; else the grader's."""
    now = probes.select(*keys, F.col("prompt").alias("_prompt"))
    rows = results.join(now, keys, "left")
    stored, same = F.col("via").isNotNull(), F.coalesce(F.col("prompt") == F.col("_prompt"), F.lit(False))
    hit = F.when(stored, F.col("hit")).when(same, F.col("new_hit")).otherwise(F.col("hit"))
    origin = F.when(stored, "stored").when(same, "recomputed").otherwise("grader")
    return rows.withColumns({"via": F.when(stored, F.col("via")).when(same, F.col("new_via")), "origin": origin, "hit": hit}).drop("_prompt")


def current_runs(results: DataFrame, probes: DataFrame, run: list[str], page: list[str]) -> DataFrame:
    """(run, current): whether all prompts of a run are those that the page's probes have now."""
    now = probes.select(*page, "probe_id", F.col("prompt").alias("_prompt"))
    return results.join(now, [*page, "probe_id"], "left").groupBy(*run).agg(F.bool_and(F.coalesce(F.col("prompt") == F.col("_prompt"), F.lit(False))).alias("current"))


def primary_runs(runs: DataFrame, page: list[str]) -> DataFrame:
    """(page, run_id, mode): of a page's current runs a web run before others, then the newest; none for a page without current runs."""
    rank = F.row_number().over(Window.partitionBy(*page).orderBy(F.desc(F.col("mode") == "web"), F.desc("at"), F.desc("run_id")))
    return runs.where("current").withColumn("_r", rank).where("_r = 1").select(*page, "run_id", "mode")


def run_page_means(pages: DataFrame, by: list[str]) -> DataFrame:
    """Per run the unrounded means of page means, so that a page of many probes doesn't outweigh others, and the pages measured."""
    per_page = pages.groupBy(*by, "page_key").agg(F.avg("score").alias("s"), F.avg("fidelity").alias("f"))
    return per_page.groupBy(*by).agg(F.avg("s").alias("score"), F.avg("f").alias("fidelity"), F.count("f").alias("measured"), F.count("*").alias("of_target"))


def variance_table(audits: DataFrame, by: list[str]) -> DataFrame:
    """Pages with several audits: their number, least, largest and range of scores."""
    return audits.where("score is not null").groupBy(*by).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), (F.max("score") - F.min("score")).alias("range")).where("n > 1")


def mean_spread(audits: DataFrame, by: list[str], page: str) -> DataFrame:
    """Mean over pages of the range of a page's scores."""
    inner = audits.groupBy(*by, page).agg((F.max("score") - F.min("score")).alias("r"))
    return inner.groupBy(*by).agg(half_up(F.avg("r"), 2).alias("mean_range"))


def search_flags(results: DataFrame) -> DataFrame:
    """Of an array of error codes: how many, and whether all may pass when tried again."""
    return results.withColumn("n_errors", F.size(F.filter("search_errors", lambda e: e.isNotNull()))).withColumn("retryable", F.forall("search_errors", lambda e: e.isin(*RETRYABLE)) & (F.size("search_errors") > 0))


def arm_costs(calls: DataFrame, arm: str) -> DataFrame:
    """Calls and cents by arm and in all."""
    out = calls.rollup(arm).agg(F.grouping(arm).alias("g"), F.count("*").alias("calls"), F.sum("cost_cents").alias("cost_cents"))
    return out.withColumn(arm, F.when(F.col("g") == 1, F.lit("(all)")).otherwise(F.col(arm))).drop("g")


def product_counts(probes: DataFrame, by: list[str]) -> DataFrame:
    """Probes, those that need several pages, and the share of these."""
    many = F.count_if(F.size("expected_source_urls") > 1)
    return probes.groupBy(*by).agg(F.count("*").alias("probes"), many.alias("multi_page"), ratio(many, F.count("*"), 2).alias("multi_page_share"))


def gap(score: Column, fidelity: Column) -> Column:
    return score - fidelity


def day(iso: Column) -> Column:
    """Calendar day of an ISO time in UTC; a sentinel for what is none."""
    return F.coalesce(F.date_format(F.try_to_timestamp(iso), "yyyy-MM-dd"), F.lit("(none)"))


def without_usage(runs: DataFrame) -> DataFrame:
    """Runs whose results lack their usage."""
    return runs.withColumn("results", F.transform("results", lambda r: r.dropFields("usage")))


def over_ceiling(estimate: Column, ceiling: float) -> Column:
    if not ceiling > 0:
        raise ValueError(f"no cost ceiling: {ceiling}")
    return estimate > ceiling


def remaining_seconds(done: Column, all_: Column, mean_ms: Column, lanes: int) -> Column:
    """Time left of a run from the mean time of a page and the pages run at once; null before the first page is done."""
    return F.when(done > 0, F.ceil((all_ - done) / lanes) * mean_ms / 1000)


def row_bytes(index: DataFrame) -> DataFrame:
    """Mean bytes of an index row as JSON."""
    return index.agg(half_up(F.avg(F.octet_length(F.to_json(F.struct(*index.columns)))), 0).alias("row_bytes"))


def same_page(a: Column, b: Column) -> Column:
    return F.coalesce(normalize_url(a) == normalize_url(b), F.lit(False))


def prompt_hash(*parts: Column) -> Column:
    return short_hash(F.concat_ws("\n", *parts), 12)


def duration_text(ms: Column) -> Column:
    seconds = F.floor(ms / 1000)
    return F.when(seconds < 60, F.concat(seconds, F.lit("s"))).when(seconds < 3600, F.concat(F.floor(seconds / 60), F.lit("m "), seconds % 60, F.lit("s"))).otherwise(F.concat(F.floor(seconds / 3600), F.lit("h "), F.floor(seconds % 3600 / 60), F.lit("m")))


def money_text(usd: Column) -> Column:
    return F.when(usd.isNull(), "unpriced").otherwise(F.format_string("$%.2f", usd))


def run_ids(at: Column, name: Column) -> Column:
    """Ids that sort by time: an ISO instant without colons, and four digits of a hash of the run's name."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss-SSS'Z'"), F.lit("-"), F.substring(F.sha2(name, 256), 1, 4))


def seeded_order(seed: int, key: str) -> Column:
    """A reproducible shuffle's sort key."""
    return F.xxhash64(F.lit(seed), F.col(key))


def retry_ready(answers: DataFrame) -> DataFrame:
    """Answers that can be graded again: not empty, and not stopped by an error."""
    return answers.where((F.coalesce(F.trim("answer"), F.lit("")) != "") & (F.coalesce("stop", F.lit("")) != "error"))

"""Graded probe results: summaries, what remains to be done, and corpus-wide aggregates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.num import finite, half_up, mean_where, ratio

COMPONENTS = ("accuracy", "hallucination_free", "relevance", "structure")


def fidelity(*scores: Column) -> Column:
    """Four component scores from 0 to 10 as one from 0 to 100."""
    return half_up(sum(scores[1:], scores[0]) * 2.5).cast("int")


def graded() -> Column:
    return finite(F.col("fidelity").cast("double"))


def attributed() -> Column:
    """Graded, and the subject identified or, in older results, not recorded."""
    return graded() & F.coalesce("subject_identified", F.lit(True))


def inconclusive() -> Column:
    """A miss while search was degraded or failed live."""
    return (F.coalesce("search_degraded", F.lit(False)) | F.coalesce("live_search_failed", F.lit(False))) & (F.col("hit") == F.lit(False))


def live_search_failed() -> Column:
    return (F.col("mode") == "web") & (F.col("searches_attempted") > 0) & (F.col("searches_succeeded") == 0)


def summarize(results: DataFrame, by: list[str]) -> DataFrame:
    """One pass over results to counts, fidelity means, retrieval rates and component means; every mean and rate names its denominator."""
    n = F.count_if
    hits, judged = n(F.col("hit") == F.lit(True)), F.count("hit")
    return results.groupBy(*by).agg(
        F.count("*").alias("probe_count"),
        n(graded()).alias("graded_count"),
        n(F.col("refusal")).alias("refusal_count"),
        n(F.col("error").isNotNull()).alias("error_count"),
        mean_where(F.col("fidelity"), attributed()).alias("avg_fidelity"),
        mean_where(F.col("fidelity"), graded()).alias("avg_fidelity_all"),
        n(graded() & ~attributed()).alias("unattributed_count"),
        ratio(hits, judged, 2).alias("hit_rate"),
        ratio(hits, judged - n(inconclusive()), 2).alias("effective_hit_rate"),
        n(F.col("via") == "mention").alias("mention_hits"),
        n(F.coalesce("search_degraded", F.lit(False))).alias("degraded_count"),
        n(F.coalesce("live_search_failed", F.lit(False))).alias("live_failed_count"),
        n(inconclusive()).alias("inconclusive_count"),
        *[mean_where(F.col(c), graded(), 2).alias(f"avg_{c}") for c in COMPONENTS],
    )


def completeness(runs: DataFrame) -> DataFrame:
    """Whether a summary accounts for all its probes without errors, and why not."""
    total = F.col("graded_count") + F.col("refusal_count") + F.col("error_count")
    reason = F.when(F.col("probe_count") == 0, "no probes").when(F.col("error_count") > 0, "errors").when(total != F.col("probe_count"), "unsettled")
    return runs.withColumn("incomplete_reason", reason).withColumn("complete", F.col("incomplete_reason").isNull())


def resume_plan(probes: DataFrame, previous: DataFrame, identity: list[str]) -> DataFrame:
    """(probes' columns, state): done if an earlier run of the same identity has a result without error, else todo."""
    done = previous.where("error is null").select(*identity, "probe_id").distinct().withColumn("_done", F.lit(True))
    return probes.join(done, [*identity, "probe_id"], "left").withColumn("state", F.when(F.col("_done"), "done").otherwise("todo")).drop("_done")


def resume_states(results: DataFrame, identity: list[str], earlier: Column) -> DataFrame:
    """(identity, probe_id, state) of `resume_plan` where the probes are those of `results` and the earlier runs' results are its rows that `earlier` names: one aggregate, no join. As in a join, a null key meets nothing."""
    known = [F.col(c).isNotNull() for c in (*identity, "probe_id")]
    done = F.bool_or(F.coalesce(earlier & F.col("error").isNull(), F.lit(False)) & reduce(and_, known))
    return results.groupBy(*identity, "probe_id").agg(F.when(done, "done").otherwise("todo").alias("state"))


def by_retrieval(results: DataFrame, by: list[str]) -> DataFrame:
    """Fidelity of hits and of misses; delta is null where either side is."""
    hit, miss = F.col("hit") & graded(), ~F.col("hit") & graded()
    means = [F.avg(F.when(c, F.col("fidelity"))) for c in (hit, miss)]
    return results.groupBy(*by).agg(F.count_if(hit).alias("hit_n"), half_up(means[0], 1).alias("hit_mean"), F.count_if(miss).alias("miss_n"), half_up(means[1], 1).alias("miss_mean"), half_up(half_up(means[0], 1) - half_up(means[1], 1), 1).alias("delta"))


def by_archetype(results: DataFrame) -> DataFrame:
    return results.groupBy("archetype").agg(F.count("*").alias("n"), mean_where(F.col("fidelity"), graded()).alias("avg_fidelity"), ratio(F.count_if("hit"), F.count("hit"), 2).alias("hit_rate"))


def hallucinations(results: DataFrame) -> DataFrame:
    """Claims by type, by severity and in all, with the probes they affect; one pass by grouping sets."""
    claims = results.select("probe_id", F.explode("hallucinations").alias("h")).select("probe_id", "h.type", "h.severity")
    grouped = claims.groupingSets([["type"], ["severity"], []], "type", "severity").agg(F.count("*").alias("n"), F.count_distinct("probe_id").alias("probes"), F.count_if(F.col("severity") == "high").alias("high"), F.grouping_id().alias("g"))
    facet = F.when(F.col("g") == 1, "type").when(F.col("g") == 2, "severity").otherwise("all")
    return grouped.select(facet.alias("facet"), F.coalesce(F.when(F.col("g") == 1, F.col("type")).when(F.col("g") == 2, F.col("severity")), F.lit("all")).alias("name"), "n", "probes", "high")


def funnel(results: DataFrame, by: list[str]) -> DataFrame:
    """Searched, with results, cited, accurate: over the probes that have counters; nulls where none has."""
    known = F.col("searches_attempted").isNotNull()
    some = F.count_if(known)
    step = lambda c: F.when(some > 0, F.count_if(known & c))
    searched, found = F.col("searches_attempted") > 0, F.col("searches_succeeded") > 0
    cited = F.coalesce("hit", F.lit(False))
    return results.groupBy(*by).agg(step(searched).alias("searched"), step(searched & found).alias("with_results"), step(searched & found & cited).alias("cited"), step(searched & found & cited & (F.col("fidelity") >= 70)).alias("accurate"))


def paired_lift(results: DataFrame, by: list[str]) -> DataFrame:
    """Probes graded in both modes: mean fidelity of each, mean lift, and searches per probe."""
    of = lambda mode, value: F.max(F.when((F.col("mode") == mode) & graded(), F.col(value)))
    both = results.groupBy(*by, "probe_id").agg(of("web", "fidelity").alias("web"), of("closed", "fidelity").alias("closed"), of("web", "searches_attempted").alias("searches_web")).where("web is not null and closed is not null")
    return both.groupBy(*by).agg(F.count("*").alias("pairs"), half_up(F.avg("web"), 4).alias("paired_web"), half_up(F.avg("closed"), 4).alias("paired_closed"), half_up(F.avg(F.col("web") - F.col("closed")), 4).alias("lift"), half_up(F.avg("searches_web"), 4).alias("searches_per_probe"))


def corpus_summary(pages: DataFrame) -> DataFrame:
    """One row over pages (score, fidelity, hits, judged, grader): means and exact medians of the measured pages, the hit rate
    pooled over probes, the graders and whether they are mixed, and notes on what is missing. The exact medians count distinct values, of which
    scores from 0 to 100 with a digit have about a thousand, however many pages there are.
    """
    scored, probed = F.count("score"), F.count("fidelity")
    out = pages.agg(
        F.count("*").alias("pages"), scored.alias("scored"), probed.alias("probed"),
        half_up(F.avg("score"), 1).alias("mean_score"), half_up(F.percentile("score", 0.5), 1).alias("median_score"),
        half_up(F.avg("fidelity"), 1).alias("mean_fidelity"), half_up(F.percentile("fidelity", 0.5), 1).alias("median_fidelity"),
        ratio(F.sum("hits"), F.sum("judged"), 2).alias("hit_rate"), F.array_join(F.array_sort(F.collect_set("grader")), ",").alias("graders"), (F.count_distinct("grader") > 1).alias("mixed_graders"),
    )
    note = lambda condition, *parts: F.when(condition, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    missing = note(F.col("scored") < F.col("pages"), (F.col("pages") - F.col("scored")).cast("string"), " page(s) without an audit")
    unprobed = note(F.col("probed") < F.col("pages"), (F.col("pages") - F.col("probed")).cast("string"), " page(s) without graded probes")
    return out.withColumn("notes", F.concat_ws("; ", missing, unprobed, note(F.col("mixed_graders"), "graders differ")))


def recommendations(audits: DataFrame, by: list[str]) -> DataFrame:
    """Recommendations of audits by priority."""
    rows = audits.select(*by, F.explode("recommendations").alias("r"))
    return rows.groupBy(*by).agg(*[F.count_if(F.col("r.priority") == p).alias(f"p{p}") for p in (1, 2, 3)], F.count("*").alias("n"))


def batch_results(sent: DataFrame, received: DataFrame) -> DataFrame:
    """What was sent with what came back under its custom id; what didn't come back is an error."""
    back = received.select("custom_id", "body", F.col("error").alias("_error"), F.lit(True).alias("_back"))
    return sent.join(back, "custom_id", "left").withColumn("error", F.when(F.col("_back"), F.col("_error")).otherwise("missing from the batch")).drop("_error", "_back")


def regrade_means(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Mean fidelity before and after grading again, over the probes that both have."""
    both = before.select(*by, "probe_id", F.col("fidelity").alias("old")).join(after.select(*by, "probe_id", F.col("fidelity").alias("new")), [*by, "probe_id"]).where("old is not null and new is not null")
    return both.groupBy(*by).agg(F.count("*").alias("n"), half_up(F.avg("old"), 1).alias("mean_before"), half_up(F.avg("new"), 1).alias("mean_after"), half_up(F.avg(F.col("new") - F.col("old")), 1).alias("shift"))

"""Checks rolled up to a product's score, with honest denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.num import half_up, ratio


def rollup_checks(rows: DataFrame, keys: list[str], examples: int = 25) -> DataFrame:
    """Per key and check of assessments (keys, url, check, ord, weight, verdict, detail): pass, warn, fail, evaluated,
    not_applicable, points (half credit for warnings; null if nothing was evaluated) and the first findings, failures first.
    """
    n = {v: F.count_if(F.col("verdict") == v) for v in ("pass", "warn", "fail")}
    evaluated = F.count("verdict")
    rank = F.when(F.col("verdict") == "fail", 0).when(F.col("verdict") == "warn", 1)
    # of a hot product only the first findings of each part are listed; one pass over the rows gives counts and findings
    part = Window.partitionBy(*keys, "check", "sub").orderBy(F.asc_nulls_last("rank"), "url")
    rows = rows.withColumn("rank", rank).withColumn("sub", F.pmod(F.xxhash64("url"), F.lit(64))).withColumn("place", F.row_number().over(part))
    listed = F.collect_list(F.when(F.col("rank").isNotNull() & (F.col("place") <= examples), F.struct("rank", "url", "verdict", "detail")))
    found = rows.groupBy(*keys, "check", "ord", "weight").agg(*[x.alias(v) for v, x in n.items()], evaluated.alias("evaluated"), (F.count("*") - evaluated).alias("not_applicable"), half_up(ratio(n["pass"] + 0.5 * n["warn"], evaluated), 3).alias("points"), F.slice(F.array_sort(listed), 1, examples).alias("f"))
    return found.withColumn("findings", F.when(F.size("f") > 0, F.transform("f", lambda f: f.dropFields("rank")))).drop("f")


def placed(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Checks with their place within a key: fewest points first, unevaluated ones as full, ties as defined. A key has a handful of checks."""
    return checks.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.coalesce("points", F.lit(1.0)), "ord")))


def product_scores(checks: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Score of each key: the weighted mean of the rounded points of the checks that were evaluated, in percent; `more` aggregates ride along."""
    has = F.col("points").isNotNull()
    weight = F.sum(F.when(has, F.col("weight")))
    score = half_up(ratio(F.sum(F.when(has, F.round(F.col("points") * 1000).cast("long") * F.col("weight"))) / 1000.0, weight) * 100, 1)
    return checks.groupBy(*keys).agg(score.alias("score"), F.coalesce(weight, F.lit(0)).alias("scored_weight"), *more)


def potential_fixes(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Points that a check could still bring, most first; checks without any are left out."""
    total = F.sum(F.when(F.col("points").isNotNull(), F.col("weight"))).over(Window.partitionBy(*keys))
    gain = half_up(F.col("weight") * (1 - F.col("points")) / total * 100, 2)
    return checks.withColumn("recoverable", gain).where("recoverable > 0").select(*keys, "check", "ord", "recoverable")


def page_counts(pages: DataFrame, keys: list[str]) -> DataFrame:
    """in_scope, fetched and unfetched pages of a ledger with its fetch results."""
    return pages.groupBy(*keys).agg(F.count_if("included").alias("in_scope"), F.count_if(F.col("included") & F.col("fetched")).alias("fetched"), F.count_if(F.col("included") & ~F.col("fetched")).alias("unfetched"))

"""Token usage priced per call, tallies, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.num import half_up, ratio

#: Cache writes and reads and batch calls relative to the input price, and USD for a unit of each stage.
WRITE_5M, WRITE_1H, READ, BATCH = 1.25, 2.0, 0.1, 0.5
UNIT_COSTS = {"audit": 0.1748, "probe_generation": 0.0583, "probe_web": 0.2737, "probe_closed": 0.0303}
PRICES = "model string, input double, output double"


def price_key(model: Column) -> Column:
    return F.regexp_replace(model, r"-\d{8}$", "")


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """`usage` (model, input_tokens, output_tokens, cache_read, cache_write, cache_write_1h, service_tier) with its cost in USD; null
    for a model without a price. Prices (a short list by its nature) are broadcast; a call is priced by itself, so tiers and cache times never mix.
    """
    p = F.broadcast(prices.select(F.col("model").alias("_model"), F.col("input").alias("_in"), F.col("output").alias("_out")))
    tokens = lambda c: F.coalesce(F.col(c), F.lit(0))
    short = F.greatest(tokens("cache_write") - tokens("cache_write_1h"), F.lit(0))
    rate = F.when(F.col("service_tier") == "batch", BATCH).otherwise(1.0)
    weighted = F.col("_in") * (tokens("input_tokens") + short * WRITE_5M + tokens("cache_write_1h") * WRITE_1H + tokens("cache_read") * READ) + F.col("_out") * tokens("output_tokens")
    return usage.join(p, price_key(F.col("model")) == F.col("_model"), "left").withColumn("cost", weighted / 1e6 * rate).drop("_model", "_in", "_out")


def tally(calls: DataFrame) -> DataFrame:
    """Calls, tokens, cost and cache hit rate by label and in all; a cost is null as soon as one call has none."""
    read, fresh = F.sum("cache_read"), F.sum("input_tokens")
    out = calls.rollup("label").agg(F.grouping("label").alias("g"), F.count("*").alias("calls"), fresh.alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.when(F.bool_and(F.col("cost").isNotNull()), half_up(F.sum("cost"), 4)).alias("cost"), ratio(read, read + fresh + F.sum("cache_write"), 3).alias("cache_hit_rate"))
    return out.withColumn("label", F.when(F.col("g") == 1, "(all)").otherwise(F.col("label"))).drop("g")


def estimate(pages: DataFrame, by: list[str], probes: int, mode: str, spread: float = 0.3) -> DataFrame:
    """Cost lines of a run over the pages of each key, their total, and its range."""
    n = F.count("*")
    lines = {"audit": n * UNIT_COSTS["audit"], "probe_generation": n * probes * UNIT_COSTS["probe_generation"], "probe_test": n * probes * UNIT_COSTS[f"probe_{mode}"]}
    out = pages.groupBy(*by).agg(n.alias("pages"), *[half_up(v, 4).alias(k) for k, v in lines.items()])
    total = sum((F.col(k) for k in lines), F.lit(0.0))
    return out.withColumn("total", half_up(total, 2)).withColumn("low", half_up(total * (1 - spread), 2)).withColumn("high", half_up(total * (1 + spread), 2))


def folded_usage(calls: DataFrame, by: list[str], order: str) -> DataFrame:
    """Token sums; the last service tier that is known wins."""
    counts = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_write")]
    return calls.groupBy(*by).agg(*counts, F.max_by("service_tier", F.when(F.col("service_tier").isNotNull(), F.col(order))).alias("service_tier"))

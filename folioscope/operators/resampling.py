"""Intervals and null distributions by repeated draws. A draw is a hash of its number and a row's key; only sums of rows meet, so that groups may have any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.draws import hashed, with_draw
from folioscope.functions.num import half_up
from folioscope.operators import grouped
from folioscope.operators.grouped import same_group
from folioscope.operators.sampling import numbered
from folioscope.session import stored


def with_mid_ranks(df: DataFrame, by: list[str], columns: dict[str, str], weight: str | None = None) -> DataFrame:
    """`df` with mid ranks of columns, named by the keys; rows with a null have none. Values are counted first, so that a window runs over the different values of a group, not its rows."""
    out = df
    for name, value in columns.items():
        counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("w"))
        upto = F.sum("w").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
        ranks = counted.select(*by, F.col(value).alias("ranked"), (upto - (F.col("w") - 1) / 2).alias(name))
        met = out.alias("a").join(ranks.alias("b"), same_group("a", "b", by) & (F.col(f"a.{value}") == F.col("b.ranked")), "left")
        out = met.select(*[F.col(f"a.{c}") for c in out.columns], F.col(f"b.{name}"))
    return out


def weighted(x: str, y: str, w: str) -> dict[str, Column]:
    """The sums from which a correlation and a slope follow."""
    a, b, c = F.col(x).cast("double"), F.col(y).cast("double"), F.col(w)
    return {"s1": F.sum(c), "sx": F.sum(c * a), "sy": F.sum(c * b), "sxx": F.sum(c * a * a), "syy": F.sum(c * b * b), "sxy": F.sum(c * a * b)}


def correlation_of_sums() -> Column:
    xx, yy = (F.col("s1") * F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") for c in "xy")
    return F.when((F.col("s1") > 1) & (xx > 1e-9) & (yy > 1e-9), (F.col("s1") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(xx * yy))


def slope_of_sums() -> Column:
    xx = F.col("s1") * F.col("sxx") - F.col("sx") * F.col("sx")
    return F.when((F.col("s1") > 1) & (xx > 1e-9), (F.col("s1") * F.col("sxy") - F.col("sx") * F.col("sy")) / xx)


def interval(draws: DataFrame, by: list[str], value: str, alpha: float = 0.05, least: int = 100) -> DataFrame:
    """(by, valid, low, high): the values at places floor(alpha / 2 * valid) and floor((1 - alpha / 2) * valid) of the draws that have one, in order; null under `least` of them. A group has as many rows as draws."""
    listed = draws.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("v"))
    n = F.size("v")
    at = lambda share: F.get("v", F.least(n - 1, F.floor(F.lit(share) * n)).cast("int"))
    return listed.select(*by, n.cast("long").alias("valid"), F.when(n >= least, half_up(at(alpha / 2), 3)).alias("low"), F.when(n >= least, half_up(at(1 - alpha / 2), 3)).alias("high"))


def sums_of(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, draw, sums) of the ranks that pairs of values have in each draw, from (by, draw, row_x, row_y, w)."""
    ranked = with_mid_ranks(cells, [*by, "draw"], {"rx": "row_x", "ry": "row_y"}, "w")
    return ranked.groupBy(*by, "draw").agg(*[v.alias(k) for k, v in weighted("rx", "ry", "w").items()])


def columns_of(statistic: str) -> tuple[str, str]:
    return ("row_x", "row_y") if statistic == "slope" else ("rx", "ry")


def whole_and_draws(rows: DataFrame, drawn: DataFrame, by: list[str], statistic: str, alpha: float, least: int) -> DataFrame:
    """(by, n, estimate, valid, low, high) from (by, row_x, row_y, rx, ry) and from the sums of each draw."""
    stat = slope_of_sums() if statistic == "slope" else correlation_of_sums()
    sums = rows.withColumn("w", F.lit(1)).groupBy(*by).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in weighted(*columns_of(statistic), "w").items()])
    whole = sums.select(*by, "n", half_up(stat, 3).alias("estimate"))
    each = drawn.select(*by, stat.alias("v")).where("v is not null")
    met = whole.alias("a").join(interval(each, by, "v", alpha, least).alias("b"), same_group("a", "b", by), "left")
    return met.select(*[F.col(f"a.{c}") for c in [*by, "n", "estimate"]], F.coalesce("b.valid", F.lit(0)).alias("valid"), "b.low", "b.high")


def measured(df: DataFrame, x: str, y: str, by: list[str], key: str) -> DataFrame:
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(key).alias("row_key"), F.col(x).alias("row_x"), F.col(y).alias("row_y"))
    return with_mid_ranks(rows, by, {"rx": "row_x", "ry": "row_y"})


def bootstrap(df: DataFrame, x: str, y: str, by: list[str], key: str, statistic: str = "ranks", draws: int = 200, alpha: float = 0.05, least: int = 100) -> DataFrame:
    """(by, n, estimate, valid, low, high): a statistic and its percentile bootstrap interval; null without variance or under `least` valid draws.

    A row counts in a draw as often as a Poisson count of mean 1 says, which a hash of draw and `key` gives: each task adds up its own rows as arrays, and as many
    sums as there are draws meet for a group. A draw has about n rows, so that the intervals of some ten rows are wider than those of draws of n (see
    seeded_bootstrap). `statistic`: "slope" of y on x; "ranks", the correlation of the ranks that the rows have in the whole group; "reranked", that of
    ranks taken anew in each draw, for which pairs of values meet with their counts. Rows with a null in x or y don't count.
    """
    rows = stored(measured(df, x, y, by, key), "rows")
    if statistic == "reranked":
        # a pair of values meets in a few tasks, so that its counts of all draws leave few times, and a frequent one isn't left to one task
        dealt = grouped.spread_wide(rows, *by, "row_x", "row_y", F.pmod(F.hash("row_key"), F.lit(grouped.PARTS)))
        drawn = sums_of(grouped.poisson_cells(dealt, by, draws), by)
    else:
        drawn = grouped.poisson_sums(grouped.spread_wide(rows), by, *columns_of(statistic), draws)
    return whole_and_draws(rows, drawn, by, statistic, alpha, least)


def seeded_bootstrap(df: DataFrame, x: str, y: str, by: list[str], key: str, statistic: str = "reranked", draws: int = 10_000, seed: int = 11, alpha: float = 0.05, least: int = 100) -> DataFrame:
    """As `bootstrap`, with draws of exactly n rows by a seeded generator: row s of draw d is the one whose place by `key` the (d * n + s)-th number names, so that
    published intervals come out to the last digit. Groups of up to grouped.MOST rows are arrays of a task for some of the draws; a draw of a larger one has n rows of
    its own, which meet the group's rows by place.
    """
    rows = stored(numbered(measured(df, x, y, by, key), by, ["row_key"], "i"), "rows")
    small, large = grouped.by_size(rows, by)
    if statistic == "reranked":
        drawn = sums_of(grouped.seeded_cells(small, by, draws, seed).groupBy(*by, "draw", "row_x", "row_y").agg(F.sum("w").alias("w")), by)
    else:
        drawn = grouped.seeded_sums(small, by, *columns_of(statistic), draws, seed)
    if large is not None:
        drawn = drawn.unionByName(seeded_by_joins(large, by, statistic, draws, seed))
    return whole_and_draws(rows, drawn, by, statistic, alpha, least)


def seeded_by_joins(rows: DataFrame, by: list[str], statistic: str, draws: int, seed: int) -> DataFrame:
    """(by, draw, sums) of groups of any size. The numbers of a draw are made from a row a group, so that their size must not be guessed from it: they are sorted, never broadcast."""
    group = F.struct(*by, F.lit(0).alias("whole")).alias("grp")
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    slots = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long")))).repartition("grp", "draw").withColumn("s", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    slots = with_draw(slots, F.col("draw") * F.col("n") + F.col("s"), seed, "u").select("grp", "draw", F.shiftright(F.col("u") * F.col("n"), 32).alias("i"))
    counts = slots.groupBy("grp", "draw", "i").agg(F.count("*").alias("w"))
    drawn = counts.hint("merge").join(rows.select(group, *by, "i", "row_x", "row_y", "rx", "ry"), ["grp", "i"]).drop("grp", "i")
    if statistic == "reranked":
        return sums_of(drawn.groupBy(*by, "draw", "row_x", "row_y").agg(F.sum("w").alias("w")), by)
    return drawn.groupBy(*by, "draw").agg(*[v.alias(k) for k, v in weighted(*columns_of(statistic), "w").items()])


def detectable(sizes: DataFrame, n: str, draws: int = 200, alpha: float = 0.05) -> DataFrame:
    """(n, detectable): for each different `n` of `sizes` the rank correlation that n unrelated pairs exceed in size with probability alpha, from random orders by hashes. Null for under two pairs.
    An order of up to grouped.MOST places is an array of one task; longer ones are sorted as rows."""
    each = stored(sizes.select(F.col(n).cast("long").alias("n")).where("n > 1").distinct(), "sizes")
    apart = grouped.spearman_distances(each.where(F.col("n") <= grouped.MOST), draws)
    large = each.where(F.col("n") > grouped.MOST)
    if large.limit(1).count():
        apart = apart.unionByName(distances_by_rows(large, draws))
    r = F.abs(1 - 6.0 * F.col("d") / (F.col("n") * (F.col("n") * F.col("n") - 1)))
    listed = apart.groupBy("n").agg(F.array_sort(F.collect_list(r)).alias("v"))
    found = listed.select("n", half_up(F.get("v", F.floor(F.lit(1 - alpha) * F.size("v")).cast("int")), 3).alias("detectable"))
    return sizes.select(F.col(n).cast("long").alias("n")).distinct().join(found, "n", "left")


def distances_by_rows(each: DataFrame, draws: int) -> DataFrame:
    """As grouped.spearman_distances, for orders of any length."""
    # draws are dealt out before they are unfolded: a task makes the orders of some draws of some n
    places = each.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).repartition("n", "draw").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    place = F.row_number().over(Window.partitionBy("n", "draw").orderBy(hashed(F.col("draw"), F.concat_ws(":", "n", "i")), "i"))
    return places.select("n", "draw", "i", place.alias("j")).groupBy("n", "draw").agg(F.sum((F.col("i") - F.col("j")) * (F.col("i") - F.col("j"))).alias("d"))


def repeat_reliability(df: DataFrame, value: str, unit: str, by: list[str]) -> DataFrame:
    """(by, units, within_sd, between_sd, k, icc, icc_anova): how far repeats of a unit agree, for units of different numbers of repeats, from two levels of sums.

    `icc` takes the pooled deviation within units (of those with two repeats or more), the deviation of the units' means and the mean number of
    repeats: what noise adds to the means is taken away. `icc_anova` is that of one-way mean squares, for unequal groups. Null where a part is
    not measured or both are 0.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(*by, unit).agg(F.count("*").cast("double").alias("k"), F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.sum(F.col(value).cast("double")).alias("s"), F.sum(F.col(value).cast("double") * F.col(value)).alias("q"))
    whole = per.groupBy(*by).agg(
        F.count("*").alias("units"), F.sqrt(F.avg(F.when(F.col("k") > 1, F.col("v")))).alias("within"), F.stddev_samp("m").alias("between"), F.avg("k").alias("mk"),
        F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("kk"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("k")).alias("sk"),
    )
    own = F.greatest(F.lit(0.0), F.col("between") * F.col("between") - F.col("within") * F.col("within") / F.col("mk"))
    noise = F.col("within") * F.col("within")
    units, n = F.col("units"), F.col("n")
    msb = F.when(units > 1, (F.col("sk") - F.col("s") * F.col("s") / n) / (units - 1))
    msw = F.when(n > units, (F.col("q") - F.col("sk")) / (n - units))
    k0 = F.when(units > 1, (n - F.col("kk") / n) / (units - 1))
    total = msb + (k0 - 1) * msw
    return whole.select(
        *by, "units", half_up(F.col("within"), 3).alias("within_sd"), half_up(F.col("between"), 3).alias("between_sd"), half_up(F.col("mk"), 3).alias("k"),
        half_up(F.when(own + noise > 0, own / (own + noise)), 3).alias("icc"), half_up(F.when(total > 1e-9, (msb - msw) / total), 3).alias("icc_anova"),
    )


def attenuation(reliabilities: DataFrame, icc: str, repeats: list[int], true_r: float = 0.6) -> DataFrame:
    """A row for each number of repeats: the reliability of a mean of so many, and what a correlation of `true_r` shrinks to. Null where the agreement of repeats is unknown or negative."""
    k, r = F.col("repeats"), F.col(icc)
    rows = reliabilities.withColumn("repeats", F.explode(F.array(*map(F.lit, repeats))))
    reliability = F.when(r >= 0, k * r / (1 + (k - 1) * r))
    return rows.withColumn("reliability", half_up(reliability, 3)).withColumn("observed_r", half_up(F.lit(true_r) * F.sqrt(reliability), 2))

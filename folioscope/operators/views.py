"""Tables as a reader uses them: search, sort, pages, groups, pivots, selections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from folioscope.functions.num import half_up, ratio
from folioscope.functions.urls import slug
from folioscope.operators.sampling import numbered


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows of which some column holds the text, whatever its case; nulls hold nothing."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
    return df.where(found) if text else df


def order(column: str, ascending: bool = True) -> Column:
    """Nulls last in both directions."""
    return F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column)


def page_of(df: DataFrame, keys: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of `size` rows: a top-k of the pages up to it, not a sort of all rows."""
    upto = df.orderBy(*keys).limit(number * size)
    return upto.orderBy(*keys).offset((number - 1) * size)


def groups(df: DataFrame, by: Column, first: list[str] | None = None) -> DataFrame:
    """(group, size, place): the given names in order, then the larger, then by name; no group last."""
    name = F.coalesce(by.cast("string"), F.lit("(none)"))
    sized = df.groupBy(name.alias("group")).agg(F.count("*").alias("size"))
    rank = F.array_position(F.array(*map(F.lit, first)), F.col("group")) if first else F.lit(0)
    keys = {"k0": F.when(F.col("group") == "(none)", 2).when(rank > 0, 0).otherwise(1), "k1": F.when(rank > 0, rank).otherwise(0), "k2": -F.col("size"), "k3": F.lower("group")}
    placed = numbered(sized.select("*", *[c.alias(k) for k, c in keys.items()]), [], [*keys, "group"], "nth")
    return placed.select("group", "size", (F.col("nth") + 1).cast("int").alias("place"))


def matrix(probes: DataFrame, runs: DataFrame, results: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each probe and a fidelity column for each model|mode, from the newest run of each; unknown cells are null."""
    newest = runs.groupBy("model", "mode").agg(F.max_by("run_id", F.struct("at", "run_id")).alias("run_id"))
    cells = results.join(newest, "run_id").groupBy("probe_id", F.concat_ws("|", "model", "mode").alias("column")).agg(F.max("fidelity").alias("fidelity"))
    return probes.select("probe_id").distinct().join(cells, "probe_id", "left").groupBy("probe_id").pivot("column", columns).agg(F.max("fidelity"))


def recoverable(weight: Column, score: Column) -> Column:
    """Points that a dimension could still bring; 0 where either is unknown."""
    return F.coalesce(half_up(weight * (10 - score) / 10, 1), F.lit(0.0))


def next_action(has_probes: Column, tested: Column) -> Column:
    """What a page needs next; what is measured comes first."""
    return F.when(tested & has_probes, "retest").when(tested, "regenerate").when(has_probes, "test").otherwise("generate")


def dimension_means(dims: DataFrame, page: str) -> DataFrame:
    """(name, n, mean): the mean score of each dimension over pages, weakest first."""
    per_page = dims.groupBy(page, "name").agg(F.avg("score").alias("score"))
    return per_page.groupBy("name").agg(F.count("*").alias("n"), half_up(F.avg("score"), 1).alias("mean")).orderBy("mean", "name")


def systemic(dims: DataFrame, product: str, page: str) -> DataFrame:
    """(name, products, mean): the mean over products of their means, so that a large one doesn't outweigh the others."""
    means = dims.groupBy(product, "name").agg(F.avg("score").alias("m"))
    return means.groupBy("name").agg(F.count("*").alias("products"), half_up(F.avg("m"), 2).alias("mean"))


def shares(df: DataFrame, by: str) -> DataFrame:
    """(by, n, share of all)."""
    one = F.lit(1).alias("one")
    whole = df.groupBy(one).agg(F.count("*").alias("all"))  # one row, from partial counts
    counted = df.groupBy(by, one).agg(F.count("*").alias("n")).join(whole, "one")
    return counted.select(by, "n", half_up(F.col("n") / F.col("all"), 4).alias("share"))


def uniqueness_violations(df: DataFrame, key: str, value: str, shown: int = 5) -> DataFrame:
    """Keys that several values share, with their number, the first and the last one, and the first `shown`."""
    pairs = df.select(key, value).distinct()
    counted = pairs.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("first"), F.max(value).alias("last")).where("n > 1")
    place = F.row_number().over(Window.partitionBy(key).orderBy(value))
    some = pairs.withColumn("_r", place).where(F.col("_r") <= shown).groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))
    return counted.join(some, key)


def require_unique(df: DataFrame, key: str, value: str) -> DataFrame:
    """`df`, whose use fails with the names of the values if several share a key."""
    found = uniqueness_violations(df, key, value).select(F.col(key).alias("_key"), F.concat(F.lit("key "), F.col(key).cast("string"), F.lit(" is shared by "), F.col("n").cast("string"), F.lit(": "), F.array_join(F.transform("values", lambda v: v.cast("string")), ", ")).alias("_problem"))
    met = df.join(found, F.col(key) == F.col("_key"), "left")
    return met.where(F.when(F.col("_problem").isNull(), True).otherwise(F.raise_error(F.coalesce("_problem", F.lit(""))).cast("boolean"))).select(*df.columns)


def top_of(df: DataFrame, by: list[str], keys: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).where(F.col("place") <= most)


def by_opportunity(dims: DataFrame, by: list[str], weight: str, score: str, keys: list[str], most: int) -> DataFrame:
    """The dimensions that could bring most, weaker ones first where two could bring the same; unknown scores bring nothing."""
    rows = dims.withColumn("gain", recoverable(F.col(weight), F.col(score)))
    return top_of(rows, by, [F.desc("gain"), F.asc_nulls_last(score), *map(F.asc, keys)], most)


def aligned(rows: DataFrame, url: str, dims: DataFrame, key: str) -> DataFrame:
    """Rows with the dimension scores of their URL's short name; rows and scores without the other are left out."""
    return rows.withColumn(key, slug(F.col(url))).join(dims, key)


def focus(df: DataFrame, by: str, group: str) -> DataFrame:
    """The rows of one group."""
    return df.where(F.col(by) == group)


def page_of_groups(df: DataFrame, by: str, keys: list[Column], number: int, size: int) -> DataFrame:
    """All rows of the groups of page `number` (from 1), `size` groups a page: the groups' names are sorted, not their rows."""
    names = page_of(df.select(by).distinct(), keys, number, size)
    place = F.row_number().over(Window.orderBy(*keys)) + (number - 1) * size  # of one page of names
    return df.join(names.withColumn("place", place), by)


def group_summary(pages: DataFrame, by: str) -> DataFrame:
    return pages.groupBy(by).agg(F.count("*").alias("pages"), half_up(F.avg("score"), 1).alias("mean_score"), F.count("fidelity").alias("measured"), half_up(F.avg("fidelity"), 1).alias("mean_fidelity"), ratio(F.count("fidelity"), F.count("*"), 2).alias("coverage"))


def run_groups(runs: DataFrame, by: str) -> DataFrame:
    return runs.groupBy(by).agg(F.count("*").alias("runs"), F.max("at").alias("last_at"), F.sum("cost_cents").alias("cost_cents"), F.count_if(~F.col("status").isin("complete")).alias("incomplete"))


def stage_times(runs: DataFrame, by: list[str]) -> DataFrame:
    """Wall time by stage of a map of durations."""
    return runs.select(*by, F.explode("durations").alias("stage", "ms")).groupBy(*by, "stage").agg(F.sum("ms").alias("ms"))


def last_lines(logs: DataFrame, by: list[str], order_by: str, n: int = 20) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order_by)))
    return logs.withColumn("_r", place).where(F.col("_r") <= n).drop("_r")


def even_spaced(df: DataFrame, by: list[str], keys: list[str], picks: int) -> DataFrame:
    """`picks` rows of each group, spaced evenly over its order."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(*keys)) - 1).withColumn("_n", F.count("*").over(w))
    chosen = F.transform(F.sequence(F.lit(0), F.lit(picks - 1)), lambda j: F.floor((F.col("_n") - 1) * j / F.greatest(F.lit(picks - 1), F.lit(1)) + 0.5))
    return rows.where(F.array_contains(F.when(F.col("_n") <= picks, F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).otherwise(chosen), F.col("_i").cast("long"))).drop("_i", "_n")


def round_robin(df: DataFrame, section: str, keys: list[Column], most: int) -> DataFrame:
    """Up to `most` rows of each section, dealt in turns: all first ones, then all second ones."""
    rows = df.withColumn("turn", F.row_number().over(Window.partitionBy(section).orderBy(*keys))).where(F.col("turn") <= most)
    return rows


def budget_fill(pages: DataFrame, by: list[str], size: str, cost: str, keys: list[str], budget: int) -> DataFrame:
    """(by, keys, cost, used): pages that fit a budget, smaller first; one that doesn't fit is skipped, later ones may fit.

    What is left never grows, so that of the pages of one cost those used are the first ones, at most budget / cost. Only
    these are folded in order: under budget * ln(budget) of them, however many pages a group has. The others are not used;
    pages without cost always are.
    """
    rows = pages.select(*by, size, *keys, F.col(cost).cast("long").alias("cost"))
    first = rows.where("cost > 0").withColumn("_r", F.row_number().over(Window.partitionBy(*by, "cost").orderBy(size, *keys)))
    first = first.where((F.col("_r") <= budget) & (F.col("_r") * F.col("cost") <= budget))
    listed = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(size).alias("size"), *keys, "cost"))).alias("rows"))

    @F.pandas_udf(ArrayType(BooleanType()))
    def fits(costs: pd.Series) -> pd.Series:
        """Whether each cost fits what those before it leave: a fold whose state is one number."""

        def fold(values: list[int]) -> list[bool]:
            left, out = budget, []
            for cost in values:
                out.append(cost <= left)
                left -= cost if cost <= left else 0
            return out

        return costs.map(fold)

    filled = listed.withColumn("taken", fits(F.transform("rows", lambda r: r["cost"])))
    used = filled.select(*by, F.explode(F.arrays_zip(F.col("rows"), F.col("taken"))).alias("x")).where("x.taken").select(*by, *[F.col(f"x.rows.{k}").alias(k) for k in keys], F.lit(True).alias("_used"))
    out = rows.join(used, [*by, *keys], "left")
    return out.select(*by, *keys, "cost", (F.coalesce("_used", F.lit(False)) | (F.col("cost") <= 0)).alias("used"))


def samples(findings: DataFrame, by: list[str], limit: int) -> DataFrame:
    """First finding of each page by impact, at most `limit` pages of each key."""
    first = Window.partitionBy(*by, "url").orderBy(F.desc("impact"), "ord")
    one = findings.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("impact"), "ord", "url"))
    return one.withColumn("place", place).where(F.col("place") <= limit)

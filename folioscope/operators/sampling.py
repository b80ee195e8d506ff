"""Seeded shuffles and the selections made from them, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.draws import with_draw
from folioscope.session import stored


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "i") -> DataFrame:
    """`df` with a row number from 0 in each group by `order`, which names the rows of a group. Rows are dealt out by ranges of group and
    order; a range numbers its own rows, to which those of its group's earlier ranges are added, so that no task sorts more than a range.
    """
    part, before = f"{name}_part", f"{name}_before"
    ranged = stored(df.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(*by, part).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    sizes = sizes.select(*by, part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    own = F.row_number().over(Window.partitionBy(*by, part).orderBy(*order)) - 1
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, part]]
    met = ranged.withColumn(name, own.cast("long")).alias("a").join(sizes.alias("b"), same)
    return met.select(*[F.col(f"a.{c}") for c in df.columns], (F.col(f"a.{name}") + F.col(before)).alias(name))


def seeded_shuffle(df: DataFrame, by: list[str], order: list[str], seed: int, skip: int = 0) -> DataFrame:
    """`df` with `place` (from 0): the order that a shuffle from the last row to the first with this seed gives each group, bit for bit. `order` names the rows of a
    group, in the order before the shuffle; `skip` numbers of the generator are used up already. Each group begins with the seed.

    Step i swaps places i and j(i) <= i. The place i is final then, with what j(i) held: the row that a later-numbered step,
    the least i' > i with j(i') = j(i), put there, which is what place i' held before that step; that again was put there by the least
    i'' > i' with j(i'') = i', and so on, up to a place that no step wrote to, which holds its own row. The rows of a chain
    are found by doubling, each round a join; chains have about log n links.
    """
    keys = ["grp"]
    group = F.struct(*by, F.lit(0).alias("whole")).alias("grp")  # a struct of nulls is a group too
    rows = stored(numbered(df, by, order, "shuffle_i"), "rows")
    own = rows.select(group, F.col("shuffle_i").alias("i"))
    sizes = own.groupBy("grp").agg(F.count("*").alias("shuffle_n"))
    drawn = with_draw(own.join(sizes, "grp"), F.col("shuffle_n") - F.col("i") + skip, seed, "u")
    j = F.when(F.col("i") == 0, F.lit(0).cast("long")).otherwise(F.shiftright(F.col("u") * (F.col("i") + 1), 32))
    steps = stored(drawn.select(*keys, "i", j.alias("j")), "steps")
    later = F.lead("i").over(Window.partitionBy(*keys, "j").orderBy("i"))  # few steps swap with one place: about log n
    firsts = steps.where("i > j").groupBy(*keys, F.col("j").alias("q")).agg(F.min("i").alias("to"))
    chain = stored(firsts, "chain")
    while True:
        ahead = chain.select(*keys, F.col("q").alias("to"), F.col("to").alias("further"))
        moved = stored(chain.join(ahead, [*keys, "to"], "left").select(*keys, "q", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "chain")
        chain = moved.select(*keys, "q", "to")
        if not moved.where("moved").limit(1).count():
            break
    source = steps.select(*keys, "i", "j", later.alias("s"))
    ends = chain.select(*keys, F.col("q").alias("s"), "to")
    source = source.join(ends, [*keys, "s"], "left").select(*keys, F.col("i").alias("place"), F.coalesce("to", "s", "j").alias("shuffle_i"))
    row = rows.select(F.struct(*df.columns).alias("row"), group, "shuffle_i")
    return row.join(source, ["grp", "shuffle_i"]).select("row.*", "place")


def spread_over_sections(df: DataFrame, section: str, order: list[str], seed: int, target: int, most: int) -> DataFrame:
    """`target` rows at most, `most` of each section, with `pick` (from 1): rows are shuffled, sections, in the order in which they come
    up, are shuffled with what the generator gives next, and the sections take turns. Selection is the feature: no other row is needed.
    """
    shuffled = stored(seeded_shuffle(df, [], order, seed), "shuffled")
    place = F.row_number().over(Window.partitionBy(section).orderBy("place"))
    turns = shuffled.select("*", place.alias("turn")).where(F.col("turn") <= most)
    first = shuffled.groupBy(section).agg(F.min("place").alias("up"))
    turn_of = seeded_shuffle(first, [], ["up"], seed, max(0, shuffled.count() - 1)).select(section, F.col("place").alias("nth"))
    picked = turns.join(turn_of, section).orderBy("turn", "nth").limit(target)
    return picked.withColumn("pick", F.row_number().over(Window.orderBy("turn", "nth"))).select(*df.columns, "pick")

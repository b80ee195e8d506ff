"""Operator 7 [native]: line dedup by a deletion-neighbourhood join.

Lines are compared as lists of lower-cased words; the edit bound is one word: inserted, deleted or replaced. A line without
its word i is a variant of it. Two lines of n words that differ in word i share the variant (i, rest); a line of n + 1 words
and one of n share a variant of the longer one with the shorter one whole.

Emitting all variants of all lines would multiply the text by its words, so they are narrowed first, losing no pair: two lines within the
bound agree in their first or in their last words, and then in all but one of about sqrt(n) blocks of words. Only words of
such a block are deleted for variants. Within a variant the earliest line stands for all, so that a variant of any size gives
one candidate pair for each of its lines; every candidate pair is verified on its words.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, named, shared_folder, unused

ENDS = ("first", "last", "step_first", "step_last")
BITS = 32_768  # of one bitmap row
MOST_BITMAPS = 4_096


def stored(df: DataFrame) -> DataFrame:
    """`df` written as a table to the shared checkpoint folder and read again: smaller than a checkpoint, and read by column."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def normal(low: Column) -> Column:
    """The words of a lower-cased line with one space between them; ASCII white space parts words."""
    return F.trim(F.regexp_replace(low, r"[ \t\x0B\f\r]+", " "))


def normal_lines(text: Column) -> Column:
    """The normal form of each line of a text; a text whose lines all have it is only split."""
    lines = F.split(F.lower(text), "\n", -1)
    uneven = F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    for blanks in ("  ", " \n", "\n ", "\t", "\x0b", "\f", "\r"):
        uneven = uneven | F.contains(text, F.lit(blanks))
    return F.when(uneven, F.transform(lines, normal)).otherwise(lines)


def word_count(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def head(line: Column, n: Column) -> Column:
    """First n words, or the last -n."""
    return F.call_function("substring_index", line, F.lit(" "), n)


def within_one_word(x: Column, y: Column) -> Column:
    """Whether two lists of words are at a word edit distance of at most 1: what their common head and tail leave out is one word at most."""
    n, m = F.size(x), F.size(y)
    both = F.least(n, m)
    differs = lambda a, b: F.array_position(F.zip_with(F.slice(a, 1, both), F.slice(b, 1, both), lambda p, q: p != q), True)
    run = lambda a, b: F.when(differs(a, b) == 0, both).otherwise(differs(a, b) - 1)
    return (F.greatest(n, m) - both <= 1) & (run(x, y) + run(F.reverse(x), F.reverse(y)) >= F.greatest(n, m) - 1)


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, pos, line) of all lines of all whole texts."""
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))


def span(n: Column) -> Column:
    """Words of the compared ends of a line of n: a power of two of at most n / 2, the same for n and n + 1 but at its steps."""
    return F.floor(F.pow(F.lit(2.0), F.floor(F.log2(n / 2.0)))).cast("int")


def repeated(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 3, fuzzy: int = 8) -> DataFrame:
    """(doc, pos) of each line that repeats an earlier one: the same words as some earlier line, or, with `fuzzy` words or
    more in both, within one word of it. Earlier means smaller (doc, pos); a line counts as an earlier one whether or not it
    is itself a repeat. Lines of under `least` words neither repeat nor are repeated. Null texts have no lines to drop; rows
    that repeat whole (the same key) keep the same lines.
    """
    # normal lines come out of the explode, so that no filter computes them again
    lines = df.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.posexplode(normal_lines(F.col(text))).alias("pos", "norm")).where("norm <> ''")
    lines = lines.select("doc", "pos", "norm", word_count(F.col("norm")).alias("n")).where(F.col("n") >= least)
    # a line at a step of span() is compared over both its steps
    end = lambda side, sign, size: F.xxhash64(F.lit(side), head(F.col("norm"), sign * size))
    long, step = F.col("n") >= fuzzy, span(F.col("n")) != span(F.col("n") - 1)
    ends = [F.when(c, end(side, sign, span(F.col("n") - less))).alias(name) for name, c, less, side, sign in zip(ENDS, (long, long, long & step, long & step), (0, 0, 1, 1), (0, 1, 0, 1), (1, -1, 1, -1))]
    keyed = stored(lines.select("doc", "pos", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(7), "norm").alias("h2"), "n", *ends))
    at = F.struct("doc", "pos")
    earliest = keyed.groupBy("h1", "h2").agg(F.min(at).alias("at"), *[F.first(c).alias(c) for c in ("n", *ENDS)])
    earliest = stored(earliest.select("h1", "h2", "at.doc", "at.pos", "n", *ENDS))
    near = fuzzy_repeats(df, key, text, earliest, fuzzy)
    first = earliest.select("h1", "h2", "doc", "pos").join(near.withColumn("near", F.lit(True)), ["doc", "pos"], "left")
    first = stored(first.select("h1", "h2", F.struct("doc", "pos").alias("at"), F.coalesce("near", F.lit(False)).alias("near")))
    exact = keyed.select("h1", "h2", at.alias("own")).join(first, ["h1", "h2"]).where((F.col("own") != F.col("at")) | F.col("near"))
    return exact.select("own.doc", "own.pos").distinct()


def shared_by(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key some other line has too."""
    line = F.xxhash64("doc", "pos")
    both = rows.groupBy(key).agg(F.min(line).alias("lo"), F.max(line).alias("hi")).where("lo <> hi").select(key)
    return rows.join(checkpoint(both), key)


def only(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of `lines` (doc, pos, ...) that `wanted` (doc, pos) names. A bitmap of hashes of a fixed greatest size, which is
    broadcast, lets few other rows through to the join, so that the join doesn't shuffle all text.
    """
    wanted = checkpoint(wanted.distinct())
    maps = min(MOST_BITMAPS, 1 + wanted.count() * 16 // BITS)
    slot = F.pmod(F.xxhash64("doc", "pos"), F.lit(maps * BITS))
    bitmap = wanted.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    bit = F.bitmap_bit_position("slot")
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    kept = lines.withColumn("slot", slot).join(F.broadcast(bitmap), F.bitmap_bucket_number("slot") == F.col("bucket")).where(F.getbit(byte, (bit % 8).cast("int")) == 1)
    return kept.drop("slot", "bucket", "bits").join(wanted, ["doc", "pos"])


def fuzzy_repeats(df: DataFrame, key: str, text: str, earliest: DataFrame, fuzzy: int) -> DataFrame:
    """(doc, pos) of the distinct lines within one word of a distinct line with an earlier place."""
    long = earliest.where(F.col("n") >= fuzzy).select("doc", "pos", F.posexplode(F.array(*ENDS)).alias("side", "end")).where("end is not null")
    suspects = checkpoint(shared_by(long, "end").select("doc", "pos", (F.col("side") % 2).alias("side")).distinct())
    lines = lines_of(df, key, text)
    lines = only(lines, suspects.select("doc", "pos")).select("doc", "pos", normal(F.lower("line")).alias("norm")).dropDuplicates(["doc", "pos"])
    words = stored(lines.withColumn("n", word_count(F.col("norm"))))
    # blocks: all of a line but one block of words, as one of n words and as the longer one of a pair
    sides = suspects.groupBy("doc", "pos").agg(F.bool_or(F.col("side") == 0).alias("same_first"), F.bool_or(F.col("side") == 1).alias("same_last"))
    roles = words.join(sides, ["doc", "pos"]).withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("m", F.col("n") - F.col("longer")).where(F.col("m") >= fuzzy)
    roles = roles.withColumn("blocks", F.ceil(F.sqrt("m")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    start = F.floor(F.col("m") * F.col("b") / F.col("blocks")).cast("int")
    end = F.floor(F.col("m") * (F.col("b") + 1) / F.col("blocks")).cast("int") + F.col("longer")
    roles = roles.withColumn("s", start).withColumn("e", end)
    reach = (F.col("same_first") & (F.col("e") > span(F.col("m")))) | (F.col("same_last") & (F.col("s") < F.col("n") - span(F.col("m"))))
    cut = F.xxhash64("m", "b", head(F.col("norm"), F.col("s")), head(F.col("norm"), F.col("e") - F.col("n")))
    blocks = roles.where(reach).select("doc", "pos", "longer", "s", "e", cut.alias("cut"))
    blocks = checkpoint(shared_by(blocks, "cut").select("doc", "pos", "longer", "s", "e").distinct())
    # variants: the words of those blocks deleted, one at a time
    each = blocks.join(words, ["doc", "pos"]).withColumn("i", F.explode(F.sequence(F.col("s"), F.col("e") - 1)))
    rest = F.concat_ws(" ", F.nullif(head(F.col("norm"), F.col("i")), F.lit("")), F.nullif(head(F.col("norm"), F.col("i") + 1 - F.col("n")), F.lit("")))
    place = F.when(F.col("longer") == 0, F.col("i")).otherwise(-1)
    variants = each.select("doc", "pos", F.col("longer").alias("kind"), F.xxhash64(place, rest).alias("v1"), F.xxhash64(F.lit(7), place, rest).alias("v2")).distinct()
    whole = words.join(blocks.select("doc", "pos").distinct(), ["doc", "pos"]).select("doc", "pos", F.lit(2).alias("kind"), F.xxhash64(F.lit(-1), "norm").alias("v1"), F.xxhash64(F.lit(7), F.lit(-1), "norm").alias("v2"))
    variants = checkpoint(variants.union(whole))
    # kind 0: any two lines of a variant are one word apart; 1 and 2: longer lines and the shorter one that they contain
    line = F.struct("doc", "pos")
    firsts = variants.groupBy("v1", "v2").agg(*[F.min(F.when(F.col("kind") == k, line)).alias(f"f{k}") for k in (0, 1, 2)], F.count("*").alias("c")).where("c > 1")
    met = variants.join(checkpoint(firsts), ["v1", "v2"])
    other = F.when(F.col("kind") == 0, F.col("f0")).when(F.col("kind") == 1, F.col("f2")).otherwise(F.col("f1"))
    pairs = met.select("doc", "pos", other.alias("o")).where("o is not null").where(F.col("o") < F.struct("doc", "pos")).distinct()
    pairs = pairs.select("doc", "pos", F.col("o.doc").alias("o_doc"), F.col("o.pos").alias("o_pos"))
    side = words.select(F.col("doc").alias("o_doc"), F.col("pos").alias("o_pos"), F.split("norm", " ").alias("y"))
    pairs = pairs.join(words.select("doc", "pos", F.split("norm", " ").alias("x")), ["doc", "pos"]).join(side, ["o_doc", "o_pos"])
    return pairs.where(within_one_word(F.col("x"), F.col("y"))).select("doc", "pos").distinct()


def reduced(df: DataFrame, key: str, text: str, **options) -> tuple[DataFrame, str, str]:
    """`df` with two more columns, which are named too: the positions of the lines that each text loses and the text without them; nulls where it loses none."""
    drop, kept = unused(df, "_drop"), unused(df, "_kept")
    own = df.select(named(key).alias("doc"), named(text).alias("text"))
    drops = checkpoint(repeated(own, "doc", "text", **options).groupBy(F.col("doc").alias("_of")).agg(F.collect_set("pos").alias("_gone")))
    row = F.struct(*map(named, df.columns)).alias("row")  # as one column, so that no name can clash
    met = df.select(row, named(key).alias("_key")).join(drops, F.col("_key") == F.col("_of"), "left")
    # the lines come out of a generator, which nothing moves into the function over the positions: a text is split once
    lines = F.when(F.col("_gone").isNotNull(), F.split(F.col("row").getField(text), "\n", -1))
    split = met.select("row", "_gone", F.explode(F.array(lines)).alias("_lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    joined = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    return split.select(*[F.col("row").getField(c).alias(c) for c in df.columns], F.col("_gone").alias(drop), joined.alias(kept)), drop, kept


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`df` with its columns, each text without its repeated lines (see `repeated`). Texts that lose nothing stay as they
    are, null too; a text that loses all its lines becomes empty. Rows with a null key stay as they are. Columns may have any name.
    """
    out, _, kept = reduced(df, key, text, **options)
    return out.select(*[F.coalesce(named(kept), named(c)).alias(c) if c == text else named(c) for c in df.columns])


def report(df: DataFrame) -> DataFrame:
    """The result of op7: per document its lines, those that stay, and a digest of what stays."""
    out, drop, kept = reduced(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text")
    n_lines = F.size(F.split("text", "\n", -1)).cast("long")
    return out.select("doc_id", n_lines.alias("n_lines"), (n_lines - F.coalesce(F.size(drop), F.lit(0))).alias("n_kept"), F.md5(F.coalesce(kept, "text")).alias("text_md5"))

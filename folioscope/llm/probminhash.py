"""Operator 6: near-duplicate documents by ProbMinHash, banding and verification.

Each distinct five-word shingle of weight w sends arrivals of a Poisson process of rate w, each to a random register, which
keeps its earliest arrival's shingle. Two registers agree with the probability Jaccard similarity of the weighted
shingle sets. A shingle stops as soon as its next arrival is later than all registers. Weights grow with the logarithm of a
shingle's count. As links don't look at weights, a text in which a shingle repeats has a second sketch of equal rates, which is the
only one of all other texts. Bands of registers name buckets; the members of a bucket are compared with its leader; in a second pass
those that aren't in their leader's class are compared with all that have met this leader. Every candidate pair is verified on its whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, mix, named, shingles, slices, strings, text_key

SPREAD = np.uint64(0xD1B54A32D192ED03)


def sketch(owner: np.ndarray, shingle: np.ndarray, times: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """The register values (the shingles that arrive first) of each text; a text without shingles keeps zeros."""
    rate = 1.0 + np.log2(times)
    best = np.full(texts * registers, np.inf)
    name = np.zeros(texts * registers, np.uint64)
    at, live, turn = np.zeros(len(shingle)), np.arange(len(shingle)), 0
    while len(live):
        turn += 1
        first = mix(shingle[live] + np.uint64(turn * int(SPREAD) % 2**64))
        gap = -np.log1p(-(first >> np.uint64(11)).astype(np.float64) / (1 << 53)) / rate[live]
        slot = owner[live] * registers + (mix(first + SPREAD) % np.uint64(registers)).astype(np.int64)
        at[live] += gap
        order = np.argsort(-at[live], kind="stable")  # the earliest arrival at a register is written last
        slot, when, who = slot[order], at[live][order], shingle[live][order]
        early = when < best[slot]
        best[slot[early]], name[slot[early]] = when[early], who[early]
        limit = best.reshape(texts, registers).max(axis=1)
        live = live[at[live] < limit[owner[live]]]
    return name.reshape(texts, registers)


def bands_of(names: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit name for each band of each sketch."""
    rows = names.reshape(len(names), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * SPREAD, rows.shape[:2]).copy()
    for r in range(rows.shape[2]):
        out = mix(out ^ rows[:, :, r]) + SPREAD
    return out


def sketches(df: DataFrame, key: str, text: str, k: int, bands: int, rows: int) -> DataFrame:
    """(id, bands) of each row: those of equal rates and, where a shingle repeats, those by weight; none where the text has no word."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = strings(batch.column("text"))
            owner, shingle, times = shingles(texts, k)
            out = bands_of(sketch(owner, shingle, np.ones_like(times), len(texts), bands * rows), bands)
            some = np.flatnonzero(np.bincount(owner, minlength=len(texts)))
            out, of = out[some], some
            uneven = np.unique(owner[times > 1])
            if len(uneven):
                part = np.isin(owner, uneven)
                weighted = bands_of(sketch(np.searchsorted(uneven, owner[part]), shingle[part], times[part], len(uneven), bands * rows), bands)
                out, of = np.concatenate([out, weighted]), np.concatenate([of, uneven])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)) * bands)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out[np.argsort(of, kind="stable")].view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(c) for c in ("h1", "h2")), listed], ["id", "h1", "h2", "bands"])

    keyed = df.select(named(key).alias("id"), F.coalesce(named(text), F.lit("")).alias("text")).withColumn("k", text_key(F.col("text")))
    return keyed.select("id", "text", "k.h1", "k.h2").mapInArrow(run, f"id {kind}, h1 long, h2 long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """The (a, b) whose shingle sets have a Jaccard similarity of at least `least`."""
    kind = dict(pairs.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, np.ndarray] = ("", np.zeros(0, np.uint64))
        for batch in slices(batches, "ta", 1_000_000):
            left, right = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            owner, values, _ = shingles(right, k)
            bounds = np.searchsorted(owner, np.arange(len(right) + 1))
            good = np.zeros(len(left), bool)
            for i, t in enumerate(left):
                if t is not held[0]:
                    held = (t, shingles([t], k)[1]) if t != held[0] else held
                other = values[bounds[i] : bounds[i + 1]]
                same = len(np.intersect1d(held[1], other, assume_unique=True))
                good[i] = reaches(same, len(held[1]) + len(other) - same, least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    full = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return full.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}")


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """(id, s) of (id, text): the hashes of the distinct shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            owner, values, _ = shingles(strings(batch.column("text")), k)
            bounds = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(bounds, pa.array(values.view(np.int64)))], ["id", "s"])

    return texts.select("id", "text").mapInArrow(run, f"id {dict(texts.dtypes)['id']}, s array<long>")


def reaches(same: np.ndarray, whole: np.ndarray, least: float) -> np.ndarray:
    """same / whole >= least without rounding of the quotient; `least` has six digits at most."""
    return (same > 0) & (same * 10**6 >= round(least * 10**6) * whole)


def settled(met: DataFrame, group: DataFrame, texts: DataFrame, k: int, least: float, block: int = 512) -> DataFrame:
    """Links (a, b) that the leaders (lead, id) of `met` leave open: of documents that aren't in their leader's class with all that
    have met this leader. Both sides, as sets of shingle hashes, are dealt into blocks of a fixed size; a pair of blocks is a task's group, which
    returns at most one link of a document to each other class.
    """
    kind = dict(met.dtypes)["id"]
    both = met.union(met.select("lead", F.col("lead").alias("id"))).distinct()
    own = group.select(F.col("node").alias("id"), F.col("component").alias("c"))
    above = group.select(F.col("node").alias("lead"), F.col("component").alias("lc"))
    placed = both.join(own, "id", "left").join(above, "lead", "left").select("lead", "id", F.coalesce("c", "id").alias("c"), F.coalesce("lc", "lead").alias("lc"))
    placed = checkpoint(placed)
    sizes = placed.groupBy("lead").agg(F.ceil(F.count_if(F.col("c") != F.col("lc")) / block).alias("nu"), F.ceil(F.count("*") / block).alias("nm"))
    rows = placed.join(checkpoint(sizes.where("nu > 0")), "lead")
    sets = checkpoint(shingle_sets(texts.join(rows.select("id").distinct(), "id", "left_semi"), k))
    rows = checkpoint(rows.join(sets, "id"))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    open_ = rows.where("c <> lc").select("lead", place("nu").alias("u"), span("nm").alias("m"), F.lit(True).alias("open"), "id", "c", "s")
    all_ = rows.select("lead", span("nu").alias("u"), place("nm").alias("m"), F.lit(False).alias("open"), "id", "c", "s")

    def compare(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        opened, ids, classes = (part.column(c).to_numpy() for c in ("open", "id", "c"))
        listed = part.column("s").combine_chunks()
        bounds = np.concatenate([[0], np.cumsum(np.diff(listed.offsets.to_numpy()))])
        values = np.unique(listed.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1]
        others = np.flatnonzero(~opened & (np.diff(bounds) > 0))
        starts = np.concatenate([[0], np.cumsum(np.diff(bounds)[others])[:-1]]) if len(others) else np.zeros(0, np.int64)
        flat = np.concatenate([values[bounds[i] : bounds[i + 1]] for i in others]) if len(others) else values[:0]
        flags, found = np.zeros(values.max() + 1 if len(values) else 0, np.int64), {}
        for i in np.flatnonzero(opened):
            mine = values[bounds[i] : bounds[i + 1]]
            if not len(mine) or not len(others):
                continue
            flags[mine] = 1
            same = np.add.reduceat(flags[flat], starts)
            flags[mine] = 0
            whole = len(mine) + np.diff(bounds)[others] - same
            for j in others[reaches(same, whole, least) & (classes[others] != classes[i])]:
                found[ids[i], classes[j]] = ids[j]
        pairs = [(min(i, j), max(i, j)) for (i, _), j in found.items()]
        return pa.table({"a": pa.array([p[0] for p in pairs], part.schema.field("id").type), "b": pa.array([p[1] for p in pairs], part.schema.field("id").type)})

    return open_.union(all_).groupBy("lead", "u", "m").applyInArrow(compare, f"a {kind}, b {kind}").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, least: float = 0.8, bands: int = 32, rows: int = 5) -> DataFrame:
    """(id, class_id) per row of `df`; class_id is the smallest id of the documents joined by links, links being pairs of
    texts whose sets of `k`-word shingles (lower-cased, a shorter text being one shingle) have a Jaccard similarity of `least`
    or more, and equal texts. Null texts count as empty; empty texts are equal to each other. A pair at the threshold meets in
    some band of equal rates with probability 1 - (1 - least**rows)**bands, over 0.999996 by default, however often shingles repeat. Rows that share an id are one
    document; if their texts differ, one of them counts, that of the smallest hash. Rows with a null id have no class. Other columns don't pass.
    """
    drawn = checkpoint(sketches(df, key, text, k, bands, rows))
    every = drawn.select("id")
    hashes = drawn.where("id is not null").select("id", F.struct("h1", "h2").alias("h"))
    several = checkpoint(hashes.groupBy("id").agg(F.min("h").alias("first"), F.max("h").alias("last")).where("first <> last").select("id", "first"))
    if several.limit(1).count():
        drawn = checkpoint(drawn.join(several, "id", "left").where("first is null or (first.h1 = h1 and first.h2 = h2)").drop("first"))
    # equal texts: the smallest id stands for all
    same = checkpoint(drawn.where("id is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep")))
    member = drawn.select("id", "h1", "h2").distinct().join(same, ["h1", "h2"]).select(F.col("id").alias("of"), "rep")
    reps = drawn.join(same.select(F.col("rep").alias("id"), "h1", "h2"), ["id", "h1", "h2"], "left_semi")
    bucket = reps.select("id", F.explode("bands").alias("bucket")).distinct()
    lead = checkpoint(bucket.groupBy("bucket").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("bucket", "lead"))
    shared = checkpoint(bucket.join(lead, "bucket"))
    pairs = shared.where("id > lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    wanted = shared.select("id").union(shared.select(F.col("lead").alias("id"))).distinct()
    texts = df.select(named(key).alias("id"), F.coalesce(named(text), F.lit("")).alias("text")).join(wanted, "id")
    if several.limit(1).count():
        texts = texts.withColumn("k", text_key(F.col("text"))).join(several, "id", "left").where("first is null or (first.h1 = k.h1 and first.h2 = k.h2)").select("id", "text")
    texts = checkpoint(texts.dropDuplicates(["id"]))
    links = checkpoint(verified(pairs, texts, k, least))
    group = components(links)
    more = checkpoint(settled(shared.select("lead", "id"), group, texts, k, least))
    if more.limit(1).count():
        group = components(links.union(more))
    found = member.join(group, member["rep"] == group["node"], "left").select("of", F.coalesce("component", "rep").alias("class_id"))
    return every.join(found, every["id"] == found["of"], "left").select("id", "class_id")


def classes(df: DataFrame) -> DataFrame:
    """The result of op6."""
    found = near_duplicates(df.select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))

"""Operator 8: best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Pieces are dealt by a hash into blocks of about `block` pieces; a block is the problem of several islands. An island's
individuals are packings. Crossover injects whole well-filled bins of one parent into another, takes out the bins that hold
the same pieces, and best-fits the displaced ones. After each epoch every island receives its neighbour's best packing. The
best packing of a block's islands is the result. An island stops as soon as no packing can have fewer bins.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import CALL_BYTES, encoder
from .common import checkpoint, named, slices, strings, unused


def pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", most: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every whole text: its ids and then `end_id`, cut only if longer than
    `most`; then every piece but the first is full. A null or empty text is one piece, the end id alone.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in slices(batches, "text", CALL_BYTES):
            owner, rows = [], []
            for i, ids in enumerate(own.ids(strings(batch.column("text")))):
                data = np.append(ids, np.uint32(end_id)).astype("<u4")
                start, piece = 0, 0
                while start < len(data):
                    length = (len(data) % most or most) if start == 0 else most
                    owner.append(i)
                    rows.append((piece, start, length, zlib.crc32(data[start : start + length].tobytes())))
                    start, piece = start + length, piece + 1
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(owner, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(named(key).alias("key"), named(text).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


#: Partitions of an epoch; beyond it a task evolves several islands, one after the other.
MOST_PARTS = 20_000


class Packing:
    """Bins as lists of item numbers, with their room."""

    def __init__(self, bins: list[list[int]], room: list[int]):
        self.bins, self.room = bins, room

    @classmethod
    def of(cls, bin_of: np.ndarray, size: np.ndarray, most: int) -> Packing:
        """From the bin number of each item; numbers without items are left out."""
        order = np.argsort(bin_of, kind="stable")
        bins = [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(bin_of[order])) + 1)] if len(order) else []
        return cls(bins, (most - np.add.reduceat(size[order], np.cumsum([0, *map(len, bins[:-1])]))).tolist() if bins else [])

    def bin_of(self, n: int) -> list[int]:
        out = np.zeros(n, np.int32)
        held, count = laid_out(self.bins)
        out[held] = np.repeat(np.arange(len(count)), count)
        return out.tolist()

    def fitness(self, most: int) -> tuple[int, float]:
        """Fewer bins are better; of equal ones those with more uneven filling, whose emptiest bins are easier to dissolve."""
        return -len(self.bins), float(np.square(1 - np.array(self.room, float) / most).sum())


def longest_first(items: list[int], size: np.ndarray) -> tuple[list[int], list[int]]:
    """The items, longest first and of equal ones the smaller number, and their sizes."""
    at = np.sort(np.array(items, np.int64))
    at = at[np.argsort(-size[at], kind="stable")]
    return at.tolist(), size[at].tolist()


def best_fit(bins: list[list[int]], room: list[int], items: list[int], size: np.ndarray, most: int) -> Packing:
    """Place items, longest first, where the least room is left."""
    free = sorted((r, b) for b, r in enumerate(room) if r)
    items, needs = longest_first(items, size)
    for i, need in zip(items, needs):
        at = bisect_left(free, (need, -1))
        if at < len(free):
            left, b = free.pop(at)
            left -= need
            bins[b].append(i)
        else:
            b, left = len(bins), most - need
            bins.append([i])
            room.append(left)
        room[b] = left
        if left:
            insort(free, (left, b))
    return Packing(bins, room)


def laid_out(bins: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The items of all bins, one bin after the other, and the number of items of each."""
    return np.fromiter(chain.from_iterable(bins), np.int64), np.fromiter(map(len, bins), np.int64, len(bins))


def swapped(bins: list[list[int]], room: list[int], items: list[int], size: np.ndarray, tries: int = 256) -> list[int]:
    """Trade displaced items for smaller ones of bins, which get fuller by it; the smaller ones are displaced instead. Small items are easier to place."""
    if not bins or not items:
        return items
    held, count = laid_out(bins)
    owner = np.repeat(np.arange(len(bins)), count)
    sizes, left = size[held], np.array(room, np.int64)
    out = longest_first(items, size)[0]
    for k in range(min(tries, len(out))):
        gain = int(size[out[k]]) - sizes
        gain[gain > left[owner]] = 0
        at = int(gain.argmax())
        if gain[at] <= 0:
            continue
        b, other = int(owner[at]), int(held[at])
        bins[b][bins[b].index(other)] = out[k]
        left[b] -= gain[at]
        held[at], sizes[at], out[k] = out[k], size[out[k]], other
    room[:] = left.tolist()
    return out


def crossover(first: Packing, second: Packing, size: np.ndarray, most: int, rng: np.random.Generator) -> Packing:
    """A child: a random share of `second`'s well-filled bins, `first`'s bins that share nothing with them; of the rest, the largest are traded for smaller ones, and all are placed by best fit."""
    room = np.array(second.room)
    full = np.flatnonzero(room <= np.quantile(room, 0.8))
    chosen = full[rng.random(len(full)) < rng.uniform(0.2, 0.7)]
    bins, rooms = [list(second.bins[b]) for b in chosen], [int(room[b]) for b in chosen]
    taken = np.zeros(len(size), bool)
    taken[laid_out(bins)[0]] = True
    held, count = laid_out(first.bins)
    taken = taken[held]
    opened = np.logical_or.reduceat(taken, np.cumsum(count) - count)
    opened[np.argsort(first.room)[-2:]] = True  # the emptiest bins of the first parent are dissolved too
    displaced = held[np.repeat(opened, count) & ~taken].tolist()
    kept = np.flatnonzero(~opened).tolist()
    bins += [list(first.bins[k]) for k in kept]
    rooms += [int(first.room[k]) for k in kept]
    return best_fit(bins, rooms, swapped(bins, rooms, displaced, size), size, most)


def evolve(size: np.ndarray, most: int, seed: int, given: list[Packing], population: int, generations: int) -> Packing:
    """The best packing after some generations from the given ones, a best-fit-decreasing one and shuffled variants of it."""
    rng = np.random.default_rng(seed)
    least = -(-int(size.sum()) // most)
    people = given or [best_fit([], [], list(range(len(size))), size, most)]
    while len(people) < population and len(people[0].bins) > least:
        bins, room = people[0].bins, people[0].room
        kept = (rng.random(len(bins)) < 0.5).tolist()
        people.append(best_fit([list(b) for b, k in zip(bins, kept) if k], [r for r, k in zip(room, kept) if k], [i for b, k in zip(bins, kept) if not k for i in b], size, most))
    for _ in range(generations):
        people.sort(key=lambda p: p.fitness(most), reverse=True)
        if len(people[0].bins) <= least:
            break
        half = max(2, len(people) // 2)
        people = people[:half] + [crossover(people[int(rng.integers(half))], people[int(rng.integers(half))], size, most, rng) for _ in range(population - half)]
    return max(people, key=lambda p: p.fitness(most))


def evolved(items: DataFrame, most: int, block: int, islands: int, epochs: int, population: int, generations: int, seed: int) -> tuple[DataFrame, int]:
    """(_row, length, block, bin) of the best packing of each block of (_row, length), and the number of blocks."""
    n_blocks = max(1, -(-items.count() // block))
    deal = F.pmod(F.xxhash64("_row"), F.lit(n_blocks)).alias("block")
    # a block is about `block` items by its making, so a list of them is bounded
    lists = checkpoint(items.select(deal, "_row", "length").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("_row", "length"))).alias("items")))
    state = lists.select("block", "items.length", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(None).cast("array<int>").alias("bin"), F.lit(None).cast("array<int>").alias("guest"))
    kind = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("length", pa.list_(pa.int64())), ("bin", pa.list_(pa.int32())), ("bins", pa.int64()), ("fill", pa.float64())])

    def epoch(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in (r for batch in batches for r in batch.to_pylist()):
                size = np.array(row["length"], np.int64)
                given = [Packing.of(np.array(row[c]), size, most) for c in ("bin", "guest") if row[c] is not None]
                best = evolve(size, most, seed + 1_000_003 * number + 7919 * row["island"] + row["block"], given, population, generations)
                fit = best.fitness(most)
                yield pa.RecordBatch.from_pylist([{"block": row["block"], "island": row["island"], "length": row["length"], "bin": best.bin_of(len(size)), "bins": -fit[0], "fill": fit[1]}], kind)

        return run

    for number in range(epochs):
        ran = checkpoint(state.repartition(min(n_blocks * islands, MOST_PARTS), "block", "island").mapInArrow(epoch(number), "block long, island int, length array<long>, bin array<int>, bins long, fill double"))
        guests = ran.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("bin").alias("guest"))
        state = ran.select("block", "length", "island", "bin").join(guests, ["block", "island"])
    best = ran.groupBy("block").agg(F.min_by("bin", F.struct("bins", -F.col("fill"), "island")).alias("bin"))
    placed = lists.join(best, "block").select("block", F.explode(F.arrays_zip("items", "bin")).alias("x"))
    return checkpoint(placed.select("x.items._row", "x.items.length", "block", "x.bin")), n_blocks


def pack(pieces: DataFrame, most: int = 1024, block: int = 16_384, islands: int = 3, epochs: int = 2, population: int = 6, generations: int = 4, seed: int = 42, loose: int = 32) -> DataFrame:
    """`pieces` (length and others; columns named as the new ones are replaced) with sequence_id and offset: sequences of at most `most`, without gaps. Full pieces have a
    sequence each; rows that repeat have a place each. No rows give no rows. Lengths must be from 1 to `most`. The `loose`
    emptiest bins of each block are opened and their pieces packed again in blocks of their own, until one block is left.
    """
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    row = unused(pieces, "_row")
    pieces = checkpoint(pieces.select(*map(named, own), F.monotonically_increasing_id().alias(row)))
    items, level, placed = pieces.where(F.col("length") < most).select(F.col(row).alias("_row"), "length"), 0, None
    while True:
        found, n_blocks = evolved(items, most, block, islands, epochs, population, generations, seed + level)
        again = None
        if n_blocks > 1:
            emptiest = Window.partitionBy("block").orderBy("fill", "bin")
            bins = found.groupBy("block", "bin").agg(F.sum("length").alias("fill"), F.count("*").alias("n"))
            # at most half of a block, so that every turn leaves fewer blocks
            bins = bins.withColumn("r", F.row_number().over(emptiest)).withColumn("n", F.sum("n").over(emptiest)).where((F.col("r") <= loose) & (F.col("n") <= block // 2))
            again = checkpoint(bins.select("block", "bin"))
            items = found.join(again, ["block", "bin"]).select("_row", "length")
            found = found.join(again, ["block", "bin"], "left_anti")
        numbered = found.select("_row", "length", (F.lit(level << 56) + F.col("block") * (128 * block) + F.col("bin")).alias("sequence_id"))
        placed = numbered if placed is None else placed.unionByName(numbered)
        if again is None:
            break
        level += 1
    before = Window.partitionBy("sequence_id").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("_row", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    part = pieces.where(F.col("length") < most).join(placed.withColumnRenamed("_row", row), row)
    full = pieces.where(F.col("length") >= most).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return part.unionByName(full).select(*map(named, own), "sequence_id", "offset")


def packed(df: DataFrame, path: str, **options) -> DataFrame:
    """The result of op8."""
    return pack(pieces(df, path), **options).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

"""What several operators share: lineage cuts in the shared folder, connected components, Arrow batch slicing, word shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.session import shared_folder, workers_find_library


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return workers_find_library(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of exactly this name, which may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def through(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow for tables whose column names may hold dots."""
    names, plain = df.columns, [f"c{i}" for i in range(len(schema))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(pa.RecordBatch.from_arrays(b.columns, names) for b in batches):
            yield pa.RecordBatch.from_arrays(batch.columns, plain)

    inner = df.toDF(*[f"c{i}" for i in range(len(names))])
    return inner.mapInArrow(renamed, T.StructType([T.StructField(n, f.dataType) for n, f in zip(plain, schema)])).toDF(*schema.names)


def unused(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores behind it as make it no column of `df`."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """128 bits of a text as two seeded 64-bit hashes."""
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of `links`; component is the smallest node reachable.

    Edges point from the larger to the smaller end. Each round hangs a node's smaller neighbours below the smallest
    of them until every node has one parent, then parents are doubled until they are roots. A window holds one node's
    smaller neighbours only, never a hub's larger ones; the doubling joins read checkpoints on both sides, so that
    adaptive execution can split a hub. Self loops and nulls are ignored.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok"))
    edges = checkpoint(edges.where("ok and u > v").select("u", "v").distinct())
    while True:
        hung = edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        more = hung.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nearest = hung.select("u", F.col("m").alias("v"))
        edges = checkpoint(nearest.union(more).distinct())
        if edges.groupBy("u").count().where("count > 1").limit(1).count() == 0:
            break
    while True:
        up = edges.select(F.col("u").alias("v"), F.col("v").alias("w"))
        jumped = edges.join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("moved"))
        jumped = checkpoint(jumped)
        edges = jumped.select("u", "v")
        if jumped.where("moved").limit(1).count() == 0:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of each batch whose texts take about `most` bytes, one row at least, so that long texts don't pile up in a task."""
    for batch in batches:
        sizes = np.array([0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
        group = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)


BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes that are hashed at a time; a piece ends between words, so only a longer word makes a longer one.
PIECE = 1 << 20
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + (PIECE >> 2))
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, x, np.uint64))]) for x in (BASE, BASE_INVERSE)]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (runs without ASCII white space) of all texts, and the index of each word's text. Beside the texts
    themselves it takes 16 bytes a word and some 60 MB for a piece, however long a text is.
    """
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends_of = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    hashes, owner, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not (data[end - 1] == 32 or 9 <= data[end - 1] <= 13):
            end += 1
        part = data[at:end]
        blank = (part == 32) | ((part >= 9) & (part <= 13))
        word = np.concatenate([[False], ~blank])
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[0::2], edges[1::2]
        power, inverse = _powers(len(part) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)])])
        hashes.append(mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))
        owner.append(np.searchsorted(ends_of, starts + at, side="right"))
        at = end
    return np.concatenate(hashes), np.concatenate(owner)


def shingles(texts: list[str], k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle hash, times) of the distinct k-word shingles of each text; a shorter text is one shingle of all its words, an empty one has none."""
    hashes, owner = word_hashes(texts)
    n = len(hashes)
    ids, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n >= k:
        rolled = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            rolled = rolled * BASE + hashes[j : n - k + 1 + j]
        whole = owner[: n - k + 1] == owner[k - 1 :]
        ids, values = owner[: n - k + 1][whole], mix(rolled[whole])
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)])
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        rolled = np.zeros(1, np.uint64)
        for h in hashes[first[i] : first[i + 1]]:
            rolled = rolled * BASE + h
        ids, values = np.append(ids, i), np.append(values, mix(rolled + np.uint64(counts[i])))
    order = np.lexsort((values, ids))
    ids, values = ids[order], values[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (values[1:] != values[:-1])
    at = np.flatnonzero(new)
    return ids[at], values[at], np.diff(np.append(at, len(ids)))

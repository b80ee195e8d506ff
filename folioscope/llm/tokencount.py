"""Operator 2: token counts of whole texts, huge ones by overlapping chunks that are spliced where both sides agree.

A pre-token boundary p that two overlapping chunks both find, at least MARGIN characters inside each of them, is one of the
whole text: the pattern's matches depend on what follows them by two characters at most, no special token is longer than the
margin, and from a common boundary on both chunks are split alike. Tokens never cross a pre-token, so the counts on either
side of p add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder, load
from .common import checkpoint, named, slices, strings

MARGIN = 16


def counts(df: DataFrame, path: str) -> DataFrame:
    """(key, n_tokens) of the texts in (key, text), each encoded in one call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in slices(batches, "text"):
            n = [len(x) for x in own.ids(strings(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64())], ["key", "n_tokens"])

    return df.select("key", "text").mapInArrow(run, f"key {df.schema['key'].dataType.simpleString()}, n_tokens long")


def boundaries(library, text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Characters at which a pre-token starts, the tokens before each, and the number of tokens."""
    coded = library.encode(text, add_special_tokens=False)
    words = np.array([-1 if w is None else w for w in coded.word_ids], np.int64)
    starts = np.array([o[0] for o in coded.offsets], np.int64)
    at = np.flatnonzero((words[1:] != words[:-1]) & (words[1:] >= 0) & (words[:-1] >= 0)) + 1
    return starts[at], at, len(words)


def chunks(df: DataFrame, chunk: int, overlap: int, at_once: int = 64) -> DataFrame:
    """(key, i, start, text, last) of (key, text): pieces of `chunk` characters with `overlap` more on both sides, each text in one pass."""
    kind = df.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1):
            text = batch.column("text")[0].as_py()
            n = -(-len(text) // chunk)
            for first in range(0, n, at_once):
                number = range(first, min(n, first + at_once))
                starts = [max(0, i * chunk - overlap) for i in number]
                parts = [text[s : (i + 1) * chunk + overlap] for s, i in zip(starts, number)]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array([0] * len(parts))), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(parts, pa.string()), pa.array([i == n - 1 for i in number])], ["key", "i", "start", "text", "last"])

    return df.select("key", "text").mapInArrow(run, f"key {kind}, i int, start long, text string, last boolean")


def spliced(df: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of (key, text) by chunks of `chunk` characters, each with `overlap` more on both sides; null where some seam has no common boundary."""
    kind = df.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = load(path)
        for batch in slices(batches, "text"):
            rows = []
            for i, start, text in zip(*(batch.column(c).to_pylist() for c in ("i", "start", "text"))):
                at, before, n = boundaries(library, text)
                inside = (at >= MARGIN) & (at <= len(text) - MARGIN)
                at, before = at[inside] + start, before[inside]
                left, right = np.abs(at - i * chunk) <= overlap, np.abs(at - (i + 1) * chunk) <= overlap
                rows.append({"n": n, "left": at[left].tolist(), "left_n": before[left].tolist(), "right": at[right].tolist(), "right_n": before[right].tolist()})
            found = pa.Table.from_pylist(rows, pa.schema([("n", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("left", "left_n", "right", "right_n"))])).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("i"), batch.column("last"), *found.columns], ["key", "i", "last", *found.schema.names])

    found = chunks(df, chunk, overlap).repartition("key", "i").mapInArrow(run, f"key {kind}, i int, last boolean, n long, left array<long>, left_n array<long>, right array<long>, right_n array<long>")
    before = Window.partitionBy("key").orderBy("i")
    seam = found.withColumn("prior", F.lag("right").over(before)).withColumn("prior_n", F.lag("right_n").over(before))
    seam = seam.withColumn("p", F.get(F.array_intersect("prior", "left"), F.lit(0)))
    at = lambda where, n: F.get(F.col(n), F.array_position(F.col(where), F.col("p")).cast("int") - 1)
    seam = seam.withColumn("part", F.when(F.col("i") == 0, F.lit(0)).otherwise(at("prior", "prior_n") - at("left", "left_n")))
    whole = F.bool_and(F.col("part").isNotNull())
    return seam.groupBy("key").agg(F.when(whole, F.sum("part") + F.sum(F.when(F.col("last"), F.col("n")).otherwise(0))).alias("n_tokens"))


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512, chunk: int = 24_576, overlap: int = 256) -> DataFrame:
    """Per row of `df`: `key`, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). Null texts count as empty: 0 bytes,
    0 tokens. Special strings in texts are read as the library reads them by default. Texts of over 2 * `chunk` characters
    are cut into chunks that all machines share; where a seam shows no common boundary the overlap grows eightfold, and a text
    that no overlap below `chunk` aligns (one without any boundary) is encoded in one call. Rows that repeat are counted each;
    other columns don't pass.
    """
    base = df.select(named(key).alias("key"), F.coalesce(named(text), F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long")
    short = counts(base.where(F.length("text") <= 2 * chunk).select(F.struct("key", size.alias("n_bytes")).alias("key"), "text"), path).select("key.key", "key.n_bytes", "n_tokens")
    # the same text needs one count: copies of a huge document are counted once and joined by its hash
    long = base.where(F.length("text") > 2 * chunk).select("key", size.alias("n_bytes"), F.sha2("text", 256).alias("hash"))
    texts = base.where(F.length("text") > 2 * chunk).select(F.sha2("text", 256).alias("key"), "text")
    todo, done = checkpoint(texts.groupBy("key").agg(F.first("text").alias("text"))), None
    while overlap < chunk:
        found = checkpoint(spliced(todo, path, chunk, overlap))
        good = found.where("n_tokens is not null")
        done = good if done is None else done.union(good)
        todo = todo.join(found.where("n_tokens is null").select("key"), "key", "left_semi")
        if found.where("n_tokens is null").limit(1).count() == 0:
            break
        overlap *= 8
    else:
        rest = counts(todo, path)
        done = rest if done is None else done.union(rest)
    long = long.join(done.withColumnRenamed("key", "hash"), "hash").select("key", "n_bytes", "n_tokens")
    return short.union(long).select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

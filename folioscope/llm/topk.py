"""Operator 10: exact top-k inner products by the three-phase uniform threshold algorithm.

A node is a group of dimensions; it holds that part of all vectors, in blocks of rows, and no task sees two nodes. A node's entry
for a query and a candidate is the inner product of its parts; the entries of all nodes add up to the score.

Phase 1: each node lists its largest entries for each query. The candidates that some list names are looked up; the k-th best of
their scores is the cutoff, which the k-th best score of all can't be below.
Phase 2: a score of at least the cutoff needs one entry of cutoff / nodes or more. Each node sends these. A candidate that all
nodes have sent is complete; the k-th best of these raises the cutoff if it can.
Phase 3: an entry that was not sent is below the first cutoff / nodes. Candidates whose score could still reach the cutoff by this
bound are asked for at the nodes that have not sent them; the others are out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, named

#: Totals of this size and more leave no room in 64 bits for the sums of the phases; entries are decimals of 38 digits then.
ROOM, WIDE = 1 << 59, 10**38


def entry_kind(wide: bool) -> pa.DataType:
    return pa.decimal128(38, 0) if wide else pa.int64()


def entry_sql(wide: bool) -> str:
    return f"query_id long, id long, node int, part {'decimal(38,0)' if wide else 'long'}"


def whole_numbers(df: DataFrame, scale: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): floor(scale * x) of each component x, which fails the job where it leaves 64 bits; rows whose id or vector is null, or that hold null or non-finite components, are left out."""
    x = named(vector).cast("array<double>")
    bad = lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))
    good = df.where(named(key).isNotNull() & named(vector).isNotNull()).select(named(key).alias("id"), x.alias("x"), F.exists(x, bad).alias("bad")).where(~F.col("bad"))
    fits = lambda y: F.when(F.abs(y * scale) < float(1 << 63), F.floor(y * scale).cast("long")).otherwise(F.raise_error(F.lit("a component leaves 64 bits")).cast("long"))
    return good.select("id", F.transform("x", fits).alias("v"))


def matrix(column: pa.ListArray, width: int, wide: bool) -> np.ndarray:
    """Rows of equal length; shorter ones are padded with zeros, which change no product. Wide ones are Python's integers, which know no bound."""
    flat, bounds = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    size = np.diff(bounds)
    out = np.zeros((len(column), width), object if wide else np.int64)
    out[np.repeat(np.arange(len(column)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = flat[bounds[0] : bounds[-1]]
    return out


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left times right transposed in 64-bit integers, or in Python's; by doubles where they hold every sum exactly."""
    if left.dtype == object:
        return left @ right.T
    most = lambda x: int(np.abs(x).max(initial=0))
    if most(left) * most(right) * left.shape[1] < 1 << 53:
        return (left.astype(float) @ right.T.astype(float)).astype(np.int64)
    return left @ right.T


class Block:
    """A node's parts of a block of queries and a block of candidates; ids are in order."""

    def __init__(self, batch: pa.RecordBatch, i: int, width: int, wide: bool):
        column = lambda name: batch.column(name)[i].values
        self.node = batch.column("node")[i].as_py()
        self.query, self.own = (column(f"{x}_id").to_numpy(zero_copy_only=False) for x in "qc")
        self.left, self.right = (matrix(column(f"{x}_v"), width, wide) for x in "qc")
        self.kind = entry_kind(wide)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The products, and which of them are no vector's with itself."""
        return product(self.left, self.right), self.query[:, None] != self.own[None, :]

    def rows(self, a: np.ndarray, b: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.query[a]), pa.array(self.own[b]), pa.array(np.full(len(a), self.node, np.int32)), pa.array(list(map(Decimal, part)) if self.left.dtype == object else part, self.kind)], ["query_id", "id", "node", "part"])


def over_blocks(df: DataFrame, width: int, wide: bool, of: Callable[[Block, pa.RecordBatch, int], pa.RecordBatch]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield of(Block(batch, i, width, wide), batch, i)

    return df.mapInArrow(run, entry_sql(wide))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, nodes: int = 2, listed: int = 80, block: int = 2048, query_block: int = 512) -> DataFrame:
    """(query_id, rank, id, score): for each query the `k` candidates of the largest integer inner product, ties to the
    smaller id, without the query's own id. Both sides are (id long, v array<long>); rows that repeat an id count once, by the largest
    vector; null ids and null vectors take no part; missing components are 0. Fewer candidates give fewer rows, none give none, whatever
    the scores. Every score is exact: where the largest components could bring a total near 64 bits, entries and totals are decimals of 38
    digits, made from Python's integers; a result that is no long fails the job, as do totals that 38 digits can't hold.
    `listed` is the length of a node's list in phase 1, `k` at least.

    The queries meet the candidates in blocks of a fixed size; no task and no broadcast grows with the data.
    """
    sides = [checkpoint(x.where("id is not null and v is not null").groupBy("id").agg(F.max("v").alias("v"))) for x in (queries, candidates)]
    # the largest component either way, as a decimal: the smallest long has no positive counterpart
    largest_part = F.max(F.array_max(F.transform("v", lambda y: F.abs(F.coalesce(y, F.lit(0)).cast("decimal(20,0)")))))
    (n_queries, query_dims, query_most), (n, dims, most_part) = (x.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(largest_part, F.lit(0))).first() for x in sides)
    dims, listed = max(dims, query_dims, 1), max(k, listed)
    nodes = min(nodes, dims)
    total = int(query_most) * int(most_part) * dims * (nodes + 1)
    if total >= WIDE:
        raise OverflowError(f"totals of up to {total} can't be told apart in 38 digits")
    wide = total >= ROOM
    whole = "decimal(38,0)" if wide else "long"
    queries, candidates = (x.select("id", F.transform("v", lambda y: F.coalesce(y, F.lit(0))).alias("v")) for x in sides)
    n_blocks, n_query_blocks = max(1, -(-n // block)), max(1, -(-n_queries // query_block))
    cuts = np.linspace(0, dims, nodes + 1).astype(int).tolist()
    width = max(e - s for s, e in zip(cuts, cuts[1:]))
    deal = {"q": lambda x: F.pmod(F.xxhash64(x), F.lit(n_query_blocks)), "c": lambda x: F.pmod(F.xxhash64(x), F.lit(n_blocks))}

    def parts(df: DataFrame, name: str) -> DataFrame:
        """A row for each node and block: the ids in order and that node's parts of their vectors."""
        split = df.select(deal[name]("id").alias(name), "id", F.posexplode(F.array(*[F.slice("v", s + 1, e - s) for s, e in zip(cuts, cuts[1:])])).alias("node", "part"))
        rows = split.groupBy("node", name).agg(F.array_sort(F.collect_list(F.struct("id", "part"))).alias("x"))  # of a fixed size
        return rows.select("node", name, F.col("x.id").alias(f"{name}_id"), F.col("x.part").alias(f"{name}_v"))

    spread = min(n_blocks * n_query_blocks * nodes, 100_000)
    query_parts = checkpoint(parts(queries, "q").withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))))
    met = query_parts.join(checkpoint(parts(candidates, "c")), ["node", "c"])

    def best(entries: DataFrame, by: list[str], score: str, most: int) -> DataFrame:
        return entries.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "id"))).where(F.col("r") <= most)

    # phase 1
    def largest(x: Block, batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
        entry, other = x.entries()
        masked = np.where(other, entry, -WIDE if wide else np.iinfo(np.int64).min + 1)
        picked = np.zeros(entry.shape, bool)
        np.put_along_axis(picked, np.argpartition(-masked, min(listed, len(x.own)) - 1, axis=1)[:, :listed], True, 1)
        a, b = np.nonzero(picked & other)
        return x.rows(a, b, entry[a, b])

    lists = best(over_blocks(met.repartition(spread, "node", "q", "c"), width, wide, largest), ["query_id", "node"], "part", listed)
    looked_up = lists.select("query_id", "id").distinct().join(candidates, "id").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id")
    number = "decimal(19,0)" if wide else "long"
    score = F.aggregate(F.zip_with("v", "qv", lambda x, y: F.coalesce(x.cast(number) * y.cast(number), F.lit(0)).cast(whole)), F.lit(0).cast(whole), lambda s, x: (s + x).cast(whole))
    known = best(looked_up.select("query_id", "id", score.alias("score")), ["query_id"], "score", k)
    # no cutoff where fewer than k candidates are known: then every entry is sent
    cutoff = checkpoint(known.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).select("query_id", F.when(F.col("n") >= k, F.col("low")).alias("cut")))

    # phase 2: a block of queries takes its cutoffs along
    taken = cutoff.groupBy(deal["q"]("query_id").alias("q")).agg(F.array_sort(F.collect_list(F.struct("query_id", "cut"))).alias("cuts"))
    asked = met.join(taken, "q")

    def large(x: Block, batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, Callable[[np.ndarray, np.ndarray], np.ndarray]]:
        """Which queries have candidates, and whether an entry of a query is sent."""
        ids, cut = batch.column("cuts")[i].values.flatten()
        at = np.searchsorted(x.query, ids.to_numpy(zero_copy_only=False))
        some, all_, limit = np.zeros(len(x.query), bool), np.zeros(len(x.query), bool), np.zeros(len(x.query), object if wide else np.int64)
        cuts = np.array([int(c or 0) for c in cut.to_pylist()], limit.dtype)
        some[at], all_[at], limit[at] = True, cut.is_null().to_numpy(zero_copy_only=False), cuts
        least = -(-limit // nodes)  # an entry is cutoff / nodes or more if and only if it is this or more
        return some, lambda entry, a: all_[a] | (entry >= least[a])

    def sent(x: Block, batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
        entry, other = x.entries()
        some, is_large = large(x, batch, i)
        a, b = np.nonzero(is_large(entry, np.arange(len(x.query))[:, None]) & other & some[:, None])
        return x.rows(a, b, entry[a, b])

    entries = over_blocks(asked.repartition(spread, "node", "q", "c"), width, wide, sent)
    seen = checkpoint(entries.groupBy("query_id", "id").agg(F.sum("part").cast(whole).alias("score"), F.count("*").alias("parts")))
    complete = seen.where(F.col("parts") == nodes)
    raised = best(complete, ["query_id"], "score", k).groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(F.col("n") >= k).select("query_id", "low")
    limits = cutoff.join(raised, "query_id", "left").select("query_id", "cut", F.greatest("cut", "low").alias("last"))

    # phase 3
    missing: Column = nodes - F.col("parts")
    # what was not sent is below cut / nodes; both sides times the nodes. Without a cutoff everything was sent
    reaches = (nodes * F.col("score") + missing * F.col("cut")).cast(whole) >= (nodes * F.col("last")).cast(whole)
    open_ = seen.where(missing > 0).join(limits, "query_id").where(reaches).select("query_id", "id", "score")
    open_ = checkpoint(open_)
    wanted = open_.groupBy(deal["q"]("query_id").alias("q"), deal["c"]("id").alias("c")).agg(F.collect_list("query_id").alias("w_query"), F.collect_list("id").alias("w_id"))  # of a fixed size

    def resolved(x: Block, batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
        a, b = (np.searchsorted(ids, batch.column(w)[i].values.to_numpy(zero_copy_only=False)) for ids, w in ((x.query, "w_query"), (x.own, "w_id")))
        part = np.concatenate([np.zeros(0, np.int64), *((x.left[a[p]] * x.right[b[p]]).sum(axis=1) for p in np.array_split(np.arange(len(a)), 1 + len(a) // 65_536))])
        some, is_large = large(x, batch, i)
        rest = ~is_large(part, a)
        return x.rows(a[rest], b[rest], part[rest])

    answers = over_blocks(asked.join(wanted, ["q", "c"]), width, wide, resolved).select("query_id", "id", F.col("part").alias("score"))
    exact = open_.unionByName(answers).groupBy("query_id", "id").agg(F.sum("score").cast(whole).alias("score"))
    found = best(complete.select("query_id", "id", "score").unionByName(exact), ["query_id"], "score", k)
    result = F.col("score")
    if wide:
        fits = (result >= F.lit(-(1 << 63)).cast(whole)) & (result <= F.lit((1 << 63) - 1).cast(whole))
        result = F.when(fits, result.cast("long")).otherwise(F.raise_error(F.concat(F.lit("a score leaves 64 bits: "), result.cast("string"))).cast("long"))
    return found.select("query_id", F.col("r").cast("int").alias("rank"), "id", result.alias("score"))


def nearest(df: DataFrame) -> DataFrame:
    """The result of op10."""
    rows = whole_numbers(df, 1024)
    return top_k(rows.where("id % 100 = 0"), rows).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10
"""

"""Operator 9: near-duplicate vectors by hierarchical navigable small-world graphs, one per shard of a label.

Vectors are compared within their label; equal ones are one vector that counts as often as it occurs. A label is dealt by a hash into shards of about `shard` vectors; each shard gets a
graph. Every shard's vectors are searched in every shard of the label, for a pair of shards in both directions. A vector
whose beam is full of links searches again with a beam of twice the width; one that fills its beam and whose next is an eighth of
the shard or more is compared with all of it. An audit compares vectors picked by a hash with
all vectors of the other shard; as long as it finds a link that the search has missed, all beams start from twice the width. Links are checked by their exact cosine. A task returns link counts and, for the components, a pair for each linked vector instead of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, components, mix, named


FIRST_WIDTH = 48


class Graph:
    """Neighbour lists by level; level 0 holds all vectors. Vectors are of length 1."""

    def __init__(self, x: np.ndarray, levels: list[np.ndarray], entry: int):
        self.x, self.levels, self.entry = x, levels, entry


def beam(graph: Graph, queries: np.ndarray, width: int, level: int, entries: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search for all queries in step: (similarity, vector) of the `width` best that each has met, best first; -1 where there are fewer."""
    m, links = len(queries), graph.levels[level]
    seen = np.zeros((m, size), bool)
    who = np.full((m, width), -1, np.int64)
    near = np.full((m, width), -np.inf)
    open_ = np.zeros((m, width), bool)
    rows = np.arange(m)
    who[:, 0], near[:, 0], open_[:, 0] = entries, np.einsum("ij,ij->i", queries, graph.x[entries]), True
    seen[rows, entries] = True
    live = rows
    while len(live):
        score = np.where(open_[live], near[live], -np.inf)
        at = score.argmax(axis=1)
        go = score[np.arange(len(live)), at] > -np.inf
        live, at = live[go], at[go]
        if not len(live):
            break
        open_[live, at] = False
        around = links[who[live, at]]
        fresh = (around >= 0) & (around < size)
        fresh &= ~seen[live[:, None], np.where(fresh, around, 0)]
        a, b = np.nonzero(fresh)
        seen[live[a], around[a, b]] = True
        value = np.full(around.shape, -np.inf)
        value[a, b] = np.einsum("ij,ij->i", queries[live[a]], graph.x[around[a, b]])
        all_near = np.concatenate([near[live], value], axis=1)
        all_who = np.concatenate([who[live], around], axis=1)
        all_open = np.concatenate([open_[live], value > -np.inf], axis=1)
        best = np.argsort(-all_near, axis=1, kind="stable")[:, :width]
        near[live] = np.take_along_axis(all_near, best, 1)
        who[live] = np.where(near[live] > -np.inf, np.take_along_axis(all_who, best, 1), -1)
        open_[live] = np.take_along_axis(all_open, best, 1)
    return near, who


def descend(graph: Graph, queries: np.ndarray, size: int) -> np.ndarray:
    entries = np.full(len(queries), graph.entry)
    for level in range(len(graph.levels) - 1, 0, -1):
        entries = beam(graph, queries, 1, level, entries, size)[1][:, 0]
    return entries


def build(x: np.ndarray, names: np.ndarray, links: int = 16, width: int = 48) -> Graph:
    """Insert vectors in growing batches: each batch searches the graph so far, and links to the nearest it has found there and in the batch."""
    n = len(x)
    draw = (mix(names.astype(np.uint64)) >> np.uint64(11)).astype(float) / (1 << 53)
    height = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(links)).astype(int), 4)
    if n:
        height[0] = height.max()
    levels = [np.full((n, 2 * links if level == 0 else links), -1, np.int64) for level in range((height.max() if n else 0) + 1)]
    graph = Graph(x, levels, 0)
    done = min(n, 1)
    while done < n:
        end = min(n, done + max(1, min(done, 512)))
        batch = np.arange(done, end)
        inner = x[batch] @ x[batch].T
        np.fill_diagonal(inner, -np.inf)
        entries = np.zeros(len(batch), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            here = height[batch] >= level
            near, who = beam(graph, x[batch], width if here.any() else 1, level, entries, done)
            entries = np.where(who[:, 0] >= 0, who[:, 0], entries)
            if not here.any():
                continue
            mates = np.where(here[None, :], inner, -np.inf)
            picked = np.argsort(-mates, axis=1, kind="stable")[:, : min(links, len(batch))]
            all_near = np.concatenate([near, np.take_along_axis(mates, picked, 1)], axis=1)
            all_who = np.concatenate([who, batch[picked]], axis=1)
            order = np.argsort(-all_near, axis=1, kind="stable")
            all_near, all_who = np.take_along_axis(all_near, order, 1), np.take_along_axis(all_who, order, 1)
            for i in np.flatnonzero(here):
                connect(graph, level, int(batch[i]), all_who[i][all_near[i] > -np.inf], links)
        done = end
    return graph


def connect(graph: Graph, level: int, new: int, found: np.ndarray, links: int) -> None:
    """Link `new` both ways to diverse ones of those found, nearest first; a full list keeps its diverse nearest."""
    table, x = graph.levels[level], graph.x
    chosen = diverse(x, new, found, links)
    table[new, : len(chosen)] = chosen
    for other in chosen:
        row = table[other]
        free = np.flatnonzero(row < 0)
        if new in row:
            continue
        if len(free):
            row[free[0]] = new
        else:
            options = np.append(row, new)
            options = options[np.argsort(-(x[options] @ x[other]), kind="stable")]
            kept = diverse(x, int(other), options, len(row))
            row[:] = -1
            row[: len(kept)] = kept


def diverse(x: np.ndarray, of: int, options: np.ndarray, most: int) -> np.ndarray:
    """Options, nearest first, that are nearer to `of` than to each one taken before; places left go to the nearest of the others."""
    options = options[options != of][: 3 * most]
    if len(options) <= most:
        return options
    to, between = x[options] @ x[of], x[options] @ x[options].T
    taken: list[int] = []
    for i in range(len(options)):
        if len(taken) < most and (not taken or between[i, taken].max() < to[i]):
            taken.append(i)
    rest = [i for i in range(len(options)) if i not in set(taken)]
    return options[sorted(taken + rest[: most - len(taken)])]


def search_links(graph: Graph, queries: np.ndarray, least: float, width: int, audit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) of the pairs of similarity `least` or more; `audit` picks the queries that are compared with all."""
    n, slack = len(graph.x), 1e-9
    truth = (queries[audit] @ graph.x.T >= least).sum(axis=1)
    while True:
        pairs, todo, wide, full_before = [], np.arange(len(queries)), min(width, n), False
        while len(todo):
            again = []
            for part in np.array_split(todo, max(1, len(todo) * max(n, 64 * wide) // 8_000_000)):
                # a vector that fills its beam and whose next one is an eighth of the shard has so many links that all of the shard costs less
                if wide >= n or (full_before and 8 * wide >= n):
                    a, b = np.nonzero(queries[part] @ graph.x.T >= least - slack)
                    pairs.append((part[a], b))
                    continue
                near, who = beam(graph, queries[part], wide, 0, descend(graph, queries[part], n), n)
                full = near[:, -1] >= least - slack
                a, b = np.nonzero((near >= least - slack) & ~full[:, None])
                pairs.append((part[a], who[a, b]))
                again.append(part[full])
            todo, wide, full_before = np.concatenate([np.zeros(0, np.int64), *again]), min(2 * wide, n), True
        a, b = (np.concatenate(p) for p in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        if (np.bincount(a, minlength=len(queries))[audit] >= truth).all() or width >= n:
            return a, b
        width *= 2


def forest(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (member, smallest position) of ids that join what the links between positions join."""
    parent = np.arange(len(ids))
    while True:  # hooking and doubling over whole arrays
        pa_, pb = parent[a], parent[b]
        open_ = pa_ != pb
        if not open_.any():
            break
        np.minimum.at(parent, np.maximum(pa_, pb)[open_], np.minimum(pa_, pb)[open_])
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return [(int(ids[i]), int(ids[p])) for i, p in enumerate(parent) if i != p]


def linkable(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, g, x, h1, h2) of the vectors that may have links: label and length, components, and a hash that equal vectors of a label share.
    An id that repeats counts once, with the greatest of its rows.
    """
    x = named(vector).cast("array<double>")
    bad = lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))
    rows = df.where(named(key).isNotNull() & named(label).isNotNull() & named(vector).isNotNull()).select(named(key).alias("id"), F.struct(named(label).alias("label"), F.size(named(vector)).alias("dims")).alias("g"), x.alias("x"), F.exists(x, bad).alias("bad"))
    rows = rows.where(~F.col("bad") & F.exists("x", lambda y: y != 0)).groupBy("id").agg(F.max(F.struct("g", "x")).alias("v"))
    return checkpoint(rows.select("id", "v.g", "v.x", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2")))


def vector_links(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, shard: int = 4096, width: int = FIRST_WIDTH, audit_share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(id, n_links) of the ids with links, and pairs (a, b) within components that join all linked ids. Vectors link if
    their labels are equal and not null and their cosine is `least` or more. Vectors that are null, zero, or hold null or
    non-finite components have no links; vectors of different length have none with each other. An id that repeats counts once.
    """
    every = linkable(df, key, vector, label)
    rows = checkpoint(every.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("g").alias("g"), F.first("x").alias("x")))
    member = every.select("id", "h1", "h2").join(rows.select("h1", "h2", F.col("id").alias("rep"), "copies"), ["h1", "h2"]).select("id", "rep", "copies")
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / shard).alias("shards"))
    dealt = rows.join(sizes, "g").select("g", "shards", F.pmod(F.xxhash64("id"), F.col("shards")).alias("s"), "id", "copies", "x")
    packed = dealt.groupBy("g", "s", "shards").agg(F.array_sort(F.collect_list(F.struct("id", "copies", "x"))).alias("v"))  # of about `shard` rows
    packed = packed.select("g", "s", "shards", F.col("v.id").alias("ids"), F.col("v.copies").alias("copies"), F.flatten("v.x").alias("flat"))

    def unit(ids: list, flat: np.ndarray) -> np.ndarray:
        out = flat.reshape(len(ids), -1)
        out = out / np.abs(out).max(axis=1, keepdims=True)
        return out / np.sqrt((out * out).sum(axis=1, keepdims=True))

    def graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                ids = one.column("ids")[0].values.to_numpy(zero_copy_only=False)
                graph = build(unit(ids, one.column("flat")[0].values.to_numpy(zero_copy_only=False)), ids)
                blob = pa.array([[t.astype("<i4").tobytes() for t in graph.levels]], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([*one.columns, blob], [*one.schema.names, "levels"])

    built = checkpoint(packed.mapInArrow(graphs, T.StructType([*packed.schema, T.StructField("levels", T.ArrayType(T.BinaryType()))])))
    side = lambda t: built.select("g", F.col("s").alias(t), F.col("ids").alias(f"ids_{t}"), F.col("copies").alias(f"copies_{t}"), F.col("flat").alias(f"flat_{t}"), F.col("levels").alias(f"levels_{t}"))
    met = built.select("g", "s", F.explode(F.sequence(F.col("s"), F.col("shards") - 1)).alias("t")).join(side("s"), ["g", "s"]).join(side("t"), ["g", "t"]).repartition("g", "s", "t")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = []
                for t in "st":
                    ids = batch.column(f"ids_{t}")[i].values.to_numpy(zero_copy_only=False)
                    v = unit(ids, batch.column(f"flat_{t}")[i].values.to_numpy(zero_copy_only=False))
                    levels = [np.frombuffer(b, "<i4").reshape(len(ids), -1).astype(np.int64) for b in batch.column(f"levels_{t}")[i].as_py()]
                    sides.append((ids, Graph(v, levels, 0), batch.column(f"flat_{t}")[i].values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)))
                own = batch.column("s")[i].as_py() == batch.column("t")[i].as_py()
                pairs = set_of_links(sides, own, least, width, audit_share)
                a, b = pairs
                (ids_s, _, _), (ids_t, _, _) = sides
                ids = ids_s if own else np.concatenate([ids_s, ids_t])
                if not own:
                    b = b + len(ids_s)
                times = np.concatenate([batch.column(f"copies_{t}")[i].values.to_numpy(zero_copy_only=False) for t in ("s" if own else "st")])
                n = np.zeros(len(ids), np.int64)
                np.add.at(n, a, times[b])
                np.add.at(n, b, times[a])
                some = np.flatnonzero(n)
                tree = forest(a, b, ids)
                yield pa.RecordBatch.from_pydict({"id": [*ids[some].tolist(), *[t[0] for t in tree]], "other": [*[None] * len(some), *[t[1] for t in tree]], "n": [*n[some].tolist(), *[0] * len(tree)]}, pa.schema([("id", pa.int64()), ("other", pa.int64()), ("n", pa.int64())]))

    found = checkpoint(met.mapInArrow(search, "id long, other long, n long"))
    counts = found.where("other is null").groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    n_links = F.coalesce("n", F.lit(0)) + F.col("copies") - 1
    counts = member.join(counts, "rep", "left").select("id", n_links.alias("n_links")).where("n_links > 0")
    copies = member.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    return counts, found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")).union(copies)


def set_of_links(sides: list[tuple], own: bool, least: float, width: int, audit_share: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct links (position in the first shard, position in the second) found from either side, by exact cosine."""
    (ids_s, graph_s, raw_s), (ids_t, graph_t, raw_t) = sides
    codes = []
    for queries, target, turn in ((graph_s.x, graph_t, False), *([] if own else [(graph_t.x, graph_s, True)])):
        names = (ids_t if turn else ids_s).astype(np.uint64)
        audit = np.flatnonzero((mix(names) >> np.uint64(11)).astype(float) / (1 << 53) < audit_share)
        q, v = search_links(target, queries, least, width, audit)
        codes.append(v * len(ids_t) + q if turn else q * len(ids_t) + v)
    code = np.unique(np.concatenate(codes))
    a, b = code // max(1, len(ids_t)), code % max(1, len(ids_t))
    if own:
        low, high = np.minimum(a, b), np.maximum(a, b)
        code = np.unique((low * len(ids_t) + high)[low < high])
        a, b = code // max(1, len(ids_t)), code % max(1, len(ids_t))
    keep = []
    for part in np.array_split(np.arange(len(a)), max(1, len(a) // 200_000)):
        p, q = (x / np.abs(x).max(axis=1, keepdims=True) for x in (raw_s[a[part]], raw_t[b[part]]))  # no square leaves the doubles
        keep.append((p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1))) >= least)
    good = np.concatenate(keep) if len(a) else np.zeros(0, bool)
    return a[good], b[good]


def near_vectors(df: DataFrame) -> DataFrame:
    """The result of op9: one row per row of `embeddings`; rows that repeat an id have that id's result each, null ids no links."""
    counts, links = vector_links(df)
    group = components(links)
    out = df.select("vec_id").join(counts, F.col("vec_id") == F.col("id"), "left").join(group, F.col("vec_id") == F.col("node"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept"))


SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y)), true)
    AND list_contains(list_transform(embedding, lambda y: y <> 0), true)),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, component_id, component_id = e.vec_id AS kept
FROM embeddings e JOIN least USING (vec_id)
"""

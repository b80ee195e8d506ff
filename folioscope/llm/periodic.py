"""Operator 13: runs of words that repeat with a period, found by recursive frequency splitting and a scan of lags.

Every word of a run occurs in it twice at least. A word that occurs once in a segment therefore belongs to no run there and
splits the segment; this goes on with the parts, in which words are rarer, until no segment changes. What survives is scanned lag
by lag: a run of period q matches itself, shifted by q, over need = max(least - q, q) words in a row at least, so it holds
one of the blocks of t = ceil(need / 2) words that begin at multiples of t. One probe a block, m / t blocks a lag: a segment
of m words takes some 2 m ln m probes instead of m squared. A block that matches is extended to both sides by
bisection over sums of powers, and all runs are compared word by word in the end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, mix, named, slices, strings, through

LEAST = 12
PROBES = 1 << 20


def surviving(code: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the segments in which every word occurs twice or more. Segments of under `least` words are none."""
    sizes = np.diff(bounds)
    pos = np.flatnonzero(np.repeat(sizes >= least, sizes))
    seg = np.repeat(np.arange(len(sizes)), sizes)[pos]
    width = int(code.max(initial=0)) + 1
    starts, ends = [], []
    while len(pos):
        fresh = np.concatenate([[True], (np.diff(pos) != 1) | (np.diff(seg) != 0)])
        seg = np.cumsum(fresh) - 1
        size = np.bincount(seg)
        long = (size >= least)[seg]
        pos, seg = pos[long], seg[long]
        if not len(pos):
            break
        key = seg * width + code[pos]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        edge = np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])
        lone = np.empty(len(pos), bool)
        lone[order] = edge[:-1] & edge[1:]
        split = np.bincount(seg, lone, minlength=len(size)) > 0
        first = np.flatnonzero(np.concatenate([[True], np.diff(seg) != 0]) & ~split[seg])
        starts.append(pos[first])
        ends.append(pos[first] + size[seg[first]])
        again = split[seg] & ~lone
        pos, seg = pos[again], seg[again]
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(ends)


class Sums:
    """Sums of powers over words, by which stretches of equal length are compared: equal ones never differ, different ones hardly ever agree."""

    def __init__(self, code: np.ndarray):
        self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(code), BASE, np.uint64))])
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(mix(code.astype(np.uint64) + np.uint64(1)) * self.power[: len(code)])])

    def same(self, at: np.ndarray, lag: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Whether the `size` words from `at` on equal those `lag` further on."""
        total = self.total
        return (total[at + size] - total[at]) * self.power[lag] == total[at + lag + size] - total[at + lag]

    def reach(self, at: np.ndarray, lag: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words, `most` at most, match in a row from `at` on, or before it."""
        found = np.zeros(len(at), np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step:
            can = np.flatnonzero(found + step <= most)
            origin = at[can] - found[can] - step if back else at[can] + found[can]
            found[can] += step * self.same(origin, lag[can], step)
            step >>= 1
        return found


def lag_scan(code: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = LEAST, probes: int = PROBES) -> np.ndarray:
    """Rows (start, end, period) of the runs inside segments, by start, then period. Memory is bounded by words and `probes`."""
    size = ends - starts
    lags = size // 2
    offset = np.cumsum(lags) - lags
    sums = Sums(code)
    found = [np.zeros((0, 3), np.int64)]
    total, done = int(lags.sum()), 0
    while done < total:
        # as many lags as have about `probes` blocks: lags in order, each with its segment
        some = np.arange(done, min(total, done + probes))
        seg = np.searchsorted(offset, some, side="right") - 1
        q = some - offset[seg] + 1
        t = (np.maximum(least - q, q) + 1) // 2
        blocks = (size[seg] - q) // t
        cut = max(1, int(np.searchsorted(np.cumsum(blocks), probes, side="right")))
        seg, q, t, blocks = seg[:cut], q[:cut], t[:cut], blocks[:cut]
        done += cut
        which = np.repeat(np.arange(len(q)), blocks)
        nth = np.arange(len(which)) - (np.cumsum(blocks) - blocks)[which]
        at = starts[seg[which]] + nth * t[which]
        hit = sums.same(at, q[which], t[which])
        follows = np.concatenate([[False], hit[:-1] & (nth[1:] > 0)])  # the block before it matched: the same stretch
        only = np.flatnonzero(hit & ~follows)
        at, lag, own = at[only], q[which[only]], seg[which[only]]
        before = sums.reach(at, lag, at - starts[own], True)
        behind = sums.reach(at, lag, ends[own] - lag - at, False)
        s, e = at - before, at + behind + lag
        long = e - s >= np.maximum(least, 2 * lag)
        found.append(np.stack([s, e, lag], 1)[long])
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)  # a stretch's multiples of its period end where it does
    runs = runs[first]
    for s, e, p in runs.tolist():
        if not np.array_equal(code[s : e - p], code[s + p : e]):
            return compared(code, starts, ends, least)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def compared(code: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = LEAST) -> np.ndarray:
    """As lag_scan, comparing every word at every lag: where sums of powers agree for different stretches."""
    best: dict[tuple[int, int], int] = {}
    for a, b in zip(starts.tolist(), ends.tolist()):
        for q in range(1, (b - a) // 2 + 1):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], code[a : b - q] == code[a + q : b], [0]])))
            for s, e in zip((a + edges[0::2]).tolist(), (a + edges[1::2] + q).tolist()):
                if e - s >= max(least, 2 * q):
                    best.setdefault((s, e), q)
    return np.array(sorted(((s, e, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def codes(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal ones only."""
    return pa.array(words, pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if words else np.zeros(0, np.int64)


def runs_of(lists: list[list[bytes]], least: int = LEAST) -> tuple[list[np.ndarray], list[list[bytes]]]:
    """For each list of words its runs (rows of start, length, period, by start, then period) and the words that stay."""
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    code = codes([w for x in lists for w in x])
    runs = lag_scan(code, *surviving(code, bounds, least), least)
    owner = np.searchsorted(bounds, runs[:, 0], side="right") - 1
    change = np.zeros(len(code) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    gone = np.cumsum(change[:-1]) > 0
    cuts = np.searchsorted(owner, np.arange(len(lists) + 1))
    own, stay = [], []
    for i, words in enumerate(lists):
        mine = runs[cuts[i] : cuts[i + 1]]
        own.append(np.stack([mine[:, 0] - bounds[i], mine[:, 1] - mine[:, 0], mine[:, 2]], 1))
        stay.append([words[j] for j in np.flatnonzero(~gone[bounds[i] : bounds[i + 1]])] if len(mine) else words)
    return own, stay


def words_of(text: str) -> list[bytes]:
    """The runs of a text without a space or one of the characters 9 to 13; bytes split there and nowhere else."""
    return text.encode().split()


def repeated_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the query op13: those of every tenth document, by the CRC-32 of its id, repeat from some word on. A null id's words stay."""
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


RUN = ("start", "length", "period")


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text", runs: str = "runs", collapsed: str = "collapsed", least: int = LEAST, change=None) -> DataFrame:
    """`df` without its text, with its runs, by start, then period, and the text without what repeats: all words but those that some run
    holds after its first period, joined by one space. A run is a stretch of `least` words or more that holds its smallest
    period twice and that no neighbour extends. A null or empty text has no runs and collapses to an empty one. Texts of any length are
    read whole, in one task each, in memory that grows with their words; repeated rows give the same. Other columns stay, whatever
    their names; those named like the new ones are replaced. `change(key, words)` may give other words to look at. No row is shuffled.
    """
    kept = [c for c in df.columns if c not in (text, runs, collapsed)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(runs, T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in RUN]))), T.StructField(collapsed, T.StringType())])
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in RUN]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4_000_000):
            lists = [words_of(t) for t in strings(batch.column(len(kept) + 1))]
            if change:
                lists = [change(k, w) for k, w in zip(batch.column(len(kept)).to_pylist(), lists)]
            found, stay = runs_of(lists, least)
            flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            values = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(kind.value_type))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32))
            text_out = pa.array([b" ".join(w) for w in stay], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.ListArray.from_arrays(offsets, values, kind), text_out], [*kept, runs, collapsed])

    # key and text go last, in places of their own: `slices` finds the text by name
    inner = df.select(*map(named, kept), named(key).alias("key"), named(text).alias("text"))
    if len(set(inner.columns)) < len(inner.columns):
        inner = inner.toDF(*[f"c{i}" for i in range(len(kept))], "key", "text")
    return through(inner, run, schema)


def report(df: DataFrame) -> DataFrame:
    """The result of op13: runs of each document, its longest one, and digests of all runs and of the collapsed text."""
    made = periodic_runs(df.select("doc_id", "text"), change=repeated_words)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    made = made.select("doc_id", "runs", "collapsed", longest.alias("top"))
    length, period = F.col("top.length"), -F.col("top.short")
    return made.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.back")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

"""Operator 4: a quality classifier by co-training.

Two views of a document: its content (hashed words and pairs of words, kinds of characters, repetition) and its page metadata (language, source,
length and layout). Two logistic models, one for each view, learn from labelled rows. Over several rounds each labels the rows of an
unlabelled pool, replenished each round, that it is surest of for the other one. At the end both are calibrated on rows of their own and combined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, named, slices, strings, through, unused, word_hashes
from .logistic import fit, predict

WORDS, KINDS, HASHED, LAYOUT = 128, 9, 24, 3
CONTENT, META = WORDS + KINDS, LAYOUT + 2 * HASHED


def kinds(text: str) -> list[float]:
    """Shares of kinds of characters and of repeated words of a whole text; zeros for an empty one."""
    data = text.encode()
    if not data:
        return [0.0] * KINDS
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
    words = text.split()
    n = max(1, len(words))
    marks = share[33:48].sum() + share[58:65].sum() + share[91:97].sum() + share[123:127].sum()
    return [
        share[65:91].sum(), share[97:123].sum(), share[48:58].sum(), marks, share[128:].sum(),
        len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, min(20.0, len(text) / n) / 20, float(np.log1p(n)) / 12,
    ]


def hashed_words(texts: list[str]) -> np.ndarray:
    """Log counts of the words and the pairs of words of whole texts at WORDS hashed places, each row of length 1 (zeros without words)."""
    word, owner = word_hashes(texts)
    pair = owner[1:] == owner[:-1]
    both = mix(word[:-1] * np.uint64(3) + word[1:])[pair]
    place = np.concatenate([owner, owner[1:][pair]]) * WORDS + (np.concatenate([word, both]) % np.uint64(WORDS)).astype(np.int64)
    out = np.log1p(np.bincount(place, minlength=len(texts) * WORDS).reshape(-1, WORDS).astype(float))
    return out / np.maximum(1e-9, np.sqrt((out * out).sum(axis=1, keepdims=True)))


def hashed(names: list[str | None]) -> np.ndarray:
    """One of HASHED places for each name, by a hash of the whole name; null has none."""
    out = np.zeros((len(names), HASHED))
    place = {name: int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") % HASHED for name in set(names) - {None}}
    for i, name in enumerate(names):
        if name is not None:
            out[i, place[name]] = 1
    return out


def views(texts: list[str], languages: list[str | None], sources: list[str | None], lengths: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    lines = np.array([t.count("\n") + 1 for t in texts], float)
    length = np.array([len(t) if n is None else max(0, n) for t, n in zip(texts, lengths)], float)
    layout = np.column_stack([np.log1p(length) / 12, np.log1p(lines) / 6, np.log1p(length / lines) / 8])
    content = np.column_stack([hashed_words(texts), np.array([kinds(t) for t in texts], float).reshape(-1, KINDS)])
    return content, np.column_stack([layout, hashed(languages), hashed(sources)])


class Model:
    """Two views' coefficients, and the combination of their calibrated logits."""

    def __init__(self, betas: list[np.ndarray], scale: list[np.ndarray], joint: np.ndarray):
        self.betas, self.scale, self.joint = betas, scale, joint

    def logits(self, x: list[np.ndarray]) -> np.ndarray:
        raw = [np.clip(v @ b[:-1] + b[-1], -30, 30) for v, b in zip(x, self.betas)]
        return np.column_stack([r * s[0] + s[1] for r, s in zip(raw, self.scale)])

    def score(self, x: list[np.ndarray]) -> np.ndarray:
        return predict(self.logits(x), self.joint)


def cotrain(x: list[np.ndarray], y: np.ndarray, calibration: np.ndarray, pool: list[np.ndarray], part: np.ndarray, rounds: int, share: float) -> Model:
    """Fit on the rows of x outside `calibration`. In round r the pool is its rows of a `part` up to r; each view labels `share` of them on either
    side, as far as it is sure of them, for the other view. Without a pool the views learn from the labels alone.
    """
    own = ~calibration
    extra = [(np.zeros(0, np.int64), np.zeros(0)), (np.zeros(0, np.int64), np.zeros(0))]
    betas: list[np.ndarray] = []
    for turn in range(rounds + 1):
        betas = []
        for k in (0, 1):
            at, said = extra[k]
            betas.append(fit(np.concatenate([x[k][own], pool[k][at]]), np.concatenate([y[own], said]), np.concatenate([np.ones(own.sum()), np.full(len(at), 0.5)])))
        here = np.flatnonzero(part <= turn)
        if turn == rounds or not len(here):
            break
        for k in (0, 1):
            p = predict(pool[k][here], betas[k])
            order = np.argsort(p, kind="stable")
            each = max(1, int(share * (turn + 1) * len(p)))
            low, high = order[:each], order[-each:]
            low, high = low[p[low] <= 0.05], high[p[high] >= 0.95]  # confident ones only
            extra[1 - k] = (here[np.concatenate([low, high])], np.concatenate([np.zeros(len(low)), np.ones(len(high))]))
    held = calibration if len(set(y[calibration])) == 2 else np.ones(len(y), bool)
    raw = [np.clip(v[held] @ b[:-1] + b[-1], -30, 30)[:, None] for v, b in zip(x, betas)]
    scale = [fit(r / 10, y[held], ridge=0.1) / [10, 1] for r in raw]
    half = Model(betas, scale, np.zeros(3))
    return Model(betas, scale, fit(half.logits([v[held] for v in x]), y[held], ridge=0.5))


def with_score(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = 20_000, pool_rows: int = 3_000, rounds: int = 4, share: float = 0.05, score: str = "_score") -> DataFrame:
    """`df` (text, lang, source, n_chars; columns that it lacks count as null) with the probability of quality 1 of each row:
    rows pass once through the workers and are not shuffled. The models are fitted on at most `rows` labelled ids whose
    crc32(key as text) mod 5 is not 0 (of these, remainder 1 calibrates) and a pool of ids without a label that grows by at most `pool_rows` each
    round, all picked by a hash of the key; an id has one row there, that of the greatest measures. Every row is scored on its whole text. Null texts count as empty, nulls in
    the metadata as no value (a missing n_chars is counted from the text); labels other than 0 and 1 are none. Where every id has a label there is no pool and nothing is exchanged. Without labels of
    both kinds every row scores the labels' mean, or 0.5. Rows that repeat are scored each; a column named `score` is replaced.
    """
    none = {"lang": "string", "source": "string", "n_chars": "long"}
    meta = [(named(c) if c in df.columns else F.lit(None)).cast(t) for c, t in none.items()]
    fields = ["t", *none]
    base = df.select(named(key).alias("key"), F.struct(F.coalesce(named(text), F.lit("")).alias("t"), *[c.alias(n) for n, c in zip(none, meta)]).alias("row"))
    fold = F.crc32(F.col("key").cast("string")) % 5
    known = labels.where(named(label).isin(0, 1)).groupBy(named(key).alias("key")).agg(F.max(named(label)).cast("double").alias("y"))
    chosen = known.where(fold != 0).orderBy(F.xxhash64("key"), "key").limit(rows)
    unlabelled = base.select("key").join(known, "key", "left_anti").where("key is not null").distinct().orderBy(F.xxhash64("key"), "key").limit(pool_rows * rounds)
    picked = chosen.select("key", "y", (fold == 1).alias("calibration")).union(unlabelled.select("key", F.lit(None).cast("double"), F.lit(False)))
    kind = dict(base.dtypes)["key"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            seen = views(strings(batch.column("t")), *(batch.column(c).to_pylist() for c in none))
            parts = [pa.array([row.tobytes() for row in v.astype("<f4")], pa.binary()) for v in seen]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *parts, batch.column("y"), batch.column("calibration")], ["key", "a", "b", "y", "calibration"])

    # at most rows + rounds * pool_rows ids, so that they can be broadcast; short vectors of them come to the driver, however large the table is
    met = base.join(F.broadcast(picked), "key").select("key", *[F.col("row").getField(c).alias(c) for c in fields], "y", "calibration")
    measured = met.mapInArrow(measure, f"key {kind}, a binary, b binary, y double, calibration boolean")
    one = measured.groupBy("key").agg(F.max(F.struct("a", "b", "y", "calibration")).alias("m")).select(F.xxhash64("key").alias("place"), "m.*")
    found = one.toArrow().sort_by("place")
    x = [np.frombuffer(b"".join(found.column(c).to_pylist()), "<f4").reshape(-1, n) for c, n in (("a", CONTENT), ("b", META))]
    y = np.array([np.nan if v is None else v for v in found.column("y").to_pylist()], float)
    calibration = np.array(found.column("calibration").to_pylist(), bool)
    del found
    has = ~np.isnan(y)
    if len(set(y[has])) == 2:
        part = np.arange((~has).sum()) // max(1, pool_rows)
        model = cotrain([v[has] for v in x], y[has], calibration[has], [v[~has] for v in x], part, rounds, share)
    else:
        mean = float(y[has].mean()) if has.any() else 0.5
        model = Model([np.zeros(CONTENT + 1), np.zeros(META + 1)], [np.zeros(2)] * 2, np.array([0, 0, np.log((mean + 1e-9) / (1 - mean + 1e-9))]))
    kept = [c for c in df.columns if c != score]
    extra = unused(df, "_meta")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            seen = views(strings(batch.column(text)), *(c.to_pylist() for c in batch.column(extra).flatten()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(model.score(list(seen)))], [*kept, score])

    whole = df.select(*map(named, kept), F.struct(*[c.alias(n) for n, c in zip(none, meta)]).alias(extra))
    return through(whole, judge, T.StructType([*(df.schema[c] for c in kept), T.StructField(score, T.DoubleType())]))


def quality(df: DataFrame, labels: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """(key, held_out, score, predicted) per row of `df`: see `with_score`; predicted is 1 from 0.5 on, and the rows are held
    out from fitting whose crc32(key as text) mod 5 is 0. Other columns don't pass.
    """
    out = with_score(df, labels, key, **options)
    return out.select(key, (F.crc32(F.col(key).cast("string")) % 5 == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))

"""Operator 3: toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon turns words into symbols with weights: insults and acts of violence (given seeds, and stems learned from labelled rows, as
insults), targets, words of intent, negations and reporting verbs. Four pattern transducers read the symbols. The insult transducer emits
an insult's weight, more if somebody is addressed a few words before. The threat transducer follows intent, act and target: an act
alone emits little, one behind a word of intent all, and a target behind that emits again. Their union adds what both emit. The
negation transducer lowers what follows a negation closely, the one of reported speech the rest of the clause; these are composed with
the union, so that their factors multiply. The result is one deterministic table of product states. A clause's score is
what the table emits along it; a text's features come from its matched clauses, and a logistic model maps them to a score. The labels are
used only for the stems and for that model, which sees each labelled row through stems learned without its half of the rows.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, named, slices, strings, through
from .logistic import fit, predict

INSULT, ACT, TARGET, INTENT, NEGATION, REPORT, OTHER = SYMBOLS = range(7)
#: Seeds of the lexicon; labelled rows add stems.
SEEDS = {
    INSULT: "idiot idiots moron morons stupid loser losers clown scum trash garbage filth vermin worthless pathetic disgusting imbecile dumb fool bastard idiota estúpido imbécil basura idiotin dummkopf abschaum widerlich crétin ordure débile".split(),
    ACT: "kill hurt destroy murder punish beat strangle stab shoot burn töten umbringen vernichten tuer détruire frapper matar destruir golpear".split(),
    TARGET: "you your yours he she they them him her tu toi vous du dich ihr sie usted ustedes te".split(),
    INTENT: "will shall gonna going should must want wants deserve deserves werde werden sollte muss vais allons dois voy vamos debe".split(),
    NEGATION: "not never no nobody nicht kein keine nie pas jamais nunca jamás".split(),
    REPORT: "said says claimed wrote quoted reported sagte schrieb dit écrit dijo escribió".split(),
}
SEED_WEIGHT, WINDOW, NEAR = 4.0, 4, 3
AIMED, BARE, INTENDED, AT_TARGET, NEGATED, REPORTED = 1.3, 0.6, 1.2, 0.4, 0.6, 0.7
TOKEN = re.compile(r"[^\W\d_]+")
CLOSE = re.compile(r"[.!?;:\n]")
STEMS = (4, 5, 6)


def insult_machine() -> dict:
    """States count down from the last target; an insult within the window is aimed."""
    arcs = {}
    for state, symbol in product(range(WINDOW + 1), SYMBOLS):
        arcs[state, symbol] = (WINDOW if symbol == TARGET else max(0, state - 1), (AIMED if state else 1.0) if symbol == INSULT else 0.0)
    return arcs


def threat_machine() -> dict:
    """States: 0; 1 to NEAR, words left behind intent; above, words left behind an intended act, whose target is still to come."""
    arcs = {}
    for state, symbol in product(range(2 * NEAR + 1), SYMBOLS):
        acted, follow = state > NEAR, 0 if state in (0, NEAR + 1) else state - 1
        if symbol == ACT:
            arcs[state, symbol] = (2 * NEAR, INTENDED) if state else (0, BARE)
        elif symbol == TARGET and acted:
            arcs[state, symbol] = (0, AT_TARGET)
        elif symbol == INTENT and not acted:
            arcs[state, symbol] = (NEAR, 0.0)
        else:
            arcs[state, symbol] = (follow, 0.0)
    return arcs


def negation_machine() -> dict:
    arcs = {}
    for state, symbol in product(range(WINDOW), SYMBOLS):
        arcs[state, symbol] = (WINDOW - 1 if symbol == NEGATION else max(0, state - 1), NEGATED if state else 1.0)
    return arcs


def report_machine() -> dict:
    return {(state, symbol): (1 if symbol == REPORT else state, REPORTED if state else 1.0) for state, symbol in product(range(2), SYMBOLS)}


def joined(first: dict, second: dict, out: Callable[[float, float], float]) -> dict:
    """Both machines on the same symbols: pairs of states, numbered as they are reached from (0, 0), with `out` of what the two emit."""
    number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
    while todo:
        a, b = todo.pop()
        for symbol in SYMBOLS:
            (na, wa), (nb, wb) = first[a, symbol], second[b, symbol]
            if (na, nb) not in number:
                number[na, nb] = len(number)
                todo.append((na, nb))
            arcs[number[a, b], symbol] = (number[na, nb], out(wa, wb))
    return arcs


def union(first: dict, second: dict) -> dict:
    return joined(first, second, operator.add)


def compose(first: dict, second: dict) -> dict:
    return joined(first, second, operator.mul)


GRAMMAR = compose(union(insult_machine(), threat_machine()), compose(negation_machine(), report_machine()))


class Lexicon:
    """Symbols and weights of words: seeds by whole word, learned entries by stem; the heaviest entry of a word counts."""

    def __init__(self, learned: dict[str, float]):
        self.words = {w: (s, SEED_WEIGHT if s in (INSULT, ACT, TARGET) else 0.0) for s, ws in SEEDS.items() for w in ws}
        self.stems = learned
        # a word that begins like no entry is no attack
        self.heads, self.finder = {w.removesuffix("-") for w in learned} | {w for s in (INSULT, ACT) for w in SEEDS[s]}, None

    def symbol(self, word: str) -> tuple[int, float]:
        found = self.words.get(word, (OTHER, 0.0))
        learned = max((self.stems.get(s, 0.0) for s in stems_of(word)), default=0.0)
        if not learned:
            return found
        return (found[0], max(found[1], learned)) if found[0] in (INSULT, ACT) else (INSULT, learned)

    def starts(self, low: str) -> list[int]:
        """Where words begin that may be attacks; one pass over the text for all of them."""
        if self.finder is None:
            self.finder = ahocorasick.Automaton()
            for head in self.heads:
                self.finder.add_word(head, len(head))
            self.finder.make_automaton()
        found = {end + 1 - size for end, size in self.finder.iter(low)}
        return sorted(i for i in found if i == 0 or not (low[i - 1].isalnum() and not low[i - 1].isdecimal()))

    def clauses(self, text: str) -> list[float]:
        """Scores of the clauses that the grammar matches."""
        low, scores, end = text.lower(), [], -1
        for i in self.starts(low):
            if i < end:
                continue
            start = max(low.rfind(mark, max(0, end), i) for mark in ".!?;:\n") + 1 or max(0, end)
            close = CLOSE.search(low, i)
            end = close.start() if close else len(low)
            state, total = 0, 0.0
            for token in TOKEN.findall(low, start, end):
                symbol, weight = self.symbol(token)
                state, factor = GRAMMAR[state, symbol]
                total += weight * factor
            if total:
                scores.append(total)
        return scores

    def features(self, text: str) -> list[float]:
        scores = self.clauses(text)
        return [float(bool(scores)), math.log1p(max(scores, default=0.0)), math.log1p(sum(scores)), math.log1p(len(scores))]


def stems_of(word: str) -> list[str]:
    return [word[:n] + "-" for n in STEMS if len(word) >= n] + [word]


def labelled(df: DataFrame, labels: DataFrame, label: str, key: str, text: str, rows: int) -> DataFrame:
    """(text, y, half) of at most `rows` labelled ids for fitting (crc32 of the id mod 5 is not 0), picked by a hash of the id. Labels other than 0 and 1
    are none; an id has one row, its greatest text.
    """
    ids = labels.where(named(label).isin(0, 1) & (F.crc32(named(key).cast("string")) % 5 != 0)).groupBy(named(key).alias("key")).agg(F.max(named(label)).cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("key"), "key").limit(rows)  # a bounded sample, so that it can be broadcast
    met = df.select(named(key).alias("key"), F.coalesce(named(text), F.lit("")).alias("text")).join(F.broadcast(ids), "key")
    return met.groupBy("key").agg(F.max("text").alias("text"), F.first("y").alias("y")).select("text", "y", F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(2)).cast("int").alias("half"))


def learn_stems(sample: DataFrame, most: int = 5000) -> list[dict[str, float]]:
    """Stems and words that many more toxic rows than others hold, with their log odds: by the rows of half 0, by those of half 1, by all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in range(4)]
        for batch in batches:
            for text, y, half in zip(strings(batch.column("text")), batch.column("y").to_pylist(), batch.column("half").to_pylist()):
                words = {t for t in TOKEN.findall(text.lower()) if len(t) > 3}
                seen[2 * half + y].update({s for w in words for s in stems_of(w)} | {""})
        names = list(set().union(*seen))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in seen)], ["stem", "no0", "yes0", "no1", "yes1"])

    columns = ["no0", "yes0", "no1", "yes1"]
    counts = sample.mapInArrow(count, "stem string, no0 long, yes0 long, no1 long, yes1 long").groupBy("stem").agg(*[F.sum(c).alias(c) for c in columns])
    total = counts.where("stem = ''").first()
    if total is None:
        return [{}, {}, {}]
    sides = {0: ("no0", "yes0"), 1: ("no1", "yes1"), 2: ("no0 + no1", "yes0 + yes1")}
    whole = {k: tuple(total[no] if k < 2 else total["no0"] + total["no1"] if i == 0 else total["yes0"] + total["yes1"] for i, no in enumerate(side)) for k, side in sides.items()}
    found = []
    for k, (no, yes) in sides.items():
        n_no, n_yes = whole[k]
        if not n_no or not n_yes:
            found.append({})
            continue
        odds = F.log((F.expr(yes) + 0.5) / (n_yes + 1.0)) - F.log((F.expr(no) + 0.5) / (n_no + 1.0))
        rows = counts.where((F.col("stem") != "") & (F.expr(yes) >= max(3, n_yes // 500))).select("stem", F.expr(yes).alias("yes"), odds.alias("odds")).where("odds >= 3").orderBy(F.desc("yes"), "stem").limit(most).collect()
        found.append({r["stem"]: float(r["odds"]) for r in rows})
    return found


def with_score(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = 20_000, score: str = "_score") -> DataFrame:
    """`df` with the score of each whole text, from 0 to 1: rows pass once through the workers and are not shuffled. Stems and
    model are fitted on at most `rows` labelled rows whose crc32(key as text) mod 5 is not 0. Null and empty texts have no
    clauses and get the score of texts without any. Without labels of both kinds the seeds alone count. Only the text is
    read for a score. Rows that repeat are scored each; a column named `score` is replaced.
    """
    sample = checkpoint(labelled(df, labels, label, key, text, rows))
    by_half_0, by_half_1, learned = learn_stems(sample)
    lexicon, halves = Lexicon(learned), [Lexicon(by_half_1), Lexicon(by_half_0)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [halves[h].features(t) for t, h in zip(strings(batch.column("text")), batch.column("half").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("y")], ["x", "y"])

    known = sample.mapInArrow(measure, "x array<double>, y int").collect()
    x, y = np.array([r["x"] for r in known], float).reshape(-1, 4), np.array([r["y"] for r in known], float)
    beta = fit(x, y) if len(set(y)) == 2 else np.array([4.0, 0.5, 0.5, 0.5, -3.0])
    kept = [c for c in df.columns if c != score]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = np.array([lexicon.features(t) for t in strings(batch.column(text))], float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(predict(found, beta))], [*kept, score])

    return through(df.select(*map(named, kept)), judge, T.StructType([*(df.schema[c] for c in kept), T.StructField(score, T.DoubleType())]))


def scores(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, held_out, score, predicted) per row of `df`: see `with_score`; predicted is 1 from 0.5 on, and the rows are held
    out from fitting whose crc32(key as text) mod 5 is 0. Other columns don't pass.
    """
    out = with_score(df.select(key, text), labels, key, text, **options)
    return out.select(key, (F.crc32(F.col(key).cast("string")) % 5 == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))

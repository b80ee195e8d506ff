"""Shuffles, intervals, null distributions and agreement against sequential or direct computation."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import draws
from folioscope.operators import resampling, sampling, stats


def numbers(seed):
    """The generator as published: one number after the other, in 32-bit integers."""
    state = seed & draws.MASK
    while True:
        state = (state + 0x6D2B79F5) & draws.MASK
        t = ((state ^ (state >> 15)) * (1 | state)) & draws.MASK
        t = ((t + (((t ^ (t >> 7)) * (61 | t)) & draws.MASK)) & draws.MASK) ^ t
        yield (t ^ (t >> 14)) / 4294967296


def swapped(items, rand):
    a = list(items)
    for i in range(len(a) - 1, 0, -1):
        j = math.floor(next(rand) * (i + 1))
        a[i], a[j] = a[j], a[i]
    return a


@pytest.mark.parametrize("seed", [0, 7, 20260918, -1, 2**31 + 5])
def test_numbers_follow_from_their_place(spark, seed):
    got = [r["u"] / 4294967296 for r in draws.with_draw(spark.range(1, 2001), F.col("id"), seed, "u").orderBy("id").collect()]
    rand = numbers(seed)
    assert got == [next(rand) for _ in range(2000)]
    assert seed != 7 or got[0] == pytest.approx(0.011704753385856748)


def test_shuffles_equal_sequential_swaps(spark):
    sizes = {"a": 1, "b": 2, "c": 3, "d": 1000, None: 64}
    rows = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g string, k int").repartition(7)
    got = {}
    for r in sampling.seeded_shuffle(rows, ["g"], ["k"], 42).collect():
        got.setdefault(r["g"], {})[r["place"]] = r["k"]
    for g, n in sizes.items():
        assert [got[g][i] for i in range(n)] == swapped(range(n), numbers(42)), g
    assert sampling.seeded_shuffle(rows.where("k < 0"), ["g"], ["k"], 42).collect() == []


def test_shuffles_of_one_group_and_of_later_numbers(spark):
    rows = spark.range(3000).withColumnRenamed("id", "k")
    got = [r["k"] for r in sampling.seeded_shuffle(rows, [], ["k"], 7).orderBy("place").collect()]
    assert got == swapped(range(3000), numbers(7))
    rand = numbers(7)
    for _ in range(11):
        next(rand)
    got = [r["k"] for r in sampling.seeded_shuffle(rows.where("k < 50"), [], ["k"], 7, skip=11).orderBy("place").collect()]
    assert got == swapped(range(50), rand)


def test_numbers_of_rows_over_ranges(spark):
    rng = random.Random(1)
    rows = [(g, v) for g in "xyz" for v in rng.sample(range(10_000), 700)]
    got = sampling.numbered(spark.createDataFrame(rows, "g string, v int").repartition(5), ["g"], ["v"]).collect()
    want = {(g, v): i for g in "xyz" for i, v in enumerate(sorted(v for h, v in rows if h == g))}
    assert {(r["g"], r["v"]): r["i"] for r in got} == want and len(got) == len(rows)


def test_selection_over_sections(spark):
    urls = [(i, f"s{i * 7 % 11 % 5}") for i in range(40)]
    got = sampling.spread_over_sections(spark.createDataFrame(urls, "k int, section string"), "section", ["k"], 20260918, 8, 2)
    rand = numbers(20260918)
    by = {}
    for k, s in swapped(urls, rand):
        by.setdefault(s, []).append(k)
    sections = swapped(by, rand)
    want = [by[s][r] for r in range(2) for s in sections if len(by[s]) > r][:8]
    assert [r["k"] for r in got.orderBy("pick").collect()] == want


def ranks(x):
    return [sum(w < v for w in x) + (sum(w == v for w in x) + 1) / 2 for v in x]


def pearson(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return None if len(a) < 2 or a.std() < 1e-9 or b.std() < 1e-9 else float(np.corrcoef(a, b)[0, 1])


def times(draw, key):
    """How often a row is drawn: a Poisson count of mean 1 of 16 bits of a hash."""
    u, k, upto = int(hashlib.md5(f"{draw}:{key}".encode()).hexdigest()[:4], 16) / 65536, 0, math.exp(-1)
    while u >= upto and k < 7:
        k += 1
        upto += math.exp(-1) / math.factorial(k)
    return k


@pytest.mark.parametrize("statistic", ["ranks", "reranked", "slope"])
def test_intervals_equal_direct_draws(spark, statistic):
    rng = random.Random(4)
    pairs = [(i, rng.randint(0, 12), None if i % 9 == 0 else rng.randint(0, 12) + i % 4) for i in range(60)]
    rows = [("g", *p) for p in pairs] + [("flat", i, 1, i) for i in range(5)] + [(None, 1, 1, 2)]
    df = spark.createDataFrame(rows, "g string, k int, x int, y int")
    got = {r["g"]: r for r in resampling.bootstrap(df, "x", "y", ["g"], "k", statistic, 150).collect()}
    valid = [p for p in pairs if p[2] is not None]
    rx, ry = ranks([p[1] for p in valid]), ranks([p[2] for p in valid])
    found = []
    for d in range(1, 151):
        at = [i for i, p in enumerate(valid) for _ in range(times(d, p[0]))]
        x, y = [valid[i][1] for i in at], [valid[i][2] for i in at]
        found.append(np.polyfit(x, y, 1)[0] if statistic == "slope" else pearson(ranks(x), ranks(y)) if statistic == "reranked" else pearson([rx[i] for i in at], [ry[i] for i in at]))
    found.sort()
    g = got["g"]
    assert (g["n"], g["valid"]) == (len(valid), 150)
    assert (g["low"], g["high"]) == (pytest.approx(found[3], abs=6e-4), pytest.approx(found[146], abs=6e-4))
    assert got["flat"]["estimate"] is None and got["flat"]["low"] is None and got["flat"]["valid"] == 0
    assert got[None]["n"] == 1 and got[None]["estimate"] is None
    few = {r["g"]: r for r in resampling.bootstrap(df, "x", "y", ["g"], "k", statistic, 99).collect()}
    assert few["g"]["valid"] == 99 and few["g"]["low"] is None


def test_counts_follow_the_poisson_distribution():
    count = np.bincount([times(d, "k") for d in range(20_000)], minlength=4)[:4] / 20_000
    assert count == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(4)], abs=0.012)


#: Ten units of a published study: quality score, fidelity with and without search, rate of answers that cite anything, searches for each probe.
STUDY = [(41, 51.1667, 39.8333, 3 / 6, 4.0), (56, 46.0, 57.8333, 0.0, 0.5), (58, 42.6667, 21.0, 1 / 6, 3.0), (61, 63.1667, 37.1667, 4 / 6, 4.8333), (63, 65.5, 70.6667, 3 / 6, 2.8333), (64, 36.8333, 17.1667, 0.0, 4.0), (64, 46.5, 30.6667, 3 / 6, 5.0), (67, 35.6667, 22.0, 1 / 6, 3.5), (73, 63.3333, 63.8333, 1 / 6, 0.0), (77, 66.6667, 60.1667, 2 / 6, 3.5)]


def test_published_intervals_to_the_last_digit(spark):
    want = {"web": (0.231, -0.631, 0.838), "closed": (0.134, -0.622, 0.665), "lift": (-0.073, -0.8, 0.593), "cite": (-0.122, -0.74, 0.601)}
    slopes = {"web": (0.362, -0.463, 1.23), "closed": (0.468, -0.934, 2.195), "lift": (-0.106, -1.27, 0.913), "cite": (-0.004, -0.016, 0.014)}
    long = [(y, i, u[0], v) for i, u in enumerate(STUDY) for y, v in (("web", u[1]), ("closed", u[2]), ("lift", u[1] - u[2]), ("cite", u[3]))]
    df = spark.createDataFrame(long, "y string, k int, score int, v double")
    for statistic, expected in (("reranked", want), ("slope", slopes)):
        got = resampling.seeded_bootstrap(df, "score", "v", ["y"], "k", statistic).collect()
        assert {r["y"]: (r["estimate"], r["low"], r["high"]) for r in got} == {y: pytest.approx(v, abs=1.1e-3) for y, v in expected.items()}


def test_published_chances(spark):
    units = [(i, *u[:3], u[1] - u[2], u[4]) for i, u in enumerate(STUDY)]
    df = spark.createDataFrame(units, "k int, score int, web double, closed double, lift double, searches double").withColumn("g", F.lit(1))
    p = {y: stats.permutations(df, x, y, ["g"], "k", 4000).first() for x, y in (("score", "web"), ("searches", "lift"))}
    assert p["web"]["p"] == pytest.approx(0.521, abs=0.04) and p["lift"]["p"] == pytest.approx(0.031, abs=0.012) and p["lift"]["rho"] == 0.695
    assert resampling.detectable(spark.createDataFrame([(10,), (1,), (10,)], "n int"), "n", 4000).orderBy("n").collect() == [(1, None), (10, pytest.approx(0.636, abs=0.03))]


def test_agreement_of_unequal_repeats(spark):
    rng = random.Random(9)
    units = {u: [rng.gauss(10 * u, 6) for _ in range(rng.randint(1, 7))] for u in range(9)}
    df = spark.createDataFrame([("g", u, v) for u, vs in units.items() for v in vs] + [("g", 0, None), ("one", 1, 5.0)], "g string, u int, v double")
    got = {r["g"]: r for r in resampling.repeat_reliability(df, "v", "u", ["g"]).collect()}
    k = np.array([len(v) for v in units.values()])
    within = math.sqrt(np.mean([np.var(v, ddof=1) for v in units.values() if len(v) > 1]))
    between = np.std([np.mean(v) for v in units.values()], ddof=1)
    own = max(0, between**2 - within**2 / k.mean())
    assert got["g"]["icc"] == pytest.approx(own / (own + within**2), abs=6e-4) and got["g"]["units"] == 9
    every = np.concatenate(list(units.values()))
    msb = sum(len(v) * (np.mean(v) - every.mean()) ** 2 for v in units.values()) / 8
    msw = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in units.values()) / (len(every) - 9)
    k0 = (len(every) - (k**2).sum() / len(every)) / 8
    assert got["g"]["icc_anova"] == pytest.approx((msb - msw) / (msb + (k0 - 1) * msw), abs=6e-4)
    assert got["one"]["icc"] is None and got["one"]["icc_anova"] is None
    shrunk = {r["repeats"]: r for r in resampling.attenuation(spark.createDataFrame([(0.25,)], "icc double"), "icc", [1, 4, 12]).collect()}
    assert [(r["reliability"], r["observed_r"]) for r in map(shrunk.get, (1, 4, 12))] == [(0.25, 0.3), (0.571, 0.45), (0.8, 0.54)]

"""Line dedup, near-duplicate documents and vectors, licences and top-k against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from oracle import assert_same

from folioscope.llm import hnsw, license_scan, linededup, probminhash, queries, topk
from folioscope.llm.common import components, shingles


def words(line):
    return [w for w in re.split(r"[ \t\x0b\f\r]+", line.lower()) if w]


def one_word_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_lines(rows, least=3, fuzzy=8):
    places = [((doc, i), words(line)) for doc, text in rows if doc is not None and text is not None for i, line in enumerate(text.split("\n"))]
    places = sorted({(at, tuple(w)) for at, w in places if len(w) >= least})
    out = set()
    for at, w in places:
        for other, v in places:
            if other < at and (v == w or (min(len(v), len(w)) >= fuzzy and one_word_apart(list(v), list(w)))):
                out.add(at)
                break
    return out


def edited(rng, line):
    w = line.split(" ")
    for _ in range(rng.choice([0, 1, 1, 1, 2])):
        i, kind = rng.randrange(len(w)), rng.randrange(3)
        w[i : i + (kind < 2)] = [] if kind == 0 else [rng.choice("abcdefgh") * 2]
    return " ".join(w) or "a"


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(11)
    bases = [" ".join(rng.choices("abcdefgh", k=rng.choice([2, 3, 7, 8, 9, 15, 16, 17, 31, 32, 33, 40]))) for _ in range(40)]
    rows = [(i, "\n".join(edited(rng, rng.choice(bases)) for _ in range(rng.randrange(0, 6)))) for i in range(150)]
    found = {(r["doc"], r["pos"]) for r in linededup.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_lines(rows)
    assert found == want and len(want) > 100


def test_line_dedup_of_odd_rows(odd, empty):
    out = linededup.dedup(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    rows = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] is not None}
    assert rows[2] is None and rows[3] == "" and rows[7] == " \n\n " and rows[5] == "" and rows[6] == "" and rows[8] == ""
    assert rows[1].startswith("the quick")
    assert linededup.dedup(empty).count() == 0 and linededup.report(odd).count() == odd.count()


def test_line_dedup_of_columns_with_names_of_its_own(spark):
    line = "one two three four five six seven eight nine"
    df = spark.createDataFrame([(1, f"{line}\na b c", 7, 8, 9), (2, f"{line}\nx y z\n{line}", 7, 8, 9)], "doc_id long, text string, _drop int, _doc int, `a.b` int")
    out = linededup.dedup(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(1, f"{line}\na b c", 7, 8, 9), (2, "x y z", 7, 8, 9)]


def test_a_shared_folder_is_required_beyond_one_machine(monkeypatch):
    from types import SimpleNamespace

    from folioscope.llm import common

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None))
    assert common.shared_folder(session("local[4]"))
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_folder(session(master))


def brute_classes(rows, k=5, least=0.8):
    sets, parent, same = {}, {}, {}
    for doc, text in rows:
        w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if x]
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        parent[doc] = doc
    find = lambda x: x if parent[x] == x else find(parent[x])

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    for doc, text in sorted(rows):
        join(doc, same.setdefault(text or "", doc))
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            whole = len(sets[a] | sets[b])
            if whole and len(sets[a] & sets[b]) >= least * whole - 1e-12:
                join(a, b)
    return {d: find(d) for d in ids}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    bases = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=rng.choice([3, 5, 20, 60, 200]))) for _ in range(12)]
    rows = []
    for i in range(240):
        w = rng.choice(bases).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    found = probminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["id"]: r["class_id"] for r in found.collect()} == brute_classes(rows)


def test_near_duplicates_with_repeated_passages(spark):
    rng, rows = random.Random(8), []
    for i in range(40):
        w = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w + w[-40:] * 100))]
    want = brute_classes(rows)
    assert set(want.values()) == set(range(0, 80, 2))
    found = probminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["id"]: r["class_id"] for r in found.collect()} == want


def test_near_duplicates_whose_passages_repeat_in_turn(spark):
    """P repeats in one copy and Q in the other: the sets of shingles are nearly equal, the weights are not."""
    rng, rows = random.Random(9), []
    section = lambda: [f"w{rng.randrange(10**6)}" for _ in range(100)]
    for i, r in enumerate([4, 8, 32, 256] * 8):
        base, p, q = section(), section(), section()
        rows += [(2 * i, " ".join(base + p * r + q)), (2 * i + 1, " ".join(base + p + q * r))]
    found = probminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["id"]: r["class_id"] for r in found.collect()} == {d: d - d % 2 for d, _ in rows}


def test_near_duplicates_of_different_texts_under_one_id(spark):
    one, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, one), (1, other), (2, one), (3, other), (None, one), (4, None), (5, "")]
    for _ in range(2):
        found = sorted(((r["id"] or 0, r["class_id"]) for r in probminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
        same = 2 if [f for f in found if f[0] == 2][0][1] == 1 else 3
        assert found == sorted([(0, None), (1, 1), (1, 1), (2, 1 if same == 2 else 2), (3, 1 if same == 3 else 3), (4, 4), (5, 4)], key=str)


def test_word_hashes_of_texts_longer_than_a_piece(monkeypatch):
    from folioscope.llm import common

    texts = ["a bb " * 300, "", "x" * 500, "é " * 200 + "y", " lead and trail ", "\n"]
    want = [common.word_hashes([t])[0].tolist() for t in texts]
    monkeypatch.setattr(common, "PIECE", 64)
    hashes, owner = common.word_hashes(texts)
    assert [hashes[owner == i].tolist() for i in range(len(texts))] == want and [len(w) for w in want] == [len(t.split()) for t in texts]


def test_op6(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = queries.op6_minhash(spark, sf_dir).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == brute_classes(rows) and len(found) == len(rows)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in found)


def test_near_duplicates_of_odd_rows(odd, empty):
    found = [(r["id"], r["class_id"]) for r in probminhash.near_duplicates(odd).collect()]
    assert len(found) == odd.count() and dict(found)[5] == 1 and dict(found)[3] == 2
    assert probminhash.near_duplicates(empty).count() == 0


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(2)
    x, y = rng.integers(1, 4, 60), rng.integers(1, 4, 60)
    x[:20], y[40:] = 0, 0
    owner = np.concatenate([np.zeros((x > 0).sum(), int), np.ones((y > 0).sum(), int)])
    names = np.concatenate([np.flatnonzero(x), np.flatnonzero(y)]).astype(np.uint64) * np.uint64(2**40 + 9)
    times = np.concatenate([x[x > 0], y[y > 0]])
    drawn = probminhash.sketch(owner, names, times, 2, 4096)
    wx, wy = (np.where(v > 0, 1 + np.log2(np.maximum(v, 1)), 0) for v in (x, y))
    want = sum(1 / np.maximum(wx / wx[i], wy / wy[i]).sum() for i in range(60) if wx[i] and wy[i])
    assert (drawn[0] == drawn[1]).mean() == pytest.approx(want, abs=0.03)


def test_shingles_ignore_case_and_blanks():
    owner, values, times = shingles(["a b  c D e\nf", "A b c d E f", "", "one", "a a a a a a"])
    sets = defaultdict(set)
    for o, v in zip(owner.tolist(), values.tolist()):
        sets[o].add(v)
    assert sets[0] == sets[1] and len(sets[0]) == 2 and 2 not in sets and len(sets[3]) == 1 and times[owner == 4].tolist() == [2]


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(100, 200)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(40)] + [(5, 5), (7, None)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in chain:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert found == {n: find(n) for n in parent}


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("name", ["op5_licenses", "op9_embedding_dedup", "op10_topk"])
def test_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir).toPandas(), queries.oracle_sql()[name], sf_dir)


def test_vectors_across_shards(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(8, 16))
    x = centers[rng.integers(0, 8, 600)] + rng.normal(size=(600, 16)) * rng.choice([0.05, 0.3, 1.0], (600, 1))
    label = rng.integers(0, 2, 600)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(600, dtype=bool)
    counts, links = hnsw.vector_links(spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int"), shard=128)
    assert {r["id"]: r["n_links"] for r in counts.collect()} == {i: int(n) for i, n in enumerate(link.sum(axis=1)) if n}
    reach = np.linalg.matrix_power((link | np.eye(600, dtype=bool)).astype(float), 64) > 0
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert found == {i: int(np.flatnonzero(reach[i])[0]) for i in range(600) if link[i].any()}


def planted_vectors(n, dims, seed):
    """Clusters from pairs to hundreds, of vectors at cosines around the threshold, among unlinked ones; copies of some."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    at = 0
    for size in [2] * 100 + [10] * 20 + [300, 700]:
        x[at : at + size] = x[at] + rng.normal(size=(size, dims)) * rng.choice([0.1, 0.25, 0.35])
        at += size
    x[at : at + 400] = x[:400]
    return rng.permutation(x)


def brute_links(x, least=0.93):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return (unit @ unit.T >= least) & ~np.eye(len(x), dtype=bool)


def test_planted_links_in_a_large_shard_with_full_beams(spark):
    x = planted_vectors(5000, 32, 3)
    link = brute_links(x)
    assert link.sum(axis=1).max() > 4 * hnsw.FIRST_WIDTH  # beams fill up
    counts, links = hnsw.vector_links(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int"))
    assert {r["id"]: r["n_links"] for r in counts.collect()} == {i: int(n) for i, n in enumerate(link.sum(axis=1)) if n}
    parent = list(range(len(x)))
    find = lambda i: i if parent[i] == i else find(parent[i])
    for a, b in zip(*np.nonzero(link)):
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    assert {r["node"]: r["component"] for r in components(links).collect()} == {i: int(find(i)) for i in range(len(x)) if link[i].any()}


def test_recall_of_the_graph_and_a_missed_audit():
    x = planted_vectors(3000, 32, 5)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, none = hnsw.build(x, np.arange(len(x))), np.zeros(0, np.int64)
    truth = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.93))}
    found = set(zip(*(v.tolist() for v in hnsw.search_links(graph, x, 0.93, hnsw.FIRST_WIDTH, none))))
    assert found <= truth and len(found) >= 0.99 * len(truth)  # without any audit
    # level 0 cut into pieces: the search misses links, the audit finds that and widens until it agrees
    broken = hnsw.Graph(x, [np.where(np.arange(32)[None, :] < 2, graph.levels[0], -1), *graph.levels[1:]], graph.entry)
    missed = set(zip(*(v.tolist() for v in hnsw.search_links(broken, x, 0.93, 4, none))))
    audited = set(zip(*(v.tolist() for v in hnsw.search_links(broken, x, 0.93, 4, np.arange(len(x))))))
    assert len(missed) < len(truth) and audited == truth


def test_repeated_vector_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (3, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], VECTORS)
    found = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in hnsw.near_vectors(df).collect()), key=str)
    assert found == [(0, 0, None), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (3, 2, 1)]


def test_graph_recall_without_audits():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.build(x, np.arange(3000))
    picks = rng.integers(0, 3000, 200)
    near, who = hnsw.beam(graph, x[picks], 64, 0, hnsw.descend(graph, x[picks], 3000), 3000)
    truth = np.argsort(-(x[picks] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(who, truth)]) > 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [1.0, None], 1), (6, [1.0, nan], 1), (7, [1.0, inf], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 2), (100, [1.0, 1.0], 1), (200, [-1.0, -1.0], 3)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "0 AS id", "1 AS node", "2 AS n_links")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in hnsw.near_vectors(df.drop("n_links", "id", "node")).collect()}
    assert len(found) == len(rows) and found[1] == (1, 1, True) and found[2] == (1, 1, False) and all(found[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 100))
    best = topk.nearest(df).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in best} == {100, 200}
    assert [(r["vec_id"], r["score"]) for r in best if r["query_id"] == 100][:3] == [(2, 2 * 1024 * 1024), (1, 1024 * 1024), (8, 1024 * 1024)]
    nothing = spark.createDataFrame([], VECTORS)
    assert hnsw.near_vectors(nothing).count() == 0 and topk.nearest(nothing).count() == 0
    assert topk.nearest(spark.createDataFrame([(0, [1.0], 1)], VECTORS)).count() == 0


@pytest.mark.parametrize(("k", "block", "query_block"), [(1, 7, 3), (5, 16, 4), (10, 1000, 1000)])
def test_topk_blocks(spark, k, block, query_block):
    rng = np.random.default_rng(8)
    x = rng.integers(-30, 30, (90, 9))
    x[40:60] = x[:20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<long>")
    found = defaultdict(list)
    for r in topk.top_k(df.where("id % 10 = 0"), df, k=k, block=block, query_block=query_block).collect():
        found[r["query_id"]].append((r["rank"], r["id"], r["score"]))
    for q in range(0, 90, 10):
        scores = x @ x[q]
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:k]
        assert sorted(found[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def brute_top(x, of, k=10):
    big = x.astype(object)
    return {q: [(n + 1, i, -s) for n, (s, i) in enumerate(sorted((-int((big[q] * big[i]).sum()), i) for i in range(len(x)) if i != q)[:k])] for q in of}


def found_top(df, of, **options):
    found = {q: [] for q in of}
    for r in topk.top_k(df.where(f"id IN ({','.join(map(str, of))})"), df, **options).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["rank"], r["id"], r["score"]))
    return found


@pytest.mark.parametrize(("nodes", "listed"), [(1, 10), (2, 10), (3, 40), (4, 1000)])
def test_topk_phases(spark, nodes, listed):
    rng = np.random.default_rng(nodes)
    x = (rng.normal(size=(700, 12)) * 1000).astype(int)
    x[300:340] = x[:40]  # ties
    x[500:] = -np.abs(x[500:])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<long>")
    of = [0, 7, 310, 520, 699]
    assert found_top(df, of, nodes=nodes, listed=listed, block=64, query_block=2) == brute_top(x, of)


def test_topk_of_very_low_totals_few_candidates_and_repeated_rows(spark):
    rows = [(0, [1 << 20, 1 << 25]), (1, [-(1 << 28), -(1 << 28)]), (2, [1, 0]), (2, [1, 0]), (3, None), (None, [1, 1])]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    found = [(r["id"], r["score"]) for r in topk.top_k(df.where("id = 0"), df, k=3).orderBy("rank").collect()]
    assert found == [(2, 1 << 20), (1, -(1 << 48) - (1 << 53))]
    # sums beyond 64 bits on the way to a total that isn't
    far = spark.createDataFrame([(0, [1, 1 << 60]), (1, [-(1 << 60), 1]), (2, [5]), (3, [0, -(1 << 61)])], "id long, v array<long>")
    found = [(r["id"], r["score"]) for r in topk.top_k(far.where("id = 0"), far, k=2).orderBy("rank").collect()]
    assert found == [(2, 5), (1, 0)]
    with pytest.raises(Exception, match="a score leaves 64 bits: -"):
        topk.top_k(far.where("id = 0"), far).collect()
    with pytest.raises(OverflowError):
        topk.top_k(far.selectExpr("id", "transform(v, x -> x * 4) AS v").where("id = 0"), far.selectExpr("id", "transform(v, x -> x * 4) AS v"))
    doubles = spark.createDataFrame([(100, [1e3]), (1, [-1e9]), (2, [1.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in topk.nearest(doubles).orderBy("rank").collect()] == [2, 1]


def test_topk_of_large_components(spark):
    pad = [0.0] * 63
    df = spark.createDataFrame([(100, [200000.0, *pad]), (3, [150000.0, *pad]), (4, [160000.0, *pad])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in topk.nearest(df).orderBy("rank").collect()] == [(4, 33554432000000000), (3, 31457280000000000)]
    with pytest.raises(Exception, match="a component leaves 64 bits"):
        topk.nearest(spark.createDataFrame([(100, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()


@pytest.mark.parametrize(("bits", "nodes"), [(28, 2), (30, 2), (31, 1)])
def test_topk_of_large_components_equals_exact_integers(spark, bits, nodes):
    rng = np.random.default_rng(bits)
    x = rng.integers(-(1 << bits), 1 << bits, (150, 2))
    x[100:110] = x[:10]  # ties
    x[0] = [-(1 << bits), (1 << bits) - 1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<long>")
    of = [0, 5, 105, 149]
    assert found_top(df, of, nodes=nodes, listed=10, block=64, query_block=2) == brute_top(x, of)


def test_links_of_very_large_and_small_doubles(spark):
    rows = [(i + 10 * j, [a * 10.0**e, b * 10.0**e], 1) for j, e in enumerate((200, -200, 0)) for i, (a, b) in enumerate(((1.0, 0.1), (1.0, 0.11), (0.1, 1.0)))]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert found == {i + 10 * j: (5, 0) if i < 2 else (2, 2) for j in range(3) for i in range(3)}


#: Prose that makes the frequencies of a corpus.
PROSE = [" ".join(random.Random(i).choices("the of and to in is it that was for on with as are this be by from at have an not they or which you can all work license free use copy under version".split(), k=80)) for i in range(60)]


def licences_of(spark, rows):
    """(license, origin) by path of (path, text), among prose whose paths are elsewhere."""
    rows = [*rows, *[(f"prose/{i}/f", t) for i, t in enumerate(PROSE)]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, path string, text string")
    return {r["path"]: (r["license"], r["origin"]) for r in license_scan.scan(df.selectExpr("*", "1 AS license", "2 AS dir", "3 AS h1", "4 AS own", "5 AS `a.b`", "6 AS term")).collect()}


def test_licences(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/x/f", "some text\nmore"), ("a/y/COPYING", "licensed under cc by-nc 4.0"), ("a/y/z/f", "text"), ("b/f", "text"), ("a/x/g", ("text " * 60) + "\nLicensed under the Apache License, Version 2.0."), (None, "text"), ("a/x/h", None), ("b/q", "the license of the version")]
    found = licences_of(spark, rows)
    want = {"a/LICENSE": ("MIT", "own"), "a/x/f": ("MIT", "inherited"), "a/y/COPYING": ("CC-BY-NC-4.0", "own"), "a/y/z/f": ("CC-BY-NC-4.0", "inherited"), "b/f": (None, "none"), "a/x/g": ("Apache-2.0", "own"), None: (None, "none"), "a/x/h": ("MIT", "inherited"), "b/q": (None, "none")}
    assert {k: found[k] for k in want} == want and all(v == (None, "none") for k, v in found.items() if k not in want)


def test_licence_at_the_top_of_relative_paths(spark):
    found = licences_of(spark, [("LICENSE", MIT), ("src/x.py", "text"), ("src/deep/down/y.py", "text"), ("z.py", "text"), ("src/deep/COPYING", APACHE), ("src/deep/down/COPYING", "nothing of the kind")])
    assert found["src/x.py"] == found["z.py"] == found["prose/3/f"] == ("MIT", "inherited") and found["src/deep/down/y.py"] == found["src/deep/down/COPYING"] == ("Apache-2.0", "inherited")


HEADERS = [
    ("This project is released under the MIT License.", "MIT"), ("Distributed under the MIT License.", "MIT"), ("This dataset is licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("# SPDX-License-Identifier: MIT", "MIT"),
    ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("Licensed under the Apache License,\n# Version 2.0 (the \"License\")", "Apache-2.0"),
    ("it under the terms of the\nGNU General Public License, version 3.\nLicensed under the GNU General\nPublic License, version 3", "GPL-3.0"), ("Licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"),
    ("This work is licensed under CC BY 4.0", "CC-BY-4.0"), ("Some words before. Released under the MIT License. And words behind it that are no header.", "MIT"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/.", "MPL-2.0"),
]


def test_licence_headers_in_other_words_and_wrapped(spark):
    found = licences_of(spark, [(f"h/{i}/f", f"{PROSE[i]}\n{text}\n{PROSE[i + 1]}") for i, (text, _) in enumerate(HEADERS)])
    assert [found[f"h/{i}/f"] for i in range(len(HEADERS))] == [(name, "own") for _, name in HEADERS]


MIT = """MIT License

Copyright (c) 2024 The Authors

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GRANT = """   2. Grant of Copyright License. Subject to the terms and conditions of
      this License, each Contributor hereby grants to You a perpetual,
      worldwide, non-exclusive, no-charge, royalty-free, irrevocable
      copyright license to reproduce, prepare Derivative Works of,
      publicly display, publicly perform, sublicense, and distribute the
      Work and such Derivative Works in Source or Object form.
"""
#: Head, one section as often as makes the length of the whole, and notice.
APACHE = f"""                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

{GRANT * 25}
   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
"""


def test_full_licence_files(spark):
    files = [("a/LICENSE", MIT, "MIT"), ("b/license-apache-2.0.txt", APACHE, "Apache-2.0"), ("c/COPYING", APACHE, "Apache-2.0"), ("d/MIT-LICENSE.md", MIT, "MIT"), ("g/notes", MIT, "MIT")]
    other = [("e/license_scan.py", PROSE[0] + MIT[:60] + PROSE[1]), ("f/licensed.txt", APACHE)]
    rows = [(p, t) for p, t, _ in files] + other
    found = licences_of(spark, rows + [(f"{d}/x/y", "text") for d in "abcdefg"])
    assert len(APACHE) > 8000 and len(MIT.split()) > 160
    assert all(found[p] == (n, "own") and found[p[0] + "/x/y"] == (n, "inherited") for p, _, n in files)
    assert all(found[p[0] + "/x/y"] == (None, "none") for p, _ in other) and found["f/licensed.txt"] == ("Apache-2.0", "own")


def test_licence_anchors_lose_nothing():
    rng = random.Random(2)
    known = license_scan.templates()
    idf = {w: rng.uniform(1, 12) for _, _, count in known for w in count}
    anchor = set(license_scan.anchors(idf))
    for _, _, count in known:
        kept = {w: n * idf[w] for w, n in count.items()}
        rest = sum(x * x for w, x in kept.items() if w not in anchor)
        assert (rest / sum(x * x for x in kept.values())) ** 0.5 < license_scan.THRESHOLD


def test_licences_of_odd_rows(odd, empty):
    found = license_scan.licences(odd).collect()
    assert len(found) == odd.count() and {r["origin"] for r in found} == {"none"}
    assert license_scan.licences(empty).count() == 0


COMMON = "def self return import from in is not for if else value name data list item index count result".split()


def test_a_source_file_below_a_notice_is_no_licence_file(spark):
    notice = "Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n"
    rng = random.Random(5)
    everywhere = [(f"all/{i}/f", " ".join(COMMON)) for i in range(60)]  # words that all documents hold
    code = "\n".join(" ".join(rng.choices(COMMON, k=7)) for _ in range(30))
    found = licences_of(spark, [*everywhere, ("src/a/main.py", notice + code), ("src/a/other.py", "text"), ("src/a/b/deep.py", "text"), ("src/c/notice", notice), ("src/c/other.py", "text")])
    assert found["src/a/main.py"] == ("Apache-2.0", "own")
    assert found["src/a/other.py"] == found["src/a/b/deep.py"] == (None, "none") and found["src/c/other.py"] == ("Apache-2.0", "inherited")


def test_wrapped_notices_over_code(spark):
    import textwrap

    notices = {name: next(t for t in license_scan.TEXTS[name] if not t.startswith(("MIT", "ISC"))) for name in ("MIT", "BSD-3-Clause", "ISC")}
    rng = random.Random(6)
    code = lambda: "\n".join(f"fn_{rng.randint(0, 10**9):x}(arg_{rng.randint(0, 10**9):x}, {rng.randint(0, 10**9)})" for _ in range(60))
    wrapped = {(name, columns, i): "\n".join(f"{marker}{line}" for line in ["Copyright (c) 2020 Someone", *textwrap.wrap(notices[name], columns)]) for name in notices for columns in (60, 70, 80) for i, marker in enumerate(("", "# ", " * ", "// "))}
    rows = [(f"{name}/{columns}/{i}/f.py", f"{text}\n{code()}") for (name, columns, i), text in wrapped.items()]
    found = licences_of(spark, rows)
    assert {p: found[p] for p, _ in rows} == {p: (p.split("/")[0], "own") for p, _ in rows}

"""Exact copies, fill-in-the-middle and periodic runs against SQL, regular expressions and brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from folioscope.llm import fim, periodic, radix
from folioscope.llm.queries import op11_exact_dedup, op12_fim, op13_periodic_runs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("query, sql", [(op11_exact_dedup, radix.SQL), (op12_fim, fim.SQL)])
def test_queries_equal_their_sql(spark, sf_dir, query, sql):
    assert_same(query(spark, sf_dir).toPandas(), sql, sf_dir)


def assert_classes(rows, texts):
    """`rows` of radix.classes against (id, text) pairs, repeated ones too."""
    groups = defaultdict(list)
    for i, t in texts:
        groups[(t or "").translate(LOWER)].append(i)
    sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        by[r["text_sha256"]].append(r)
    assert {h: sorted(r["doc_id"] or -1 for r in rs) for h, rs in by.items()} == {h: sorted(i or -1 for i in ids) for h, ids in sha.items()}
    for h, rs in by.items():
        top = max((i for i in sha[h] if i is not None), default=None)
        assert {(r["keep_id"], r["group_size"]) for r in rs} == {(top, len(sha[h]))}
        assert [r["doc_id"] for r in rs if r["kept"]] == [top]


def test_exact_copies_of_all_kinds(spark, monkeypatch):
    rng = random.Random(3)
    stem = "".join(rng.choices("ab é😀\n", k=70_000))
    texts = [(i, stem[:n]) for i, n in enumerate((0, 1, 63, 64, 65, 200, 1023, 1088, 1089, 17_472, 20_000, 70_000))]  # prefixes of each other
    texts += [(100 + i, stem[:n].upper()) for i, n in enumerate((64, 1088, 17_472, 70_000))]
    texts += [(200 + i, "A" * n) for i, n in enumerate((63, 64, 64, 1088))] + [(300, "É"), (301, "é"), (302, None), (303, " "), (304, "\0"), (304, "\0"), (304, "\0x"), (None, "a"), (None, "A"), (None, "zz"), (None, "ZZ")]
    texts += [(i, "the same line") for i in range(1000, 1600)] + [(7, "the same line")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert_classes(radix.classes(df).collect(), texts)
    monkeypatch.setattr(radix, "FIRST", 1)  # one byte in the first round, two in the second
    monkeypatch.setattr(radix, "GROWTH", 2)
    assert_classes(radix.classes(df).collect(), texts)


def test_exact_copies_of_odd_rows(spark, odd, empty):
    pairs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert_classes(radix.classes(odd).collect(), pairs)
    stay = radix.dedup(odd)
    assert stay.columns == odd.columns
    got = [(r["text"] or "").translate(LOWER) for r in stay.collect()]
    assert sorted(got) == sorted({(t or "").translate(LOWER) for _, t in pairs})
    assert radix.classes(empty).collect() == [] and radix.dedup(empty).collect() == []
    dotted = spark.createDataFrame([(1, "x", 2), (2, "X", 3)], "`a.b` long, `t.x` string, grp int")
    assert [tuple(r) for r in radix.dedup(dotted, "a.b", "t.x").collect()] == [(2, "X", 3)]


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def strange(seed, n):
    rng = random.Random(seed)
    parts = ["a", "bc", "Zoë", "😀", " ", "\x1c", "\x85", "\x0b", "\x0d", "\t", "\n", " ", "  ", "       ", "<", "<P", "S>", ">", "word", "\0", "\x7f", "é" * 9]
    return ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(n)]


def test_units_in_words_equal_the_expression():
    texts = ["", " ", "a", "a ", " a", "12345678", "1234567 ", "12345678 ", "       8", "\t\n\x0b\x0c\r ", "é" * 4, *strange(1, 2000)]
    units = fim.Units([t.encode() for t in texts])
    found = [UNIT.findall(t) for t in texts]
    assert units.counts.tolist() == [len(f) for f in found]
    rng = random.Random(2)
    for _ in range(4):
        k = np.array([rng.randint(0, len(f)) for f in found])
        cut = units.cut(k)
        heads = ["".join(f[:i]) for f, i in zip(found, k)]
        assert cut.tolist() == [len(h.encode()) for h in heads]
        assert units.characters(cut).tolist() == [len(h) for h in heads]


def expected_fim(i, text):
    text = text or ""
    u = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[j : j + 8], 16) for j in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return i, len(u), "plain", None, None, text
    return (i, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}") if h4 % 100 >= 80 else (i, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")


def test_fill_in_middle_of_strange_and_odd_rows(spark, odd, empty):
    texts = list(enumerate(strange(5, 600) + ["a <P> b", "x<S>", "<M>", "<P", "a<P <S M>", None, "", " " * 300, "word " * 40_000]))
    made = fim.fill_in_middle(spark.createDataFrame(texts, "doc_id long, text string"))
    rows = made.withColumn("back", fim.restored(F.col("fim"), F.col("form"))).collect()
    want = {i: expected_fim(i, t) for i, t in texts}
    assert {r["doc_id"]: (r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["fim"]) for r in rows} == want
    assert all(r["back"] == (texts[r["doc_id"]][1] or "") for r in rows)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    got = fim.fill_in_middle(odd).collect()
    pairs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(repr, ((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["fim"]) for r in got))) == sorted(repr(expected_fim(*p)) for p in pairs)
    assert fim.fill_in_middle(empty).collect() == [] and {"source", "lang"} <= set(fim.fill_in_middle(empty).columns)
    dotted = fim.fill_in_middle(spark.createDataFrame([(3, "a b", 1)], "`a.b` long, `t.x` string, batch int"), "a.b", "t.x")
    assert dotted.columns == ["a.b", "batch", "fim", "n", "form", "prefix_chars", "middle_chars"] and dotted.first()["fim"] == expected_fim(3, "a b")[-1]


def runs_by_brute_force(words, least=12):
    """Every stretch by every period, smallest periods first."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and (i, j + q - i) not in found:
                found[i, j + q - i] = q
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def repeating(rng, alphabet):
    words = [rng.choice(alphabet) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 3)):
        p, at = rng.randint(1, 9), rng.randint(0, len(words))
        words[at:at] = [rng.choice(alphabet) for _ in range(p)] * rng.randint(2, 9)
    return words


@pytest.mark.parametrize("letters", [1, 2, 3, 8, 40])
def test_runs_equal_brute_force(letters, monkeypatch):
    rng = random.Random(letters)
    lists = [repeating(rng, [b"%d" % i for i in range(letters)]) for _ in range(400)] + [[], [b"a"], [b"a"] * 11, [b"a"] * 12, [b"a", b"b"] * 6, [b"a", b"b"] * 300]
    want = [runs_by_brute_force(x) for x in lists]
    for probes in (periodic.PROBES, 97):
        monkeypatch.setattr(periodic.lag_scan, "__defaults__", (periodic.LEAST, probes))
        found, stay = periodic.runs_of(lists)
        assert [[tuple(r) for r in f.tolist()] for f in found] == want
        assert stay == [collapsed(x, r) for x, r in zip(lists, want)]
    code, bounds = periodic.codes([w for x in lists for w in x]), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    parts = periodic.surviving(code, bounds)
    assert periodic.compared(code, *parts).tolist() == periodic.lag_scan(code, *parts).tolist()


def test_rare_words_split_again_and_again():
    # each round makes the next word of the chain a lone one
    words = [b"x"] + [w for i in range(30) for w in (b"k%d" % i, b"l%d" % i, b"k%d" % (i + 1))] + [b"p", b"q", b"r"] * 5
    starts, ends = periodic.surviving(periodic.codes(words), np.array([0, len(words)]))
    assert [words[s:e] for s, e in zip(starts, ends)] == [[b"p", b"q", b"r"] * 5]


def test_sums_that_agree_for_different_words_are_found_out():
    """Sums of powers modulo 2**64 agree for the two halves of a Thue-Morse word, whatever their numbers."""
    bits = [bin(i).count("1") % 2 for i in range(1 << 12)]
    words = [b"%d" % b for b in bits + [1 - b for b in bits]]
    code = periodic.codes(words)
    ends = np.array([0]), np.array([len(words)])
    assert periodic.lag_scan(code, *ends).tolist() == periodic.compared(code, *ends).tolist()


def test_long_periodic_documents(spark):
    text = "a " * 300_000
    words = [f"w{i % 7001}" for i in range(200_000)]
    rows = {r["doc_id"]: r for r in periodic.periodic_runs(spark.createDataFrame([(1, text), (2, " ".join(words))], "doc_id long, text string")).collect()}
    assert [tuple(r) for r in rows[1]["runs"]] == [(0, 300_000, 1)] and rows[1]["collapsed"] == "a"
    assert [tuple(r) for r in rows[2]["runs"]] == [(0, 200_000, 7001)] and rows[2]["collapsed"] == " ".join(words[:7001])


def changed(i, words):
    if i is None or not words or zlib.crc32(str(i).encode()) % 10:
        return words
    g, n = zlib.crc32(str(i).encode()) // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


def expected_runs(i, text):
    words = changed(i, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = runs_by_brute_force(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, " ".join(collapsed(words, runs)))]
    return (i, len(runs), *top, None if top[0] is None else 1000 * top[1] // top[2], *digests)


def test_op13_on_documents_and_odd_rows(spark, sf_dir, odd, empty):
    shorter = odd.where("length(text) < 6000 or text is null")
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    small = texts.where("length(text) < 9000")
    assert small.count() > 150
    ours = {r["doc_id"]: tuple(r) for r in op13_periodic_runs(spark, sf_dir).collect()}
    assert len(ours) == texts.count() and {ours[r["doc_id"]] for r in small.collect()} == {expected_runs(*r) for r in small.collect()}
    assert sum(r[1] > 0 for r in ours.values()) > 10
    assert sorted(map(repr, map(tuple, periodic.report(shorter).collect()))) == sorted(repr(expected_runs(r["doc_id"], r["text"])) for r in shorter.collect())
    assert periodic.report(empty).collect() == []
    dotted = periodic.periodic_runs(spark.createDataFrame([("b " * 12, "k", 1)], "`t.x` string, `a.b` string, key int"), "a.b", "t.x")
    assert dotted.columns == ["a.b", "key", "runs", "collapsed"] and dotted.first()["collapsed"] == "b"
    clash = periodic.periodic_runs(spark.createDataFrame([(1, "b " * 12, "other")], "id long, body string, text string"), "id", "body")
    assert clash.columns == ["id", "text", "runs", "collapsed"] and clash.first()["text"] == "other" and clash.first()["collapsed"] == "b"

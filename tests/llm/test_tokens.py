"""Encoding, decoding, counting and packing against the libraries."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as tokenizers_files
import pytest
import tiktoken
from tokenizers import Tokenizer

from folioscope.llm import bpe, packing, tokencount
from folioscope.llm.queries import op1_bpe, op2_token_counts, op8_packing

RANKS, JSON = (tokenizers_files.path(f"byte_bpe_50k.{x}") for x in ("tiktoken", "json"))


@pytest.fixture(scope="module")
def by_ranks():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=tokenizers_files.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def strange(n=400):
    rng = random.Random(7)
    parts = ["a", "Zoë", "'s", "'re", " ", "  ", "\n", "\t", " ", " ", "12", "３", "…", "<|endoftext|>", "😀", "é", "ﬀ", "the", " of", "\x1c", "\x85", "_", "中文", "x'll", ".", "$$$", "***", "word", "Größe", "_", "<|", "|>", "ende\nNeu,", "'"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(n)] + [" ", "a ", " a", "", "<|endoftext|>", "a <|endoftext|> b"]


def test_encoders_match_libraries_on_strange_texts(by_ranks, library):
    texts = strange()
    assert [x.tolist() for x in bpe.Encoder(RANKS).ids(texts)] == [by_ranks.encode_ordinary(t) for t in texts]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in bpe.Encoder(JSON, kept=10).ids(texts)] == want
    small = bpe.Encoder(JSON, kept=10)
    for part in (texts[:100], texts[50:200], texts[150:], texts):  # chunks met again, forgotten and learned anew
        assert [x.tolist() for x in small.ids(part)] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
    assert all(len(w) <= bpe.LONG_CHUNK for w in [*small.seen, *small.older])


def test_encoder_encodes_each_pre_token_once(library):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeéñß", k=rng.randint(1, 9))) for _ in range(80)]
    texts = ["".join(rng.choice(words) + rng.choice([" ", ", ", ".\n", " 12\n\n", "; "]) for _ in range(60)) for _ in range(100)]
    own, met = bpe.Encoder(JSON), []

    class Counted:
        def tokenize(self, word):
            met.append(word)
            return library.model.tokenize(word)

        def encode_batch_fast(self, parts, **options):
            met.extend(parts)
            return library.encode_batch_fast(parts, **options)

    own.model = own.library = Counted()
    assert [x.tolist() for x in own.ids(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(met) <= len({w for t in texts for w, _ in library.pre_tokenizer.pre_tokenize_str(t)})


def test_encoder_cuts_around_every_character_as_the_library_does(by_ranks, library):
    every = [chr(i) for i in range(0x3005)]
    texts = [f"a{c}b {c}1 {c} \n{c}\n {c}." for c in every] + ["|>", "a <|endoftext", "|> b", "x\n" * 70, "é" * 70 + " " + "é" * 70]
    assert [x.tolist() for x in bpe.Encoder(JSON).ids(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in bpe.Encoder(RANKS).ids(texts)] == [by_ranks.encode_ordinary(t) for t in texts]
    assert [len(x) for x in bpe.Encoder(JSON).ids(["", ""])] == [0, 0] and bpe.Encoder(JSON).ids([]) == []


def test_encoder_of_other_kinds_gives_whole_texts_to_the_library():
    path = tokenizers_files.path("word_bpe_49k.json")
    texts = strange(50)
    assert [x.tolist() for x in bpe.Encoder(path).ids(texts)] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_a_million_spaces(spark, library):
    blank = " " * 1_200_000 + "a"
    df = spark.createDataFrame([(1, blank), (2, "b")], "doc_id long, text string")
    ids = np.array(library.encode(blank, add_special_tokens=False).ids + [2], "<u4")
    rows = sorted((r for r in packing.packed(df, JSON).collect() if r["doc_id"] == 1), key=lambda r: r["piece"])
    assert sum(r["length"] for r in rows) == len(ids)
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in rows)
    assert {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(df, JSON).collect()} == {1: len(ids) - 1, 2: 1}


def test_op1(spark, sf_dir, by_ranks):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op1_bpe(spark, sf_dir).collect():
        ids = by_ranks.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        data = [by_ranks.decode_single_token_bytes(i) for i in ids]
        assert r["n_split"] == sum(0x80 <= d[0] < 0xC0 for d in data)


def test_offsets_and_round_trip(spark, odd):
    rows = bpe.decode(bpe.encode(odd.where("doc_id is not null"), RANKS, offsets=True).join(odd.select("doc_id", "text").distinct(), "doc_id"), RANKS).collect()
    assert len(rows) == odd.where("doc_id is not null").count()
    for r in rows:
        text = r["text"] or ""
        assert bytes(r["decoded"]).decode() == text and r["key"] == "x"
        if text:
            assert r["ids_start"][0] == 0 and r["ids_end"][-1] == len(text) and all(a < b for a, b in zip(r["ids_start"], r["ids_end"]))


def test_clashing_columns_and_bad_ids(spark):
    df = spark.createDataFrame([(1, "a b", "x", 7)], "doc_id long, text string, `a.b` string, ids_start int")
    row = bpe.decode(bpe.encode(df, JSON, offsets=True), JSON).first()
    assert row["a.b"] == "x" and bytes(row["decoded"]) == b"a b" and row["ids_start"] == [0, 1]
    for bad in (-1, 10**6):
        with pytest.raises(Exception, match="token id|IndexError"):
            bpe.decode(spark.createDataFrame([(1, [bad])], "doc_id long, ids array<int>"), JSON).collect()
    parts = spark.createDataFrame([(1, 5, 1, 2, 3), (1, 5, 1, 2, 3), (2, 6, 1, 2, 3)], "doc_id long, length long, _row int, sequence_id int, `x.y` int")
    found = packing.pack(parts, most=10).collect()
    assert len(found) == 3 and {r["_row"] for r in found} == {1} and {r["x.y"] for r in found} == {3} and len({r["sequence_id"] for r in found}) == 2


def test_split_characters():
    data = "a😀é".encode()
    assert bpe.readable([data[:2], data[2:4], data[4:]]) == ["a", "", "😀é"]
    assert bpe.readable([data[:3]]) == ["a�"] and bpe.readable([]) == []


def test_op2(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = op2_token_counts(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 512)


def test_splicing(spark, library):
    rng = random.Random(3)
    pool = strange(200)
    texts = ["".join(rng.choices(pool, k=60)) for _ in range(20)] + ["x" * 3000, " " * 3000, "ab " * 1500, "<|endoftext|>" * 200, "a<|endoftext|>b " * 150, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk, overlap in ((100, 20), (150, 40), (700, 64)):
        for r in tokencount.token_counts(rows, JSON, chunk=chunk, overlap=overlap).collect():
            want = len(library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids)
            assert r["n_tokens"] == want, (chunk, overlap, texts[r["doc_id"]][:80])


def test_counts_of_odd_rows(odd, empty):
    found = tokencount.token_counts(odd, JSON, chunk=5000).collect()
    assert len(found) == odd.count() and {r["n_tokens"] for r in found if r["doc_id"] in (2, 3)} == {0}
    assert tokencount.token_counts(empty, JSON).count() == 0


def check_packing(rows, most):
    fills, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        fills[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for parts in fills.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= most
    for parts in by_doc.values():
        at = 0
        for i, (piece, start, length) in enumerate(sorted(parts)):
            assert piece == i and start == at and (i == 0 or length == most)
            at += length
    return len(fills)


def test_op8(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op8_packing(spark, sf_dir).collect()
    bins = check_packing(rows, 1024)
    assert {r["doc_id"] for r in rows} == set(texts)
    assert bins <= 1.02 * -(-sum(r["length"] for r in rows) // 1024)
    for r in rows:
        ids = np.array(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [2], "<u4")[r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]


def test_packing_finds_a_perfect_packing(spark):
    lengths = [6, 4, 5, 5, 7, 3, 8, 2, 9, 1, 10] * 3
    rows = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long").selectExpr("doc_id", "piece", "CAST(0 AS long) AS start", "length")
    assert check_packing(packing.pack(rows, most=10).collect(), 10) == sum(lengths) // 10


@pytest.mark.parametrize(("lengths", "most"), [([1] * 700, 20), (list(range(1, 100)) * 9, 100), ([99, 98, 60] * 200, 100)])
def test_packing_over_several_blocks(spark, lengths, most):
    rows = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long").selectExpr("doc_id", "piece", "CAST(0 AS long) AS start", "length")
    found = packing.pack(rows, most=most, block=64).collect()
    assert len(found) == len(lengths) and check_packing(found, most) <= 1.05 * max(-(-sum(lengths) // most), sum(2 * n > most for n in lengths)) + 1


def test_crossover_keeps_every_item():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 60, 300)
    first, second = (packing.best_fit([], [], order, size, 100) for order in (list(range(300)), list(range(299, -1, -1))))
    child = packing.crossover(first, second, size, 100, rng)
    assert sorted(i for b in child.bins for i in b) == list(range(300))
    assert all(sum(size[b]) + r == 100 and r >= 0 for b, r in zip(child.bins, child.room))


def test_packing_of_odd_rows(odd, empty):
    assert {r["offset"] >= 0 for r in packing.packed(odd, JSON).collect()} == {True}
    rows = packing.packed(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), JSON).collect()
    check_packing(rows, 1024)
    assert [r["length"] for r in rows if r["doc_id"] == 2] == [1]
    assert packing.packed(empty, JSON).count() == 0

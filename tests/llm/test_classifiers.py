"""Toxicity, quality and the pipeline: held-out accuracy, odd rows, stages."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import cotrain, toxicity
from folioscope.llm.queries import op3_toxicity, op4_quality

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("query", "label", "least"), [(op3_toxicity, "toxic", 0.95), (op4_quality, "quality", 0.97)])
def test_held_out_accuracy(spark, query, label, least):
    scored = query(spark, SF)
    held = scored.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select((F.col("predicted") == F.col(label)).cast("int").alias("right"), "score").collect()
    assert len(held) > 500 and np.mean([r["right"] for r in held]) >= least
    assert all(0 <= r["score"] <= 1 for r in held)


@pytest.mark.parametrize("score", [toxicity.scores, cotrain.quality])
def test_odd_rows(score, odd, empty, labels):
    found = score(odd, labels).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert len({r["score"] for r in found if r["doc_id"] == 5}) == 1
    assert score(empty, labels).count() == 0
    assert score(odd, labels.limit(0)).count() == odd.count()


def test_grammar():
    lexicon = toxicity.Lexicon({"grub-": 5.0})
    one = lambda text: sum(lexicon.clauses(text))
    assert one("a clean clause. another one") == 0
    assert one("an idiot") == toxicity.SEED_WEIGHT and one("grubling here") == 5.0
    assert one("you idiot") > one("an idiot") > one("not an idiot") and one("he said idiot") < one("you idiot")
    # threats: intent, act, target; what stands between counts too
    assert one("we will kill you") > one("we will kill time") > one("kill you") == one("kill") > 0
    assert one("we will you kill") == one("we will kill") and one("we will of all the many things kill") == one("kill")
    assert one("we will not kill you") < one("we will kill you") and one("he wrote we will kill you") < one("we will kill you")
    assert one("you will go") == one("they said you must") == 0
    assert len(lexicon.clauses("idiot. fine. moron!")) == 2 and lexicon.clauses("") == []
    assert one("not today. an idiot") == one("an idiot")  # nothing reaches beyond a clause


def test_composition_is_the_product():
    state, first, second = 0, (0, 0), (0, 0)
    machines = (toxicity.insult_machine(), toxicity.threat_machine(), toxicity.negation_machine(), toxicity.report_machine())
    rng = np.random.default_rng(0)
    states = [0] * 4
    for symbol in rng.integers(0, 7, 2000).tolist():
        state, weight = toxicity.GRAMMAR[state, symbol]
        out = []
        for i, machine in enumerate(machines):
            states[i], w = machine[states[i], symbol]
            out.append(w)
        assert weight == pytest.approx((out[0] + out[1]) * out[2] * out[3])


def test_clause_scores_against_each_machine_alone():
    """The composed table gives, on random clauses, what a direct reading of the rules gives."""
    rng, lexicon = np.random.default_rng(1), toxicity.Lexicon({})
    vocabulary = ["idiot", "kill", "you", "will", "not", "said", "tree", "of"]
    for _ in range(300):
        words = rng.choice(vocabulary, rng.integers(1, 12)).tolist()
        since = lambda i, kind, reach: any(w in toxicity.SEEDS[kind] for w in words[max(0, i - reach) : i])
        total, left, acted = 0.0, 0, False
        for i, w in enumerate(words):
            factor = (toxicity.NEGATED if since(i, toxicity.NEGATION, toxicity.WINDOW - 1) else 1) * (toxicity.REPORTED if since(i, toxicity.REPORT, i) else 1)
            if w == "idiot":
                total += 4 * factor * (toxicity.AIMED if since(i, toxicity.TARGET, toxicity.WINDOW) else 1)
            if w == "kill":
                total += 4 * factor * (toxicity.INTENDED if left else toxicity.BARE)
                left, acted = (toxicity.NEAR, True) if left else (0, False)
                continue
            if w == "you" and acted and left:
                total += 4 * factor * toxicity.AT_TARGET
                left, acted = 0, False
            elif w == "will" and not (acted and left):
                left, acted = toxicity.NEAR, False
            else:
                left = max(0, left - 1)
        assert sum(lexicon.clauses(" ".join(words))) == pytest.approx(total)


def test_stems_are_learned_without_the_half_that_they_are_measured_on(spark):
    rows = [(f"zorkling {'grumpf' if half else 'blarth'} number", 1, half) for half in (0, 1) for _ in range(20)] + [("plain words of prose", 0, half) for half in (0, 1) for _ in range(60)]
    zero, one, both = toxicity.learn_stems(spark.createDataFrame(rows, "text string, y int, half int"))
    assert "zorkling" in zero and "zorkling" in one and "blarth" in zero and "blarth" not in one and {"blarth", "grumpf"} <= both.keys() and "prose" not in both


def test_odd_labels_names_and_repeated_ids(spark):
    rows = [(i, "good words of prose here" if i % 2 else "bad idiot scum !!", "en", f"s{i % 3}", 5, 1, 2, 3) for i in range(60)] + [(1, "good words of prose here", "en", "s1", 5, 1, 2, 3)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _n_chars int, _lang int, `a.b` int")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)] + [(7, 2, 2), (8, -1, None)], "doc_id long, quality int, toxic int")
    for found in (toxicity.with_score(df, labels), cotrain.with_score(df, labels)):
        assert found.columns == [*df.columns, "_score"] and found.count() == len(rows)
    assert toxicity.labelled(df, labels, "toxic", "doc_id", "text", 100).count() == len({i for i in range(60) if zlib.crc32(str(i).encode()) % 5})


def test_hashed_names_and_words():
    names = [f"{c}_commoncrawl" for c in "abcdefghijkl"]
    assert len(set(cotrain.hashed(names).argmax(axis=1))) > 4 and cotrain.hashed([None]).sum() == 0
    x = cotrain.hashed_words(["a b a b c", "a b a b c", "", "c b a"])
    assert np.allclose(np.linalg.norm(x, axis=1), [1, 1, 0, 1]) and (x[0] == x[1]).all() and not np.allclose(x[0], x[3])
    from folioscope.llm.common import mix, word_hashes

    want = np.zeros(cotrain.WORDS)
    a, b, c = word_hashes(["a b c"])[0]
    for h in [a, b, c, *(mix(np.array([x * np.uint64(3) + y]))[0] for x, y in ((a, b), (b, c)))]:
        want[int(h % np.uint64(cotrain.WORDS))] += 1
    want = np.log1p(want)
    assert np.allclose(cotrain.hashed_words(["a b c"])[0], want / np.linalg.norm(want))


def test_cotraining_uses_the_pool():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 2000).astype(float)
    views = [np.column_stack([y * 2 - 1 + rng.normal(size=2000), rng.normal(size=(2000, 3))]) for _ in range(2)]
    few = np.arange(80)
    model = cotrain.cotrain([v[few] for v in views], y[few], few % 5 == 0, [v[80:1500] for v in views], np.arange(1420) // 400, 4, 0.05)
    assert ((model.score([v[1500:] for v in views]) >= 0.5) == y[1500:]).mean() > 0.85


def test_pipeline(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    judged = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now <= ids and docs.count() == len(now)
        if name == "line_dedup":
            assert now == ids
        if name == "quality":
            clean = {r["doc_id"] for r in judged.where("quality = 1").collect()}
            assert len(clean & ids - now) <= 0.02 * len(clean)
        ids = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == ids
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == ids


def test_pipeline_of_odd_rows(odd, empty, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for start in (odd, empty):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(start.sparkSession, docs, sf_dir)
            docs.count()


def test_pipeline_keeps_columns_of_any_name(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).selectExpr("*", "7.0D AS _score", "doc_id AS `a.b`", "1 AS key", "2 AS row")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r["_score"] == 7.0 and r["a.b"] == r["doc_id"] for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).where("doc_id is not null").count() >= 40

"""A corpus pipeline of five stages: quality, toxicity, line dedup, near-duplicate removal, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession

from folioscope.llm import cotrain, linededup, packing, probminhash, toxicity
from folioscope.llm.common import named, shared_folder, table, unused
from folioscope.llm.queries import tokenizer


def columns(docs: DataFrame) -> list[Column]:
    """The columns of `docs` by their exact names, which may hold dots."""
    return [named(c) for c in docs.columns]


def kept(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """The rows of `docs` whose id `verdict` names, with all their columns; rows with a null id, which nothing judges, stay."""
    judged = docs.join(verdict.select("doc_id").distinct(), "doc_id", "left_semi").select(*columns(docs))
    return judged.unionByName(docs.where("doc_id is null"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, each row judged by its own text and metadata; no text is shuffled. Null and empty texts and nulls in
    the metadata are scored like others, as no value; repeated rows are judged alike and stay or go together, a null id changes nothing, an empty
    table stays empty. All columns stay, whatever their names; `lang`, `source` and `n_chars` may be missing.
    """
    score = unused(docs, "_score")
    return cotrain.with_score(docs, table(spark, sf_dir, "labels"), score=score).where(named(score) >= 0.5).select(*columns(docs))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar doesn't reject, each row judged by its whole text, however long; no text is shuffled. Null and empty texts get the score of texts
    without clauses; repeated rows stay or go together, rows with a null id are judged too, an empty table stays empty. All columns stay, whatever their names.
    """
    score = unused(docs, "_score")
    return toxicity.with_score(docs, table(spark, sf_dir, "labels"), score=score).where(named(score) < 0.5).select(*columns(docs))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier line of them or of a document of a smaller id. Null texts stay null, a text that loses all its lines becomes empty,
    rows with a null id and texts without repeats stay as they are; all columns stay, whatever their names.
    """
    return linededup.dedup(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near duplicates, with all rows of its id and all columns. Null and empty texts have no shingles
    and no duplicates; rows with a null id stay; an empty table stays empty.
    """
    return kept(docs, probminhash.classes(docs).where("kept"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' pieces in training sequences: null and empty texts are a piece of one id, longer texts several pieces; repeated rows and null ids have pieces
    of their own. Only ids and places are returned, so that no column can clash.
    """
    return packing.packed(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality", good_quality),
    ("toxicity", civil),
    ("line_dedup", unique_lines),
    ("near_dedup", distinct_documents),
    ("packing", sequences),
]

#: Fitted classifiers and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from `documents`, each written as Parquet to the shared checkpoint folder and read again."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = f"{folder}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs

"""The corpus pipeline: documents in, token ids' digests out. Each stage's result is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codestrata.llm import bpe, langid, mixture, near_dup, substring_dup
from codestrata.llm.common import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found stay: those that are null or hold no letter go. The filters learn from the
    training folds of this stage's own input."""
    model = langid.fit(langid.train_rows(docs.select("doc_id", "text", "lang")))
    return langid.keep_known(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id. Null and empty texts and rows
    without doc_id are linked with nothing and stay; of repeated rows with one doc_id all stay or go."""
    return near_dup.keep_one(docs, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too, and keeps, are cut out of the texts; a document without a word left goes.
    Null and empty texts, rows without doc_id and passages under 50 words stay as they are."""
    return substring_dup.remove(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: 0.8 of all tokens by the weights of mixture.WEIGHTS; a document may be taken twice. Null domains, languages
    and sources are leaves of their own, rows with one doc_id are taken together, and all columns stay as they are."""
    return mixture.mixed(docs, budget=0.8, epochs=2)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text's ids and of the text decoded from them; null and empty texts have none
    and the digests of an empty string, repeated rows a row each."""
    return bpe.digest(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixing", mixing), ("encoding", encoding)]

#: The stages' models and similarity joins are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force on
#: its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

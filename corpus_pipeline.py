"""A training corpus from the documents table, in five stages, each one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of `docs`. ORACLE_SQL is None: the stages are tested against brute force instead.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm import language, mixing, near_duplicates, packing, pii
from sedge.llm.common import boxed, staged, table

ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter go, and so do those whose best language stays below even odds."""
    model = language.learn(docs.filter(~language.held_out("doc_id")))
    judged = language.identify(boxed(docs), model, ["_row"], "_row.text")
    return judged.filter("lang_pred <> 'und' and score >= 0.5").select("_row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.keep_one_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked in the texts."""
    return pii.mask_personal_data(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

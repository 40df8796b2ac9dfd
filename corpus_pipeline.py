"""A corpus pipeline: language, toxicity, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before kept, and
all but the last return the columns of documents.  run() writes each stage's result to the
shared folder and reads it again, so a lost executor costs one stage's tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import jaccard, langid, mixing, packing, toxicity
from graphloom.llm.common import only_result, sparing, table
from graphloom.llm.queries import vocabulary

#: Score from which the toxicity stage rejects a document.
TOXIC = 0.7


@sparing
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; models are fit on a bounded sample of docs with a lang.

    Null, empty and blank texts and those without a letter go; very long ones are read whole; repeated rows go
    or stay together; an empty table stays empty; columns of any name pass."""
    models = langid.train(docs)
    return langid.identify(docs, models, "__language").filter(~F.col("__language.rejected")).drop("__language")


@sparing
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't score as toxic; the model is fit on a bounded sample of labelled ones.

    Null and empty texts stay; very long ones are read whole; repeated rows go or stay together; without labels of
    both classes all stay; an empty table stays empty; columns of any name pass."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, "__toxicity").filter(F.col("__toxicity.score") < TOXIC).drop("__toxicity")


@sparing
def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    Null, empty and blank texts link with nothing and stay, each row; repeated rows, null ids and one id on
    different texts keep one row a group; an empty table stays empty; columns of any name pass."""
    return jaccard.one_of_each(docs, 5, 80)


@sparing
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, each row by itself.

    A null source is one of its own; texts without words take no part of a target, and rows of one key are taken
    in a fixed order; an empty table stays empty; columns of any name pass."""
    return mixing.mixed_documents(docs, mixing.quality_weights(table(spark, sf_dir, "labels")))


@sparing
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 2048 tokens.

    Null and empty texts are a document of the end alone; long ones are cut in pieces; repeated rows are packed each
    for itself; an empty table gives no piece."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language),
    ("toxicity", clean),
    ("ngram_jaccard_join", distinct_texts),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]

#: Language models, toxicity and token ids have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = only_result(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to packed sequences: five stages, each written and read again before the next.

Every stage takes nulls in any column, empty and very long texts, ties, repeated
rows, empty tables and further columns of any name; those columns pass through
unread, to the last stage but one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm import common, exact_dedup, mixing, packing, simhash_anchor, toxicity_crf

#: A document goes if its score is at least this.
REJECT = 0.7


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field, learnt from the labelled ones among them, doesn't call toxic.

    A null or empty text is not toxic; each of repeated rows is judged for
    itself. Without labels of both kinds, or without documents, nothing is
    rejected.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity_crf.learn(docs, labels.filter(~toxicity_crf.held_out()))
    return common.carrying(docs, ["doc_id", "text"], lambda own: toxicity_crf.score(own, model, keep=True).filter(F.col("__score") < REJECT))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, white space aside: that of the smallest id (null last).

    Null counts as empty. Of rows that agree in id and text one stays.
    """
    return exact_dedup.drop_copies(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by five-word shingles of similarity 0.8 or more, the row of the smallest id (null last).

    All texts without words are one group. SimHash anchors link what is a few
    bits apart; the links of alike texts farther apart are found exactly.
    """
    return simhash_anchor.drop_near(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last time perhaps with their first words only.

    Sources, null among them, take their weights in order. Documents without
    words take no part.
    """
    return mixing.mixed_texts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix's documents and their places in sequences of 2048 tokens; each row is a document of its own."""
    return packing.pack(docs)


STAGES = [("toxicity", clean), ("exact dedup", unique), ("near dedup", distinct), ("mixing", mixed), ("packing", packed)]

#: Learnt scores, SimHash and a tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

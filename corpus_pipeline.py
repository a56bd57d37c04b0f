"""Documents to packed training sequences, in stages that each read what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import packing, simhash_bk, suffix_dedup, zdict_tox
from millrace.llm.common import cut, release, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the classifier is fitted on labelled documents that aren't held out."""
    return zdict_tox.drop_toxic(docs, zdict_tox.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest doc_id."""
    return simhash_bk.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a 200-byte string that starts twice goes from the texts; documents stay, emptied ones too."""
    return suffix_dedup.strip(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a training sequence."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_dedup", near_dedup),
    ("suffix_dedup", passages),
    ("packing", packed),
]
#: SQL can't express hashing to fingerprints, trained models or tokenizers; a test compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; each one's table goes when the next one's stands."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        done = cut(stage(spark, docs, sf_dir))
        release(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)

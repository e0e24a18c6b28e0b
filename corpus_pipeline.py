"""Corpus pipeline: quality classifier, SimHash near-dedup, masking of personal data, source mixing, packing.

Every stage takes the documents that its predecessor kept, as a table, and all but the last return the columns of documents, whatever their names.
Nulls in any column are left alone; an empty table gives no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import mix, packing, pii, quality, simhash
from veilspark.llm.common import stash, table
from veilspark.session import ship_package

#: No SQL trains the network or the tagger.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject: those that score 0.5 or more, so are likelier good than bad.

    That is below ``quality.GOOD``, from which op5 predicts 1: the stage drops only what is likelier bad. Null and empty texts share one score; equal
    texts have equal scores, so repeated rows stay or go together; long texts are read whole; without labels all stay.
    """
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id, once.

    Null and blank texts are copies of each other. Rows without a doc_id stay but for exact copies; different texts of one doc_id stay together.
    """
    return simhash.deduplicated(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and ``n_chars`` counted anew (null for null texts); whole texts are masked, and repeated rows alike."""
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for every copy that the mix takes; a null source is one of its own, and rows of one doc_id are taken equally often."""
    return mix.mixed_docs(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences and places; null and empty texts are one id, and repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", drop_near_copies),
    ("personal data", mask_personal_data),
    ("source mixing", mix_to_weights),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

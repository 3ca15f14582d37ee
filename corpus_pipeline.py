"""The corpus pipeline: documents in, packed training sequences out.

Five stages, each of which works on all that the one before kept: toxic documents
go, one document of each group of equal texts stays, one of each group of near
duplicates stays, personal data is replaced, and what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclens.llm import pii, toxicity
from civiclens.llm.common import DOCUMENT_COLUMNS, table, trimmed, written
from civiclens.llm.content_sort import drop_exact_duplicates
from civiclens.llm.jaccard_join import jaccard_components
from civiclens.llm.packing import pack_documents
from civiclens.session import ship_package

NEAR_WORDS, NEAR_PERCENT = 5, 80
END_ID = 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more as toxic go; the rest stay as they are."""
    docs = _documents(spark, docs)
    model = trimmed(toxicity.train(*toxicity.labelled_sample(docs, table(spark, sf_dir, "labels"), held_out=None)))
    return toxicity.drop_toxic(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the largest doc_id."""
    return drop_exact_duplicates(_documents(spark, docs), keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest doc_id.
    Rows with a NULL id stay."""
    docs = _documents(spark, docs)
    groups = jaccard_components(docs, NEAR_WORDS, NEAR_PERCENT).select("doc_id", "component_id")
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*DOCUMENT_COLUMNS)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is replaced; ``n_chars`` follows the text."""
    docs = _documents(spark, docs)
    clean = pii.redact_documents(docs, trimmed(pii.fit(pii.sample_texts(docs))))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(
        *DOCUMENT_COLUMNS
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return pack_documents(_documents(spark, docs), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


def _documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    ship_package(spark)
    return docs.select(*DOCUMENT_COLUMNS)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("PII", redact_pii),
    ("best-fit packing", pack),
]

#: SQL has no form of the learned stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline: rules, exact and near copies out, sources mixed, tokens counted.

Each stage takes (spark, docs, sf_dir), and its result is written as Parquet and read again as the next one's docs.
Labels teach the first stage; they are joined by doc_id.  The mix may repeat a document, so the last stage has a row for
each time it is taken.  What a stage has written goes when the next one's result is there.

Defined cases, by stage: null and empty texts fail the first stage's base rule.  Stages alone treat them so: `exact` takes null
as empty and keeps one of them, `near` keeps each, `mix` never takes them (size 0) but where their source's documents are all
taken, `encode` gives no ids.  A null doc_id is a document like others, but loses ties in `exact` and is kept by `near`; rows
that repeat a doc_id and text are one document in `exact`, which leaves one.  Long texts are read whole.  An empty table stays
empty.  Columns of any name, also those that the operators use, pass through all stages but the last, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sulcus.llm import exact_dedup, mixing, near_dedup, quality_rules, sentencepieces
from sulcus.llm.common import clear, documents, new_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep; see the module for all defined cases."""
    return quality_rules.filter_documents(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal ones: the longest, then the smallest doc_id."""
    return exact_dedup.filter_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the smallest doc_id."""
    return near_dedup.filter_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    return sentencepieces.encode(docs, digests=True).withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: SQL can't say the learned rules, the signatures or the encoding; tests/llm holds run()'s rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = documents(spark, sf_dir), []
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        clear(spark, old)
        old = [path]
    return docs

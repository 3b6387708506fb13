"""A training corpus from raw documents: toxic texts out, near copies out, repeated passages
cut, test items out, the rest packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns the documents it leaves, with the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldmill.llm import decontaminate, packing, simhash, substring, toxicity
from fieldmill.llm.common import table, texts, written
from fieldmill.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels, does not reject."""
    ship_package(spark)
    return toxicity.accepted(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (three-word SimHash, 3 bits or fewer) the document with the least id."""
    ship_package(spark)
    return simhash.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier document has."""
    ship_package(spark)
    return substring.rewritten(docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    ship_package(spark)
    return decontaminate.clean(docs, decontaminate.test_items(spark, sf_dir))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    ship_package(spark)
    return packing.packed(texts(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("test_items", drop_test_items),
    ("packing", pack),
]

#: SQL cannot express a trained classifier, fingerprints or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage leaves is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

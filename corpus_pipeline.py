"""The corpus pipeline: operators of pixelweave.llm applied one after another to documents.

Each stage takes all that its predecessor kept and its decisions take effect: toxic documents go, of each group of
near duplicates one document stays, personal data are replaced in the texts, documents are repeated or left out as the
mix asks, and what is left is packed. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixelweave.llm import mixing, ngram_join, packing, sanitise, toxicity
from pixelweave.llm.common import ship_by_value, table, written

ship_by_value()


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise.sanitised(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", without_near_copies),
    ("PII", without_personal_data),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: Trained trees, tokenisers and the packing plan have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs

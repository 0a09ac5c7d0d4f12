"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept;
all but the last return the columns of documents. run() writes each stage's rows as
Parquet to the folder that the executors share, and reads them again.

* quality: documents that the positive-unlabelled classifier scores below 0.3 go.
* language: documents without a letter, or with no language at 0.5 or more, or with too few
  of its words, go.
* near_dup: of each class of near duplicates, the document of the smallest id stays.
* packing: documents become pieces of sequences of 2048 tokens.

Models are fitted on what the stage gets. Rows without a doc_id are never duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from iterix.llm import language_id, near_dup, packing, quality
from iterix.llm._links import table_path
from iterix.session import ship


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return language_id.accepted(docs, language_id.fit(docs.where(~language_id.held_out(4, 2))))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dup.one_of_each(docs)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", by_quality),
    ("language", by_language),
    ("near_dup", one_of_each),
    ("packing", into_sequences),
]

#: No stage but the third could be SQL, and its verified similarities over whole tables are too slow there.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage makes of the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = table_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to packed windows: five stages, each an operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import exact_dedup, language_id, mixing, ngram_join, packing
from corpusmill.llm.shared import scope, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language was determined (operator 6).

    Null texts, empty ones and those without letters go. Rows of one doc_id
    are judged each by itself; repeated rows alike; no rows give none.
    """
    return language_id.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts (operator 2).

    Null is an empty text. Of rows that repeat doc_id and text one stays; rows
    of other texts stay, whatever doc_id they share; a row without a doc_id
    stays only where none of its group has one. No rows give none.
    """
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of similar texts (operator 9): five words, 0.8.

    Texts without words, null ones among them, stay. Repeated rows, shared and
    missing doc_ids as in exact dedup. No rows give none.
    """
    return ngram_join.keep_one(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which the mix takes words (operator 7), once for each epoch.

    Texts without words stay once. A null source is one of its own; repeated
    rows are rows. No rows give none.
    """
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces and their windows (operator 8).

    A text without words, or null, has one piece in no window. Repeated rows
    are packed as rows, never two in one window. No rows give none.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_windows),
]

#: SQL expresses neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; what each one keeps is written for the next.

    What a stage wrote besides is deleted as soon as the next one has its rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scope(spark):
            docs = stored(stage(spark, docs, sf_dir), f"stage-{k}", keep=True)

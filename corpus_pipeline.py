"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last
return the columns of ``documents``; every result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelcycle.llm.mixing import mixed_rows
from panelcycle.llm.ngram_join import keep_one_per_group
from panelcycle.llm.packing import pack_documents
from panelcycle.llm.quality_cnn import keep_good
from panelcycle.llm.suffix_dedup import PASSAGE_BYTES, without_repeats
from panelcycle.llm.tables import read_table
from panelcycle.session import materialize


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays."""
    return keep_one_per_group(docs)


def unrepeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of ``PASSAGE_BYTES`` that occur elsewhere too are cut from the texts."""
    return without_repeats(docs, length=PASSAGE_BYTES)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources reach their target weights."""
    return mixed_rows(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", distinct_documents),
    ("suffix-array dedup", unrepeated_text),
    ("mixing sources", mixed_sources),
    ("packing", packed_sequences),
]

#: The classifier, the MinHash join and the tokenizer are beyond SQL; tests hold every stage and run() against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-stage-{place}")
    return docs

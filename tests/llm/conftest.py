from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, source]) tuples."""

    def build(rows):
        return spark.createDataFrame(
            [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows], DOCUMENTS
        )

    return build


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return {r.doc_id: r.text for r in rows}


@pytest.fixture(scope="session")
def query(spark, sf_dir):
    from panelcycle.llm.queries import LLM_QUERIES

    return lambda name: [r.asDict() for r in LLM_QUERIES[name](spark, sf_dir).collect()]



"""Small documents that hold what operators must bear."""

import pytest
from edge_cases import EDGES
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with further columns, named like results and helpers of operators."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_tokens", T.StringType()), T.StructField("fp", T.StringType()),
        T.StructField("digest", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("path", T.StringType()),
    ])

    def make(rows, langs=None):
        full = [(i, t, (langs or {}).get(i), "s", "x", "x", "x", "x", None) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def edges(make_docs):
    return make_docs(EDGES)

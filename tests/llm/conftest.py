import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with extra columns whose names clash with results and helpers."""

    def build(pairs, extra=True):
        schema = "doc_id long, text string" + (", n_words string, score string, component long, h string, id string, row string" if extra else "")
        rows = [(i, t, *(["x", "y", 7, "z", "q", "r"] if extra else [])) for i, t in pairs]
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture
def empty_docs(spark):
    return spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))

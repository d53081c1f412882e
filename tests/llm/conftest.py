import os

import pytest
from pyspark.sql import types as T

DATA = "/root/testdata/sf0.001"

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()),
                     # extra columns whose names clash with the operators' own
                     T.StructField("row", T.StringType()), T.StructField("h", T.LongType()),
                     T.StructField("bucket", T.IntegerType()), T.StructField("score", T.DoubleType())])


def rows_of(texts, first=0):
    return [(i, t, "en", "s", None if t is None else len(t), "r", 1, 2, 0.5) for i, t in enumerate(texts, first)]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with clashing extra columns from texts, or from (id, text) pairs."""
    def make(texts):
        pairs = texts if texts and isinstance(texts[0], tuple) else list(enumerate(texts))
        return spark.createDataFrame([(i, *rows_of([t])[0][1:]) for i, t in pairs], DOCS)
    return make


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def given(spark, sf_dir):
    """The whole given documents as (doc_id, text)."""
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())


#: Null, empty, blank, tie, repeated row, null id, cut emoji, very long text.
ODD = [(0, None), (1, ""), (2, " \n\t"), (3, "one two three"), (3, "one two three"), (None, "no id here"), (None, "no id here"),
       (4, "é漢🙂 " * 40), (5, "word " * 60_000), (6, "x" * 200_000), (7, "The same, the same. THE SAME;" * 9)]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(ODD)


@pytest.fixture(scope="session")
def odd_rows():
    return ODD

import pytest
from pyspark.sql import types as T

#: texts that every operator must stand: null, empty, blanks, symbols, one word, ties, other scripts, very long
EDGE_TEXTS = [None, "", " \n\t ", "!!!", "word", "word", "Ünïcödé 東京 ß", "a" * 5000, "lorem ipsum dolor " * 20_000, "\x00\x1f nul"]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) rows, with extra columns whose names clash with results."""
    schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("score", T.DoubleType()), ("id", T.StringType()), ("copies", T.LongType()), ("n", T.LongType()))])

    def make(rows):
        return spark.createDataFrame([(i, t, "en", 0.5, "x", 7, 1) for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def edge_docs(docs_of):
    return docs_of([*enumerate(EDGE_TEXTS), (None, "no id"), (3, "!!!"), (4, "word")])

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


@pytest.fixture
def table(spark):
    """Documents from rows (doc_id, text, lang, source); n_chars follows from the text."""

    def make(rows):
        full = [(i, t, lang, source, len(t) if t is not None else None) for i, t, lang, source in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Null ids, texts, labels and sources; empty, blank and one-word texts; copies; repeated rows; a long text.
ODD = [
    (None, "a row without an id", "en", "s1"),
    (1, None, "en", "s1"),
    (2, "", "en", None),
    (3, "   \n\t ", None, "s2"),
    (4, "word", "fr", "s2"),
    (5, "the cat sat on the mat and looked at the dog", "en", "s1"),
    (6, "the cat sat on the mat and looked at the dog", "en", "s2"),
    (7, "the cat sat on the mat and looked at the dog", None, None),
    (8, "The  cat sat on the mat\nand looked at the dog", "en", "s1"),
    (9, "unrelated words that share nothing with other rows here", "en", "s3"),
    (9, "unrelated words that share nothing with other rows here", "en", "s3"),
    (10, "naïve café — 東京 \U0001f600 don't we'll 12345", "fr", "s3"),
    (11, "lorem ipsum dolor " * 40000, "es", "s1"),
    (-12, "x" * 5000, "es", "s1"),
]


@pytest.fixture
def odd(table):
    return table(ODD)


@pytest.fixture
def empty(table):
    return table([])

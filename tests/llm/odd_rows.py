import pytest


NASTY = [None, "", " ", "\n\t", "a", "é" * 50, "́\U0001f600 x\u0000y", "word " * 30_000, "x" * 200_000]


@pytest.fixture
def documents(spark):
    """Documents from texts, with ids in order and two columns of clashing names."""

    def make(texts, first=0):
        rows = [(first + n, text, "k", 1.5, len(text or "")) for n, text in enumerate(texts)]
        return spark.createDataFrame(
            rows, "doc_id long, text string, key string, score double, n_chars long"
        )

    return make


@pytest.fixture
def nasty(documents, spark):
    """Nulls in every column, empty and very long texts, repeated rows."""
    rows = documents(NASTY)
    nulls = spark.createDataFrame([(None, None, None, None, None), (None, "a b c", None, None, 5)], rows.schema)
    return rows.unionAll(rows).unionAll(nulls)


@pytest.fixture
def empty(documents):
    return documents([])

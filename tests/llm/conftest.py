import os

import pytest

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality long, toxic long"


@pytest.fixture(scope="session")
def data(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()


@pytest.fixture(scope="session")
def pandas_docs(docs):
    return docs.toPandas().sort_values("doc_id")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    passage = " ".join(f"word{i}" for i in range(80))
    rows = [
        (1, passage, "en", "a", 10), (1, passage, "en", "a", 10), (2, passage + " end", None, None, None), (3, None, "en", "a", 0), (4, "", "en", None, 0), (5, " \t\n ", "de", "b", 4),
        (None, "one two three", "de", "b", 13), (None, None, None, None, None), (6, "x " * 60_000, "fr", "b", 120_000), (7, "single", "fr", "a", 6), (8, "a b", "fr", "a", 3), (9, "É ñ <|endoftext|> 日本 😀", "es", "c", 20),
        (-5, passage, "en", "c", 10), (1 << 40, passage.replace("word7 ", "other "), "en", "c", 10),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (None, 1, 1), (7, None, None), (99, 1, 1)], LABELS)

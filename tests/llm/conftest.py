import pytest

#: Rows that every text operator must take: null, empty, blank, very long, repeated and tied texts, a null id, clashing column names.
HARD = [
    (1, None, "en"),
    (2, "", "en"),
    (3, "  \n\t ", None),
    (4, "word " * 30_000, "en"),
    (5, "Same text here, twice.", "en"),
    (6, "Same text here, twice.", "de"),
    (7, "Same text here, twice.", "de"),
    (8, "Été 中文 \U0001f600 näive x", "fr"),
    (None, "a text of no document id", "en"),
    (9, "x", "en"),
]
SCHEMA = "doc_id long, text string, bucket string, at string, kept string, score string, key string, lang string"


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame([(i, t, "b", "a", "k", "s", "y", lang) for i, t, lang in HARD], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")

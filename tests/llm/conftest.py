import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and blank texts, repeated rows, ties, other alphabets, odd spaces.
EDGES = [
    (1, None, None, None, None), (2, "", "en", "b", 0), (3, " \t\n\x0b\f\r ", "en", "a", 7), (4, "one", "en", "a", 3), (5, "One\nTwo \n two\n\nthree", None, "a", 9),
    (5, "One\nTwo \n two\n\nthree", None, "a", 9), (5, "another text under one id", "en", None, 3), (None, "no id here at all", "en", "c", 4), (None, "no id here at all", "en", "c", 4),
    (6, "é ü  日本語 😀  x", "fr", "é", 1), (7, "a b " * 4000, "en", "b", 1), (-8, "x\r\ny\tz", "en", "a", 2),
]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(df, *names):
    """``df`` with columns named like an operator's outputs."""
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("own").alias(n) for n in names))


@pytest.fixture(scope="session")
def sf(tmp_path_factory):
    return "/root/testdata/sf0.001"

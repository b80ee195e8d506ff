import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows, and columns named like those inside operators."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    prose = "the quick brown fox jumps over the lazy dog and then runs home again before dark"
    rows = [
        (1, prose, "en", "a", 10), (2, None, "en", "a", None), (3, "", None, None, 0), (4, long, "en", "a", len(long)), (5, prose, None, "b", 5), (5, prose, None, "b", 5),
        (6, prose.replace("lazy", "sleepy"), "en", "b", 3), (7, " \n\n ", "fr", "b", 4), (8, prose + "\n" + prose.replace("home ", ""), "de", "c", 1), (9, "é" * 5000 + " 😀", "de", None, 2), (None, prose, "en", "a", 1), (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "1 AS id", "'x' AS key", "2 AS h1", "3 AS norm", "4 AS score", "5 AS n", "6 AS label")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 3 > 0, i % 2) for i in range(1, 7)] + [(None, None, None), (2, None, None)], "doc_id long, q boolean, toxic int").selectExpr("doc_id", "CAST(q AS int) AS quality", "toxic")

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, score string, _row string, length string, verdict string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns whose names the operators use themselves."""
    long = " ".join(f"word{i % 5000}x" for i in range(60_000))
    rows = [(1, "Alpha beta gamma delta epsilon zeta", "en"), (2, "alpha Beta gamma delta epsilon zeta", "en"), (2, "alpha Beta gamma delta epsilon zeta", "en"), (3, None, None), (4, "", "de"), (5, "   \n\t ", None), (None, "a row without an id", None), (None, None, None), (6, long, "en"), (7, long + " end", "en"), (8, "\u2028 ünï 𝒳 \x00 \u3000 \U0001f600", "fr"), (9, "one", "en")]
    full = [(i, t, lang, "s", None if t is None else len(t), "d", None, "r", "9", "v") for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 1, 1), (9, 0, None), (3, 0, 1)], "doc_id long, quality int, toxic int")

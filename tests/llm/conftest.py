import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, cls long, ids binary"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and very long texts, ties, repeated rows; extra columns whose names
    the operators use themselves."""
    long_text = " ".join(f"word{i % 997} tail{i % 13}" for i in range(60_000))
    texts = [
        (1, "The quick brown fox jumps over the lazy dog and runs far away from here"),
        (2, "the QUICK brown fox jumps over the lazy dog and runs far away from here"),
        (2, "the QUICK brown fox jumps over the lazy dog and runs far away from here"),
        (3, ""), (4, None), (None, "a text without an id"), (5, "one two"), (6, "one two"),
        (7, long_text), (8, " \t\n "), (9, "x" * 200_000), (10, "café <|endoftext|> naïve  it's 12,5 Å"),
    ]
    rows = [(i, t, None if i == 5 else "en", "s", None, 1.0, 7, b"x") for i, t in texts]
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC_SCHEMA)

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, clashing extra columns."""
    long_words = " ".join(f"word{k % 977}" for k in range(40_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog, again and again.", "en", "a", 60),
        (1, "The quick brown fox jumps over the lazy dog, again and again.", "en", "a", 60),
        (2, None, "en", "a", 0),
        (3, "", None, None, None),
        (4, " \n\t ", "fr", "b", 4),
        (None, "Le renard brun saute par-dessus le chien", "fr", "b", 40),
        (5, long_words, "en", "a", len(long_words)),
        (6, "x" * 70_000, "de", "a", 70_000),
        (7, "日本語 ünïcödé \u0000 \U0001F600 1d10t s t u p i d", None, "a", 30),
        (8, "!!! 123 ###", "en", "a", 11),
        (9, "The quick brown fox jumps over the lazy dog, again and again!", "en", "a", 60),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clash = ("score", "fp", "held_out", "shard", "ids", "row", "word", "_n", "toxic", "kind", "component_id", "slot", "n_words")
    for c in clash:
        df = df.selectExpr("*", f"'x' AS {c}")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

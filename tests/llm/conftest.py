import pytest

LONG = "the quick brown fox jumps over the lazy dog " * 20_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and further columns with clashing names."""
    rows = [
        (1, "a few plain words in a text", "en", "s", 1), (1, "a few plain words in a text", "en", "s", 1), (2, None, "en", "s", None), (3, "", None, None, 0), (None, "no id here", "de", "s", 1),
        (None, "no id here", "de", "s", 1), (4, LONG, "en", "t", 2), (5, " \t\n", "fr", "t", 3), (6, "漢字 😀 \U0001f600 é", "xx", "t", 4), (7, "x" * 100_000, "en", "t", 5),
        (8, "card 4111111111111111 mail a.b@c.org", "en", None, 36),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ("__q", "__cell", "__pii", "__nth", "__rows", "__n", "fp", "n", "rank", "score", "kept", "held_out", "component", "key", "part", "ref", "topic")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"<{c}>") for c in clash})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

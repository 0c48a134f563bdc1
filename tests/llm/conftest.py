import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls in every column, empty, repeated and very long texts, and extra columns with clashing names."""
    long = "Lorem ipsum dolor sit amet " * 20_000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a", 1, "x", 0),
        (2, "The quick brown fox jumps over the lazy dog", "en", "a", 1, "x", 0),
        (2, "The quick brown fox jumps over the lazy dog", "en", "a", 1, "x", 0),
        (3, None, None, None, None, None, None),
        (4, "", "", "", 0, "", 0),
        (None, "no id here", "en", "b", 5, "y", 1),
        (5, "   \t\n ", "en", "b", 5, "y", 1),
        (6, long, "la", "b", len(long), "y", 1),
        (7, "日本語のテキスト 🙃 <|endoftext|> x\x1cy", None, "c", 3, "y", 1),
        (8, "12345 !!! ---", "en", "c", 3, "y", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, size int")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

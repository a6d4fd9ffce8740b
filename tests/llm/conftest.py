import pytest


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ties, and columns whose names operators use."""
    prose = "the quick brown fox jumps over the lazy dog while seven wizards mix quartz and jade"
    rows = [
        (1, prose, "en", "a", 10),
        (1, prose, "en", "a", 10),
        (2, prose.upper(), "en", "b", None),
        (3, None, None, None, None),
        (None, "a text without an id, but with enough words to have shingles of its own", "en", "c", 5),
        (4, "", "en", "a", 0),
        (5, "   \n\t \n", "", "", 7),
        (6, " ".join(f"word{k % 9973}" for k in range(120_000)), "en", "a", 1_000_000),
        (7, "x" * 300_000, None, "b", 300_000),
        (8, prose + " indeed", "en", "c", 11),
        (9, "one two", "en", "a", 7),
        (10, "One  TWO", "de", "b", 8),
        (-3, "héllo wörld ▁ 日本語 😀 \x00 <|endoftext|> \x85  end", "ja", "ü", 3),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "7 as n_tokens", "'x' as score", "1 as n_bytes", "2 as page", "'k' as kept", "0 as mix_size", "3 as n_lines", "4 as licenses", "5 as class_id")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)

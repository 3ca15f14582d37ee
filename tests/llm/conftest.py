import pytest

LONG = " ".join(f"longword{i % 977}" for i in range(30_000))

#: nulls in every column, empty and very long texts, ties, repeated rows, names that clash with inner columns
EDGE_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old stone bridge at night.", "en", "a", 79, 1, "x"),
    (2, "The quick brown fox jumps over the lazy dog near the old stone bridge at night.", "en", "a", 79, 2, "y"),
    (2, "The quick brown fox jumps over the lazy dog near the old stone bridge at night.", "en", "a", 79, 2, "y"),
    (3, "", "de", None, 0, None, None),
    (4, None, None, "b", None, 4, "z"),
    (5, " \t\n ", "fr", "b", 4, 5, "z"),
    (6, "42", "fr", "b", 2, 6, "z"),
    (7, LONG, None, "b", len(LONG), 7, "z"),
    (None, "no id here", "en", None, 10, None, None),
    (None, None, None, None, None, None, None),
]
EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, token string"


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA)


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)

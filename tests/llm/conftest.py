import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, value long, score double, label string, part int, kept boolean"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table with extra columns whose names operators use themselves."""

    def of(rows):
        full = [(i, t, "en", "s", 1, "w", 2, 0.5, "l", 3, True) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return of


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a null id and a very long text."""
    long = " ".join(f"word{i % 977} number {i}" for i in range(30000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "same text here again"), (5, "same text here again"), (5, "same text here again"), (6, long), (7, long), (None, "no id"), (8, "Ünïcode ÀÉ ñ 漢字 😀 MIXED Case"), (9, "one"), (10, "!!! ???")]

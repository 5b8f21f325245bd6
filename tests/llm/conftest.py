import pytest

ODD = ["", None, " ", "a", "x" * 5000, "Ünï çødé 😀 words", "same text here", "same text here", "tab\tsep\nline\r\n"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, extra columns with clashing names."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 2 else f"s{i % 3}", i, "k", "h") for i, t in enumerate(ODD)]
    rows.append((7, "same text here", "en", "s1", 7, "k", "h"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, part string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

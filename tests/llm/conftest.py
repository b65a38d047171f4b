"""Documents with every case that the operators define."""

import pytest

ODD = [
    (1, "The quick brown fox jumps over the lazy dog", "en", 1.0, "x"),
    (2, "the quick\tbrown fox jumps over\nthe lazy dog ", None, 2.0, None),
    (3, None, "en", None, "y"),
    (4, "", "de", 4.0, "z"),
    (5, " \n\t", None, 5.0, "z"),
    (6, "Ünïcødé ñandú 日本語 " * 3, "fr", 6.0, "z"),
    (7, "long text " * 20_000, "en", 7.0, "z"),
    (1, "The quick brown fox jumps over the lazy dog", "en", 1.0, "x"),
    (None, "The quick brown fox jumps over the lazy dog", "en", 8.0, "n"),
    (9, "Thequickbrownfoxjumpsoverthelazydog", "en", 9.0, "z"),
]
#: Columns whose names are the operators' own.
SCHEMA = "doc_id long, text string, kept string, score double, key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, a repeated row, a null id, columns of clashing names."""
    return spark.createDataFrame([(i, t, lang, s, k) for i, t, lang, s, k in ODD], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    """The same columns without rows."""
    return spark.createDataFrame([], SCHEMA)

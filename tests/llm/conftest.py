import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in any column, empty and blank texts, repeated rows, ties, a long text, other scripts, odd characters.
ODD = [
    (1, "The quick brown fox\njumps over the lazy dog.\n", "en", "a", 44),
    (1, "The quick brown fox\njumps over the lazy dog.\n", "en", "a", 44),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \t\n\x0b\x0c\r ", "de", None, 7),
    (None, "a row without an id", "en", "a", 19),
    (None, None, None, None, None),
    (5, "Été ÀÉÎ été x y <|endoftext|> 漢字 😀 don't  stop", "fr", "é", 30),
    (6, "word " * 5000, "en", "a", 25000),
    (7, "THE QUICK BROWN FOX\nJUMPS OVER THE LAZY DOG.\n", "en", "b", 44),
    (-8, "12 34 \x00\x01 ## $$ ​﻿", "xx", "c", 12),
    (9, "a b", "es", "b", 3),
]
#: Names that the operators use beside the columns of a table, now or once.
CLASHING = (
    "id", "fp", "kept", "node", "component", "size", "copies", "row", "words", "h", "name", "k", "target", "key", "of", "copy", "gone_id", "gone_key", "gone_of", "first", "least", "place", "shorts", "same", "cell", "at",
    "__same", "__gone", "__id", "__of", "__row", "__key", "__copy", "__node", "__part", "keep_id", "group_size", "n", "pos", "root", "url", "host", "label", "number", "own", "spans", "class", "source_size", "payload",
)


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns whose names clash with those that operators make."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD, SCHEMA)
    return docs.withColumns({name: F.lit("clash") for name in CLASHING})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)

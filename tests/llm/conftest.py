import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, band int, word string, root long, n int, a string"
LONG = " ".join(f"word{i % 977} of{i % 13} tale{i % 389}." for i in range(7000))
TEXTS = [
    (1, "The cat sat on the mat. It was warm.\nAll rights reserved."),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, LONG),
    (6, LONG),
    (7, "One two three four five six. One two three four five six."),
    (7, "One two three four five six. One two three four five six."),
    (8, "Ünïcode ß text | menu | more | links"),
    (None, "A row without an id."),
    (9, "\x00odd\x0bbytes here 'S don't <|endoftext|>"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns that clash with inner names."""
    rows = [(i, t, None, "s", None, "x", 1, "w", 5, 2, "q") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")

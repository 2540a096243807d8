import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, kept string, n_words string, _id string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, one id with two texts, and columns with names in use."""
    base = " ".join(f"w{i * 7919 % 997}" for i in range(300))
    near = base.replace("w5 ", "x ", 1)
    rows = [
        (1, base),
        (2, base),
        (2, base),
        (3, near),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "one two"),
        (8, "One Two"),
        (9, "lone"),
        (10, base + "\n" + near),
        (10, "the same id\nwith another text\nwith another text"),
        (None, "a null id " * 30),
        (None, base),
        (11, "ÄÖÜ ßé 日本語 " * 50),
        (12, "x" * 5000),
        (13, "word " * 4000),
        (14, " ".join(f"v{i * 31 % 1013}" for i in range(6000)) + " " + base),
        (15, "퟿ control \x0b\x0c \x1c chars | # * $ % & < >"),
    ]
    return spark.createDataFrame([(d, t, "a", "b", "c") for d, t in rows], SCHEMA), rows


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

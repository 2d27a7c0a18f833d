import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns whose names clash."""
    rows = [
        (1, "Hello World of many small words here", "en", "a", 1, 9, "x"), (2, "hello world OF many small words here", "en", "a", 1, 9, None),
        (2, "hello world OF many small words here", "en", "a", 1, 9, None), (3, None, None, None, None, None, None), (4, "", "en", None, 0, 0, "y"),
        (None, "Hello World of many small words here", "en", "a", 1, 9, "x"), (None, None, None, None, None, None, None),
        (5, "1234 5678 !!", "de", "b", 3, 1, "z"), (6, "long " * 30_000 + "+49 30 1234567 end", "en", "b", 3, 1, "z"), (7, "a\x00b﻿   \U0001f600 é́", "fr", "c", 3, 1, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, digest string")


@pytest.fixture(scope="session")
def sample_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

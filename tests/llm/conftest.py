from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

# Texts with empty, null, odd and very long cases; ids repeat and one is null.
ODD_TEXTS = [
    "", None, " ", "\n\n", "one", "a b c d e", "Hello!, World.. ok", "x'S it's ' s 'll don't",
    "Σας ΟΔΟΣ. ", "İstanbul, é é. ", "<|endoftext|> a", "1234, 5.5. 2.0. ", "a b c\x1cd",
    "日本語。 テスト, ok", "?. !, ok", ". , ", "word " * 3000, "a" * 5000, " " * 3000 + "x",
    "same text twice", "same text twice", "same text twice",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, None if i % 5 == 0 else f"src{i % 2}", "kept") for i, t in enumerate(ODD_TEXTS)]
    rows += [(3, "\n\n", "src1", "kept"), (None, "no id", "src1", "kept")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, rank string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, rank string")

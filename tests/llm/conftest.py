import hashlib
import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tiny(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, ties, copies."""
    plain = "the quick brown fox jumps over the lazy dog again and again while the rain keeps falling on every roof"
    rows = [
        (1, plain, "en", "b", 1), (2, plain, "en", "b", 1), (2, plain, "en", "b", 1), (3, plain + " tonight", "en", None, 1),
        (4, None, "de", "a", None), (5, "", None, "a", 0), (6, " \t\n ", "fr", "c", 3), (7, "word", "en", "c", 4), (8, "ein Wort, zwei Wörter\x1f und mehr", "de", None, 9),
        (9, "lang " * 30000, "de", "d", 150000), (10, "secret = 'abcdef123456' und <|endoftext|> ÉÇÀ ﬁn 'sß", "fr", "é", 9), (None, "a row without an id", "en", "z", 9), (11, "x" * 100000, "en", "a", 9),
    ]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()

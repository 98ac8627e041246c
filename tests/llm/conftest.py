import re

import pyarrow as pa
import pytest

WORDS = "the of and to in tion ing er on an re th he or ed es".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(WORDS, rng.integers(1, 4))) for _ in range(n))


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="session")
def odd_rows():
    """Ids and texts with NULLs, empty and repeated rows."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(6000))
    return [(1, None), (2, ""), (3, " \n\t "), (None, "only one"), (4, "Same text here twice"), (4, "Same text here twice"), (5, "same TEXT here twice"), (6, long), (7, "é" * 500), (8, long), (None, None)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with further columns whose names operators use inside."""
    rows = [(i, t, "en", "s", 1, 2, 3, "x", i) for i, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, length long, uid long, node string, _task long")


def column(texts):
    return pa.array(texts, pa.string())

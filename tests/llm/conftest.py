import random

import pytest

WORDS = "lo rem ip sum do lor sit am et con sec te tur adi pis cing elit sed do eius mod tem por".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and extra columns whose names clash."""
    rows = [
        (1, "Hello wide world", "en", "a", 16, 1, "x"), (1, "Hello wide world", "en", "a", 16, 1, "x"), (2, None, None, None, None, None, None), (None, "no id here", "en", "b", 10, 2, "x"),
        (3, "", "en", "a", 0, 3, "x"), (4, "   \n\t ", "de", "b", 6, 4, "x"), (5, prose(40_000, 5), "en", "a", 1, 5, "x"), (6, "HELLO wide world", "en", None, 16, 6, "x"),
        (7, "Ünïcödé 漢字 \u00a0 😀\x00 ▁ <s>", "fr", "b", 9, 7, "x"), (8, "x" * 5000, "en", "c", 5000, 8, "x"), (None, None, None, None, None, None, None),
    ]
    kind = "doc_id long, text string, lang string, source string, n_chars long, fp long, score string"
    return spark.createDataFrame(rows, kind).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def prose_of():
    return prose

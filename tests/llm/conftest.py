import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents of (doc_id, text) pairs."""

    def make(rows, parts=3):
        full = [(k, t, "en", "s", len(t or "")) for k, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd():
    """Rows with nulls, empty and long texts, ties, repeated rows and shared passages."""
    import random

    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, long_ = text(70), text(3000)
    rows = [(1, text(200)), (2, None), (3, ""), (4, " \n\t "), (5, "x"), (6, "é" * 130), (7, long_), (8, long_), (8, long_), (9, "la " * 400), (10, "la " * 401)]
    rows += [(k, text(30) + " " + passage + "\n" + text(20)) for k in range(11, 25)]
    rows += [(25, long_.replace(" ", "  ", 5)), (26, "\U0001f600 " * 60), (27, passage), (28, passage.upper()), (12, text(60))]
    return rows

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """A function from texts (or (doc_id, text) pairs) to a table like documents, with a clashing further column."""

    def make(rows):
        rows = [(i, r) if not isinstance(r, tuple) else r for i, r in enumerate(rows)]
        return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x") for d, t in rows], DOCS + ", spans string")

    return make


@pytest.fixture()
def prose():
    """A function from a seed and a length to invented words."""

    def make(seed, n=120):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))

    return make

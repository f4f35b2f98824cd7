import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Make documents of (doc_id, text) rows, with an extra column."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)

    return make


@pytest.fixture
def prose():
    rng = random.Random(11)
    letters = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve"]

    def make(words, seed=None):
        r = random.Random(seed) if seed is not None else rng
        return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 5))) for _ in range(words))

    return make

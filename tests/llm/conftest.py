import random

import pytest

WORDS = [a + b + c for a in ("ka", "lo", "mi", "tu", "re", "sha") for b in ("n", "r", "st", "l") for c in ("a", "en", "ing", "o")]


@pytest.fixture(scope="session")
def prose():
    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + (rng.choice([".", ",", "\n"]) if rng.random() < 0.1 else "") for _ in range(n))

    return make


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of documents, with columns that clash with names used inside the operators."""

    def make(texts, ids=None, langs=None):
        rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", "src0", None if t is None else len(t), "x", 1, 2) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, chunk int, n long")

    return make

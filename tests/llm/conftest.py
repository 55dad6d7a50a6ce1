from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(texts, source=lambda i: f"s{i % 3}"):
    return [(i, t, "en", source(i), None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    return ["".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "é", "ß"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]


@pytest.fixture(scope="session")
def documents(spark, words):
    """Random texts with nulls, empties, blanks, one very long text, equal texts, a null source and a source with most rows."""
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [text(rng.randint(1, 300)) for _ in range(60)]
    texts += [None, "", "  \n\t ", "a", texts[0], texts[0], texts[1].upper(), text(30_000), "x" * 50_000, "  \U0001f600 \x00 b"]
    return rows(texts, lambda i: None if i % 17 == 0 else "s0" if i % 3 else f"s{i % 5}")


@pytest.fixture(scope="session")
def docs(spark, documents):
    return spark.createDataFrame(documents, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)

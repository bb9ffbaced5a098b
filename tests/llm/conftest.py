import random

import pytest

EXTRA = "rid long, row string, block int, shard int, slot long, key string, f double, size int, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=5):
    """Texts with nulls, empties, copies, near copies, shared passages, repeats inside a text and very long ones."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(3, 200)) for _ in range(25)]
    passage = words(rng, 120, 5000)
    near = base[0] + " " + words(rng, 150, 3000)
    texts = [None, "", "   ", "one", "two words", *base, *base[:5], near, near + " x", near.replace("w1 ", "w2 ", 1), passage + " tail", "head " + passage, base[3] + " " + passage + " " + base[4]]
    texts += ["ab" * 3000, "é" * 900 + " ü " + "é" * 900, words(rng, 4000), "\n".join([base[1]] * 4)]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark):
    """The corpus with columns whose names the operators use inside."""
    rows = [(i, t, i, "r", 1, 2, 3, "k", 0.5, 7, None if t is None else len(t)) for i, t in corpus()]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def texts():
    return dict(corpus())


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {EXTRA}")

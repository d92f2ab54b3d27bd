import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
SYLLABLES = "the of and ti on er en lo ka mi zu pra dek sol vin gar tem bu".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, g string, hit string"


def words(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def prose():
    return words


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, odd characters, a very long one, empty and null ones."""
    rng = random.Random(11)
    base = words(rng, 150)
    passage = words(rng, 60)
    texts = [words(rng, rng.randrange(1, 200)) for _ in range(30)]
    texts += [base] * 4
    for _ in range(8):
        w = base.split()
        for _ in range(rng.randrange(1, 7)):
            w[rng.randrange(len(w))] = words(rng, 1)
        texts.append(" ".join(w))
    texts += [f"{words(rng, 20)} {passage} {words(rng, 25)}" for _ in range(5)]
    texts += ["", None, None, " \t\n", "a", "One two", "one TWO", "x" * 300, "x" * 300, "é" * 80 + " ☃ " + "日本語 " * 30, "ab" * 100, words(rng, 3000), "the " * 500]
    return {i: t for i, t in enumerate(texts)}


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with columns whose names the operators use as well."""
    rows = [(i, t, "en", [None, "a", "b", "é"][i % 4] if i % 3 else "hot", len(t or ""), "size", "score", "g", "hit") for i, t in corpus.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def labels(spark, corpus):
    return spark.createDataFrame([(i, int(i % 5 != 0), int(i % 7 == 0)) for i in corpus if i % 2], "doc_id long, quality int, toxic int")

import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, fp string, part int, score string, digest string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """DataFrame of documents from (doc_id, text) rows, with extra columns that operators use as names themselves."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 0, "y", "z") for i, t in rows], DOC)
    return make


@pytest.fixture(scope="session")
def prose():
    """n words of invented prose, the same for the same seed."""
    def make(n, seed):
        r = random.Random(seed)
        return " ".join("".join(r.choices(["ka", "lo", "mi", "ren", "tas", "vo", "del"], k=r.randint(2, 4))) for _ in range(n))
    return make


ODD = [(None, "a b c d e f"), (7, None), (8, ""), (9, " \n\t "), (10, "one"), (11, "one"), (11, "one"), (12, "É ß 漢字 \U0001F600 x" * 3)]


@pytest.fixture(scope="session")
def odd():
    return ODD

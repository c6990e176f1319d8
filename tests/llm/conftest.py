import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "zoé", "***", "ß", "x"]


def text_of(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(n))


def corpus(seed: int = 3, n: int = 60) -> list[tuple]:
    """Rows with nulls, empty and long texts, copies, near copies and shared lines."""
    rng = random.Random(seed)
    shared = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    rows: list[tuple] = [(0, None, "n"), (1, "", "e"), (2, " \n ", "s"), (3, "one", "o"), (4, "é", "o"), (5, "x" * 3000, "l")]
    while len(rows) < n:
        i, kind = len(rows), rng.random()
        if kind < 0.15:
            t = rows[rng.randrange(len(rows))][1]
        elif kind < 0.4:
            words = (rows[rng.randrange(len(rows))][1] or "").split(" ")
            words[rng.randrange(len(words))] = "edit"
            t = " ".join(words)
        elif kind < 0.6:
            t = "\n".join([" ".join(f"u{rng.randrange(10**6)}" for _ in range(20)), shared, " ".join(f"u{rng.randrange(10**6)}" for _ in range(9))])
        elif kind < 0.8:
            t = " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 400)))
        else:
            t = text_of(rng, rng.randrange(1, 300))
        rows.append((i * 7 % 1009, t, f"src{i % 3}"))
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")

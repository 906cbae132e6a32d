from __future__ import annotations

import random

import pytest

FILLER = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(FILLER) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Documents with copies, near copies, shared passages, junk, nulls, empty and long texts, ties and repeats."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(1, 160)) for _ in range(60)]
    passage = prose(rng, 70)
    rows = list(enumerate(base))
    for i in range(40):
        words = base[rng.randrange(60)].split()
        for _ in range(rng.randrange(0, 1 + len(words) // 25)):
            words[rng.randrange(len(words))] = rng.choice(FILLER)
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, f"{prose(rng, 20)}\n{passage} {prose(rng, 20)}") for i in range(15)]
    rows += [(300, None), (301, ""), (302, " \t\n "), (303, "One two"), (304, "one TWO"), (305, "a" * 700), (306, "ab " * 300), (307, "é" * 300), (308, prose(rng, 6000)), (309, "x " + passage)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With a column that clashes with results, and one that no operator knows."""
    rows = [(d, t, d % 3, None if d % 7 == 0 else f"src{d % 4}", "en" if d % 2 else None) for d, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, n_removed int, source string, lang string").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, pos long, label string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus() -> list[tuple[int, str | None]]:
    """Random texts with copies, near copies, shared passages, short, empty, null and very long ones."""
    rng = random.Random(7)
    texts: list[str | None] = [words(rng, rng.randint(20, 120)) for _ in range(25)]
    passage = words(rng, 30)
    texts += [texts[0], texts[0], texts[3] + "\n"]
    for _ in range(12):
        w = texts[1].split()
        for _ in range(rng.randint(1, 12)):
            w[rng.randrange(len(w))] = words(rng, 1)
        texts.append(" ".join(w))
    texts += [f"{words(rng, 15)} {passage}\t{words(rng, 15)}" for _ in range(8)]
    texts += [None, "", "   ", "one", "One", "two words", "two words", words(rng, 6000), "x" * 5000 + " y", passage.upper()]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [(i * 3 + 1, t) for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """As documents, with columns whose names operators use themselves, and one row twice."""
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", len(t or ""), "clash", 5, "x") for i, t in corpus]
    return spark.createDataFrame([*rows, rows[4]], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, count: int, vocabulary: int = 400) -> list[str]:
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(count)]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows."""
    base = words(1, 120)
    near = base[:60] + ["changed"] + base[61:]
    rows = [
        (1, " ".join(base), "en", "a", 1),
        (2, " ".join(base), "en", "a", 1),
        (3, " ".join(near), "en", "b", 1),
        (4, " ".join(near).upper(), "en", "b", 1),
        (5, None, "en", "a", 1),
        (6, "", "de", None, 1),
        (7, " \t\n ", None, "c", None),
        (8, "one two", "en", "c", 1),
        (9, "one two", "en", "c", 1),
        (9, "one two", "en", "c", 1),
        (10, " ".join(words(2, 30_000)), "en", "a", 1),
        (11, " ".join(words(3, 90)), "fr", "d\x00", 1),
        (None, " ".join(base), None, None, None),
        (12, "é ß 漢字 <|endoftext|> 'll", "xx", "b", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

"""Small inputs and plain versions that the tests of the training-data operators share."""

import random

from stackloom.llm.words import LOWER_WORDS

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "", ",", "."]) for _ in range(n))


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER_WORDS).split()


def shingles(words: list[bytes], size: int = 5) -> list[tuple]:
    if len(words) < size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def documents(spark, rows, extra: str = ""):
    """(doc_id, text) rows, with further columns by a DDL string."""
    return spark.createDataFrame(rows, f"doc_id long, text string{', ' + extra if extra else ''}")

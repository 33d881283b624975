import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, label int, block int, n int, _id int, _key string, _spans int, _doc int"


def prose(seed: int, words: int, vocabulary: int = 4000) -> str:
    """Made-up words, so that two seeds share no passage."""
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x{rng.randrange(50)}" for _ in range(words))


def edited(text: str, every: int) -> str:
    """`text` with each `every`-th word changed."""
    words = text.split()
    for i in range(every - 1, len(words), every):
        words[i] = f"changed{i}"
    return " ".join(words)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeats, copies, near copies, and columns whose names clash."""
    a, passage = prose(1, 300), prose(2, 70)
    texts = [
        (1, a, "en"), (2, a, "en"), (3, edited(a, 60), "en"),  # copy and near copy
        (4, prose(3, 120) + " " + passage + " " + prose(4, 90), "de"), (5, prose(5, 80) + " " + passage, None),
        (6, "", "en"), (7, None, "en"), (8, "  \n\t", "fr"), (9, "word", "en"), (10, "É ß ü!", "de"),
        (None, prose(6, 40), "en"), (None, prose(6, 40), "en"), (None, None, None),
        (11, prose(7, 60), "en"), (11, prose(7, 60), "en"), (11, prose(8, 60), "en"),  # one id, two texts
        (12, prose(9, 30_000), "en"), (13, "same line here again\n" * 3000, "en"), (14, "x" * 70_000, "en"),
    ]
    rows = [(i, t, lang, "s", len(t or ""), "k", 1, 2, 3, 4, "z", 5, 6) for i, t, lang in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


def unlike_words(letters=10):
    """Two words of 2**letters `a` and `b` whose polynomials modulo 2**64 are equal."""
    one, two = "a", "b"
    for _ in range(letters):
        one, two = one + two, two + one
    return one, two

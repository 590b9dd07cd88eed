import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, size string, row string, spans string, key string, media string, fp string, length string"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text, lang, source) as a table with further columns whose names operators use themselves."""
    def make(rows):
        full = [(i, t, lang, s, len(t) if t is not None else None, "x", "x", "x", "x", "x", "x", "x", "x") for i, t, lang, s in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text, characters beyond the basic plane."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base, long_ = prose(120), prose(6000)
    shared = prose(50)
    rows = [
        (0, base, "en", "a"), (1, base + " tail", "en", "a"), (2, base.upper(), "en", "b"), (3, prose(80), "en", "b"),
        (4, None, "en", "a"), (5, "", None, "a"), (6, " \t\n ", "en", None), (7, "one", "en", "b"), (8, "one two three", None, None),
        (None, prose(60), "en", "a"), (None, None, None, None), (9, base, "en", "a"), (9, base, "en", "a"), (10, long_, "en", "b"),
        (11, f"{prose(40)} {shared} {prose(40)}", "en", "a"), (12, f"{prose(10)} {shared}", "en", "c"), (13, f"{prose(200)}\n{shared}\n{prose(3)}", "en", "a"),
        (14, "la " * 300, "en", "c"), (15, "x y z " * 60 + prose(20), "en", "c"), (16, "𝔘 ünï  cödé\u00a0word \U0001f600 " + prose(30), "de", "c"),
        (17, prose(37), "en", "a"), (18, prose(34), "en", "a"), (19, f"{long_[:2000]} {prose(100)}", "en", "b"),
    ]
    return rows

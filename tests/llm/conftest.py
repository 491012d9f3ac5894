import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, kept string, score int, label string"


def frame(spark, rows, parts=3):
    """Documents with further columns whose names the operators use themselves."""
    full = [(i, t, lang, "s", len(t or ""), "k", None, 7, "x") for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows and copies."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["er", "an", "th", "on", "ti", "re", "é", "st"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(1, None, "en"), (2, "", "en"), (3, "   \n\t ", None), (4, "one", "en"), (5, "one", "fr"), (6, "12 34 -- !!", "en")]
    base = text(120)
    rows += [(10, base, "en"), (11, base.replace(" ", "  \n"), "en"), (12, base, "fr"), (12, base, "fr")]
    rows += [(None, base, "en"), (None, text(30), None)]
    rows += [(20, text(3000), "de"), (21, "a " * 500, "de"), (22, "ab" * 700, "de"), (23, "x" * 4000, "de")]
    shared = text(60)
    rows += [(30 + k, f"{text(40)} {shared} {text(40)}", "en") for k in range(12)]
    near = base.split()
    rows += [(50 + k, " ".join(near[:60] + [word()] + near[61:]), "fr") for k in range(6)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

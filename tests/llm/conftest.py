import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a long text, ties, repeated rows, near copies, and columns that clash with working names."""
    r = random.Random(5)
    vocabulary = ["the", "of", "and"] * 6 + ["".join(r.choice("abcdefghijé") for _ in range(r.randint(2, 7))) for _ in range(300)]

    def text(n):
        return " ".join(r.choice(vocabulary) for _ in range(n))
    base = text(80)
    rows = [(None, "no id " + text(20), "en", "a", 5), (1, None, None, None, None), (2, "", "en", "b", 0), (3, " \t\n ", "de", "b", 4),
            (4, base, "en", "a", 1), (4, base, "en", "a", 1), (5, base, "en", "b", 1), (6, base + " tail", "fr", None, 2),
            (7, "x", "en", "a", 1), (8, "X", "en", "a", 1), (9, "Line One here\n" + text(6) + "\nLine One here\n\n" + base.upper(), "en", "c", 9),
            (10, text(30_000), "de", "a", 1), (11, "é" * 5000, "fr", "c", 1), (12, "!!! ### |||", "en", "c", 3)]
    rows += [(20 + i, text(r.randint(1, 120)), r.choice(["en", "de", "fr", None]), r.choice("abcde"), i) for i in range(60)]
    for i in range(12):  # near copies
        w = base.split(" ")
        w[r.randrange(len(w))] = "new"
        rows.append((100 + i, " ".join(w), "en", "a", 1))
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS size", "'q' AS _size", "2 AS node", "'z' AS _text", "3 AS score")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

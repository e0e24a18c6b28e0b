import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, rest double, n long, e string, f int, part string, gone long, url string, row string"


def documents(spark, rows):
    """Documents of (doc_id, text, source), with more columns whose names the operators use inside."""
    full = [(i, t, "en", s, len(t or ""), "x", 0.5, 7, "e", 1, "p", 3, "u", "r") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def some_rows(n=40, seed=3):
    """Texts of made-up words: copies, near copies, nulls, blanks, one long, one row twice, a null source and a null doc_id."""
    r = random.Random(seed)
    words = ["".join(r.choice("abehinorst") for _ in range(r.randint(1, 7))) for _ in range(120)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 60))), f"src{i % 3}") for i in range(n)]
    rows[3] = (3, rows[2][1], "src0")
    rows[5] = (5, rows[4][1] + " more", None)
    rows[6], rows[7], rows[8] = (6, None, "src1"), (7, "", "src2"), (8, " \t\n ", None)
    rows[9] = (9, "long " + " ".join(r.choice(words) for _ in range(9000)), "src0")
    rows[10] = (10, "mail a.b@c.org or +1 (555) 123-4567, card 4242 4242 4242 4242 at 10.0.0.7; password=hunter22x 😀 é", "src1")
    return [*rows, rows[11], (None, "no id here at all", "src1")]


@pytest.fixture(scope="session")
def rows():
    return some_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return documents(spark, rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return documents(spark, [])

"""Small documents with nulls, empty and long texts, repeated rows and clashing column names."""

import pytest

BASE = " ".join(f"word{i}" for i in range(60))
TEXTS = [None, "", "   ", "a b c", "A  b\tc", BASE, BASE, BASE + " more", " ".join(f"w{i}" for i in range(3000)), "x" * 450,
         "the cat sat. the cat ran, the cat sat!", "Größe ÇA va ñandú \U0001F600 \x1c end.", "the cat sat on the cat"]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i if i != 4 else None, t, ("en", None, "de", "und")[i % 4], None if i % 4 == 0 else f"s{i % 3}", None if i % 5 == 0 else len(t or ""), "k", 2, 3, 4)
            for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[10], rows[4], (5, "another text of id 5", "en", "s1", 20, "k", 2, 3, 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n int, place int, block int")

from __future__ import annotations

import pytest

TEXTS = [
    "The first plain text of the set, long enough for shingles of five words and then some more words after that.",
    "The first plain text of the set, long enough for shingles of five words and then some more words after that.",
    None, "", "   \n ", "one", "word " * 3000, "Écrire à jean.dupont@mail.example.com ou au +33 (612) 555-0123 demain.",
    "hosts 10.0.0.1, 999.1.1.1 and 1.2.3.4.5 and cards 4111 1111 1111 1111 or 4111 1111 1111 1112",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, ties, repeated rows, long texts and a column that an operator uses itself."""
    rows = [(i, t, "x" * 3, None) for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, "a text without an id that nothing else repeats anywhere", "y", 1), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, length long").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, score string, length long")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(9)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")

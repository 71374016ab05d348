import os

import pytest

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def tables():
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables")
    return DATA


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named like the operators' own."""
    rows = [
        (1, "One two  three four five six seven eight nine ten.", 1, "a"), (1, "One two  three four five six seven eight nine ten.", 1, "a"), (2, None, None, None), (3, "", 2, ""),
        (None, "x y z", 3, "b"), (None, None, None, None), (4, LONG, 4, "c"), (5, LONG, 5, None), (6, "One two three\tfour five six seven eight nine ten.", 6, "d"), (7, "é\U0001f600  ", 7, "e"),
    ]
    return spark.createDataFrame([(i, t, k, n, k, n, k, k, k, k) for i, t, k, n in rows], "doc_id long, text string, key long, kind string, id long, body string, n long, gone_id long, other_id long, again_id long")


@pytest.fixture
def nothing(odd):
    return odd.limit(0)

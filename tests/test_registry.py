"""A cross-section of the registered queries against their SQL on the smallest tables."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
NAMES = (
    "a15_debt_extinction", "w06_streaks", "g03_behaviour_profile", "a14_j09_return_after_streak", "a53_session_trends",
    "j13_match_swap_pairs", "a04_h17_extreme_streaks", "a42_g10_k02_counter_items",
)


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    from __spark_entry__ import oracle_sql, queries
    from check import canon

    got, want = canon(queries()[name](spark, DATA).toPandas()), canon(con.execute(oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.map(str).replace({"nan": "None", "<NA>": "None"}).equals(want.map(str).replace({"nan": "None", "<NA>": "None"})) or (
        (got.fillna(-1).astype(str) == want.fillna(-1).astype(str)).all().all()
    )


def test_every_oracle_has_a_query():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 200

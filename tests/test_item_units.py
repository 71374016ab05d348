"""The item queries test items and item classes alike."""

import pytest

from checks import load_all, q_sets, registry

LOG = 400


def write(spark, at):
    """Ranked events of one region and slot between two archetypes; an opponent's class depends on the own archetype, and no item is in two baskets."""
    events = [(i, "2024-01-01 03:00:00", 1 + i % 2, "signup", 50.0, '{"k": 11}') for i in range(LOG)]
    rows = {
        "events": spark.createDataFrame(events, "event_id long, at string, user_id long, event_type string, value double, props string").selectExpr("event_id", "cast(at as timestamp_ntz) as ts", "user_id", "event_type", "value", "props"),
        "orders": spark.createDataFrame([(i, "1" if i % 2 else "2", "O") for i in range(LOG)], "o_orderkey long, o_orderpriority string, o_orderstatus string"),
        "lineitem": spark.createDataFrame([(i, i, 5.0, "R", "O") for i in range(LOG)], "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string, l_linestatus string"),
        "part": spark.createDataFrame([(i, "n", f"Brand#{i * i % 4}", "t", 1) for i in range(LOG)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "nation": spark.createDataFrame([(i, "x", 0) for i in range(25)], "n_nationkey int, n_name string, n_regionkey int"),
    }
    for name, df in rows.items():
        df.coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_items_and_classes_are_tested(spark, tmp_path):
    load_all()
    got = registry.QUERIES["a65_item_fairness_tests"](spark, write(spark, tmp_path)).collect()
    assert {(r["unit"], r["item"]) for r in got} == {("class", "Brand#0"), ("class", "Brand#1")}


@pytest.mark.parametrize("name", ["a65_item_fairness_tests", "a65_k05_item_fairness_top", "a55_g16_sniper_confounding"])
def test_both_units_are_in_the_sql(name):
    load_all()
    assert q_sets.LINES in registry.ORACLES[name] and q_sets.CLS in registry.ORACLES[name]

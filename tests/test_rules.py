"""Null, duplicate and sampling semantics of the rules on hand-made rows."""

import json
from collections import Counter

import pytest

from quayside.operators import rules

LINE = (
    "l_orderkey bigint, l_linenumber int, l_shipdate date, l_commitdate date, l_receiptdate date, "
    "l_shipmode string, l_returnflag string"
)
ORDER = "o_orderkey bigint, o_orderdate date"


def frame(spark, rows, schema):
    import datetime as dt

    def cell(value):
        return dt.date.fromisoformat(value) if isinstance(value, str) and value[:2] == "20" else value

    return spark.createDataFrame([tuple(cell(v) for v in r) for r in rows], schema)


def found(frame_of_rules, *ids):
    return {
        (r.rule_id, r.table_name): (r.violation_count, json.loads(r.sample_keys))
        for r in rules.record(frame_of_rules, *ids).collect()
    }


@pytest.fixture(scope="module")
def lines(spark):
    return frame(spark, [
        (1, 1, "2020-01-05", "2020-01-05", "2020-01-05", "AIR", "A"),  # all equal: passes
        (1, 2, "2020-01-05", "2020-01-09", "2020-01-04", "AIR", "R"),  # received before shipped
        (2, 1, None, "2020-01-09", "2020-01-10", "DRONE", "N"),        # no ship date, unknown mode
        (3, 1, "2020-01-01", "2020-01-01", "2020-01-02", None, None),  # before its order, NULL categories
        (9, 1, "2020-01-01", "2020-01-01", "2020-01-02", "AIR", "A"),  # no order
        (None, 1, "2020-01-01", "2020-01-01", "2020-01-02", "AIR", "A"),
    ], LINE)


@pytest.fixture(scope="module")
def orders(spark):
    return frame(spark, [(1, "2020-01-05"), (2, "2020-01-01"), (3, "2020-01-02"), (4, None), (None, "2020-01-01")], ORDER)


def test_line_rules(lines):
    assert found(rules.line_rules(lines)) == {
        ("DQ-L2", "lineitem"): (1, ["1|2"]),
        ("DQ-L4", "lineitem"): (1, ["2|1"]),
        ("DQ-L5", "lineitem"): (2, ["2|1", "3|1"]),
        ("DQ-L6", "lineitem"): (1, ["3|1"]),
    }


def test_line_order_rules_skip_orphans_and_nulls(lines, orders):
    assert found(rules.line_order_rules(lines, orders)) == {
        ("DQ-L1", "lineitem"): (1, ["3|1"]),
        ("DQ-L3", "lineitem"): (1, ["3|1"]),
        ("DQ-L8", "lineitem"): (2, ["1", "9|1"]),  # a NULL part is left out of the text
    }


def test_repeated_orders_weigh_instead_of_multiplying(spark, lines):
    """Three copies of an order and one other date count like the pairs a plain join would make."""
    orders = frame(spark, [(3, "2020-01-02")] * 3 + [(3, "2019-12-31"), (1, "2020-01-05")], ORDER)
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    pairs = joined.where("l_shipdate < o_orderdate").count()
    assert found(rules.line_order_rules(lines, orders), "DQ-L1") == {("DQ-L1", "lineitem"): (pairs, ["3|1"] * 3)}
    assert pairs == 3


def test_order_rules(orders, lines):
    assert found(rules.order_rules(orders)) == {("DQ-L4", "orders"): (1, ["4"])}
    tables = {"orders": orders, "lineitem": lines}
    assert found(rules.key_rules("orders", tables)) == {
        ("DQ-G1", "orders"): (1, [""]),
        ("DQ-G2", "lineitem.lineitem_orders_fk"): (2, ["", "9"]),
        ("DQ-L9", "orders"): (2, ["", "4"]),
    }


def test_key_rule_counts_null_rows_and_repeated_values(spark):
    rows = spark.createDataFrame([(None,), (None,), ("a",), ("a",), ("a",), ("b",)], "p_brand string")
    # two NULL rows, NULL repeated once, "a" repeated once
    assert found(rules.key_rules("brand", {"brand": rows})) == {("DQ-G1", "brand"): (4, ["", "", "", "a"])}


def test_reference_rule_counts_rows(spark):
    child = spark.createDataFrame([("x",)] * 12 + [("a",), (None,)], "p_brand string")
    parent = spark.createDataFrame([("a",), ("a",)], "p_brand string")
    assert found(rules.key_rules("brand", {"brand": parent, "part": child})) == {
        ("DQ-G1", "brand"): (1, ["a"]),
        ("DQ-G2", "part.part_brand_fk"): (13, [""] + ["x"] * 9),
    }


def test_a_null_parent_key_matches_no_reference(spark):
    rows = spark.createDataFrame([(None,)], "p_brand string")
    counts = found(rules.key_rules("brand", {"brand": rows, "part": rows}))
    assert counts["DQ-G2", "part.part_brand_fk"] == (1, [""])


def test_samples_are_the_first_ten_in_key_order(spark):
    rows = [(k, 1, "2020-01-02", "2020-01-02", "2020-01-01", "AIR", "A") for k in range(30, 0, -1)]
    assert found(rules.line_rules(frame(spark, rows, LINE)), "DQ-L2") == {
        ("DQ-L2", "lineitem"): (30, [f"{k}|1" for k in range(1, 11)])
    }


def test_report_orders_rules_and_marks_clean_ones(lines, orders):
    report = rules.dq_report([rules.line_rules(lines), rules.order_rules(orders)]).collect()
    assert [(r.rule_id, r.table_name) for r in report] == [
        ("DQ-L2", "lineitem"), ("DQ-L4", "lineitem"), ("DQ-L4", "orders"), ("DQ-L5", "lineitem"), ("DQ-L6", "lineitem"),
    ]
    assert {r.sample_keys for r in rules.dq_report([rules.line_rules(lines.limit(1))]).collect()} == {"[]"}


def test_counts_on_empty_tables(spark, lines, orders):
    counted = rules.rule_counts([rules.line_order_rules(lines.limit(0), orders), rules.order_rules(orders.limit(0))])
    assert Counter(r.violation_count for r in counted.collect()) == {0: 4}


def test_unknown_layer_is_refused():
    with pytest.raises(ValueError):
        rules.Rule("DQ-X", "t", None, ("k",), None, layer="attic")


def test_hot_keys_give_the_same_counts(spark):
    """One order holds a third of the lines, one part-supplier pair too."""
    from pyspark.sql import functions as F

    lines = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, -5).otherwise(F.col("id")).alias("l_orderkey"),
        (F.col("id") % 1000).cast("int").alias("l_linenumber"),
        F.lit("2020-01-01").cast("date").alias("l_shipdate"), F.lit("2020-01-01").cast("date").alias("l_commitdate"),
    )
    orders = spark.range(30000).select(F.col("id").alias("o_orderkey"), F.lit("2020-01-02").cast("date").alias("o_orderdate"))
    counts = {r.rule_id: r.violation_count for r in rules.rule_counts([rules.line_order_rules(lines, orders)]).collect()}
    assert counts == {"DQ-L1": 20000, "DQ-L3": 20000, "DQ-L8": 10000}
    keyed = rules.rule_counts([rules.key_rules("orders", {"orders": orders, "lineitem": lines})]).collect()
    assert {r.rule_id: r.violation_count for r in keyed} == {"DQ-G1": 0, "DQ-G2": 10000, "DQ-L9": 10000}

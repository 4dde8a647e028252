"""Sets of keys as words against plain counting, and what they shuffle."""

import numpy as np
import pytest
from comparing import executions_since, last_execution
from pyspark.sql import functions as F

from quayside.contracts import SILVER
from quayside.operators import keysets, profiling, rules
from quayside.plans.registry import Inputs


def test_words_count_distinct_keys(spark):
    rng = np.random.default_rng(2)
    keys = [int(x) for x in rng.integers(-300, 300, 500)] + [2**63 - 1, -(2**63), 63, 64, -1, -64, -65, None, None]
    for kind in ("bigint", "int", "smallint"):
        own = [k for k in keys if k is None or abs(k) < 1000 or kind == "bigint"]
        df = spark.createDataFrame([(k % 3 if k is not None else 1, k) for k in own], "p bigint, k bigint").withColumn("k", F.col("k").cast(kind))
        for columns in (("k",), ("p", "k")):
            row = profiling.key_check("t", df, columns, "primary key").first()
            assert (row.row_count, row.distinct_keys, row.rows_with_null_key) == (len(own), len(set(own) - {None}), 2) and not row.is_key
            by_value = profiling.key_check("t", df.withColumn("k", F.col("k").cast("string")), columns, "primary key").first()
            assert row == by_value


@pytest.mark.parametrize("most", (10_000, 3, 0))
def test_rules_by_suspect_words_equal_those_by_all_keys(spark, small, monkeypatch, most):
    monkeypatch.setattr(rules, "MOST_WORDS", most)
    tables = {t: df.cache() for t, df in Inputs(spark, small).staging(True).items()}
    suspects = rules.suspect_keys(tables)
    assert set(suspects) == {t for t in SILVER if t not in ("brand", "ship_date_status", "part_quantity_price")}
    assert suspects["region"] == [] and (suspects["orders"] is None) == (most < 10_000)
    for table in SILVER:
        narrowed, whole = (rules.record(rules.key_rules(table, tables, s)).collect() for s in (suspects, None))
        assert sorted(narrowed) == sorted(whole), table
    for df in tables.values():
        df.unpersist()


def test_null_and_extreme_keys_are_suspect(spark):
    edge = [(None,), (-(2**63),), (2**63 - 1,), (5,), (5,), (70,)]
    orders = spark.createDataFrame([(*k, None) for k in edge], "o_orderkey bigint, o_orderdate date")
    lines = spark.createDataFrame([(-(2**63), 1), (2**63 - 1, 1), (5, 1), (71, 1), (None, 1)], "l_orderkey bigint, l_linenumber int")
    tables = {"orders": orders, "lineitem": lines}
    rows = rules._stacked_keys("orders", tables)
    words = [r.words for r in keysets.suspect_words(rows, ("o_orderkey",), "owned", ["lineitem_orders_fk"], ["lineitem_orders_fk"]).collect()]
    assert sorted(words, key=repr) == [[0], [1], [None]]
    narrowed = rules.record(rules.key_rules("orders", tables, {"orders": words})).collect()
    assert sorted(narrowed) == sorted(rules.record(rules.key_rules("orders", tables)).collect())
    assert {(r.rule_id, r.violation_count) for r in narrowed} == {("DQ-G1", 2), ("DQ-G2", 2), ("DQ-L9", 2)}


def shuffled(spark, action) -> int:
    """Bytes that the stages of an action write for a shuffle."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = last_execution(spark)
    action()
    found = 0
    for execution in executions_since(spark, before):
        values = store.executionMetrics(execution.executionId())
        metrics = execution.metrics()
        for k in range(metrics.size()):
            metric = metrics.apply(k)
            if metric.name() == "shuffle bytes written" and values.contains(metric.accumulatorId()):
                found += _bytes(values.apply(metric.accumulatorId()))
    return found


def _bytes(text: str) -> int:
    number, unit = text.split("\n")[-1].split(" (")[0].split()[:2]
    return int(float(number) * {"B": 1, "KiB": 2**10, "MiB": 2**20, "GiB": 2**30}[unit])


def test_clean_references_shuffle_words_only(spark, tmp_path):
    """Lines of 200,000 orders, in the order of their keys as tables mostly are."""
    spark.range(200_000).selectExpr("id AS o_orderkey").write.parquet(f"{tmp_path}/orders")
    spark.range(800_000).selectExpr("id div 4 AS l_orderkey").write.parquet(f"{tmp_path}/lineitem")
    tables = {t: spark.read.parquet(f"{tmp_path}/{t}") for t in ("orders", "lineitem")}
    rows = rules._stacked_keys("orders", tables)
    by_key = shuffled(spark, lambda: rules.rule_counts([rules.key_rules("orders", tables)]).collect())
    name = ["lineitem_orders_fk"]
    by_word = shuffled(spark, lambda: keysets.suspect_words(rows, ("o_orderkey",), "owned", name, name).collect())
    print(f"shuffled bytes for lineitem_orders_fk: {by_key} by key, {by_word} by word")
    assert 0 < by_word < by_key / 20

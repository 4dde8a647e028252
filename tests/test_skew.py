"""A hot key is split or summed up before the shuffle, with the same results."""

import pytest
from pyspark.sql import functions as F

from quayside.operators import facts, rules


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """Lines of which a third belong to one order, written to files so that sizes are known."""
    root = tmp_path_factory.mktemp("hot")
    day = F.lit("2020-01-01").cast("date")
    spark.range(0, 600_000, numPartitions=16).select(
        F.when(F.col("id") % 3 == 0, 6).otherwise(F.col("id")).alias("l_orderkey"),
        F.col("id").cast("int").alias("l_linenumber"),
        day.alias("l_shipdate"), F.date_add(day, F.abs(F.hash("id") % 5000)).alias("l_commitdate"),
        F.date_add(day, (F.col("id") % 30).cast("int")).alias("l_receiptdate"),
        F.sha2(F.col("id").cast("string"), 256).alias("l_shipmode"),
    ).write.parquet(f"{root}/lineitem")
    spark.range(600_000).select(
        F.col("id").alias("o_orderkey"), day.alias("o_orderdate"), F.lit("5-LOW").alias("o_orderpriority")
    ).write.parquet(f"{root}/orders")
    return spark.read.parquet(f"{root}/lineitem"), spark.read.parquet(f"{root}/orders")


@pytest.fixture
def small_partitions(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def executed(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_fact_splits_a_hot_order(hot, small_partitions):
    lines, orders = hot
    fact = facts.line_delivery(lines, orders).groupBy("is_late").agg(F.count("ship_mode"))
    assert "skew=true" in executed(fact)
    assert sum(r[1] for r in fact.collect()) == 600_000


def test_line_order_rules_split_a_hot_order(hot, small_partitions):
    lines, orders = hot
    counted = rules.rule_counts([rules.line_order_rules(lines, orders)])
    assert "skew=true" in executed(counted)
    assert {r.rule_id: r.violation_count for r in counted.collect()} == {"DQ-L1": 0, "DQ-L3": 0, "DQ-L8": 0}


def test_rollup_and_key_rules_sum_up_before_the_shuffle(hot, small_partitions):
    lines, orders = hot
    order_fact = facts.order_fulfillment(lines, orders)
    assert order_fact.where("order_key = 6").first().line_count == 200_000
    assert order_fact.count() == 600_000
    keyed = rules.rule_counts([rules.key_rules("orders", {"orders": orders, "lineitem": lines})])
    plan = executed(keyed)
    assert "partial_count" in plan and "Join" not in plan
    assert {r.rule_id: r.violation_count for r in keyed.collect()}["DQ-L9"] == 199_999


def test_samples_are_cut_inside_the_tasks(hot):
    lines, orders = hot
    frame = rules.line_order_rules(lines, orders.where("o_orderkey % 2 = 0"))
    sampled = rules._sampled(frame)
    plan = executed(sampled)
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert plan.split("Initial Plan")[0].count("Join") == 1  # one pass for all rules of the frame
    assert {r.table_name: r.sample_keys for r in sampled.collect()}["lineitem"].startswith('["1|1","5|5"')

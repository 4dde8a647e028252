"""The two Gold facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import first_of_month, late, urgent


def line_delivery(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per line that has an order."""
    joined = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("o_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_orderpriority").alias("order_priority"),
        urgent(F.col("o_orderpriority")).alias("is_urgent"),
        F.col("l_shipmode").alias("ship_mode"),
        F.col("l_shipdate").alias("ship_date"),
        F.col("l_commitdate").alias("commit_date"),
        F.col("l_receiptdate").alias("receipt_date"),
        F.datediff("l_receiptdate", "l_shipdate").alias("transit_days"),
        F.datediff("l_shipdate", "o_orderdate").alias("order_to_ship_days"),
        late().alias("is_late"),
        first_of_month(F.col("l_commitdate")).alias("commit_month"),
    )


def order_fulfillment(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per order, also for an order without lines.

    Lines are rolled up per order before the join: it cannot multiply rows, a hot order key shrinks
    in the tasks that read it, and the join takes over the rollup's partitioning.
    """
    rollup = lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(late()).alias("late_lines"),
        F.min("l_shipdate").alias("first_ship_date"),
        F.max("l_receiptdate").alias("last_receipt_date"),
    )
    line_count = F.coalesce("lines", F.lit(0))
    late_count = F.coalesce("late_lines", F.lit(0))
    return orders.join(rollup, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_orderpriority").alias("order_priority"),
        urgent(F.col("o_orderpriority")).alias("is_urgent"),
        line_count.alias("line_count"),
        late_count.alias("late_line_count"),
        ((line_count > 0) & (late_count == 0)).alias("is_fully_on_time"),
        "first_ship_date",
        "last_receipt_date",
        F.datediff("last_receipt_date", "o_orderdate").alias("order_to_complete_days"),
    )

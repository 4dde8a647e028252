"""The six Gold aggregates, derived from the histograms of the facts; percentiles are exact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import GOLD
from ..functions.frames import fold
from ..functions.measures import percentiles, share, weighted_mean, weighted_stddev_pop
from .facts import line_delivery, order_fulfillment
from .histograms import of_measure


def ship_mode_performance(histogram: DataFrame) -> DataFrame:
    """Speed, spread and lateness of each ship mode."""
    modes = of_measure(histogram, "ship_transit").groupBy("ship_mode").agg(
        F.sum("n").alias("line_count"),
        percentiles("value", (0.25, 0.5, 0.75, 0.9), "n").alias("p"),
        weighted_mean("value", "n").alias("transit_mean_days"),
        weighted_stddev_pop("value", "n").alias("transit_stddev_days"),
        F.sum("late").alias("late_line_count"),
    )
    p25, p50, p75, p90 = (F.col("p")[i] for i in range(4))
    return modes.withColumns({
        "transit_p50_days": p50,
        "transit_p90_days": p90,
        "transit_p90_minus_p50_days": p90 - p50,
        "transit_iqr_days": p75 - p25,
        "delay_rate": share(F.col("late_line_count"), F.col("line_count")),
    }).select(*GOLD["agg_ship_mode_performance"])


def on_time_summary(histogram: DataFrame) -> DataFrame:
    """One row: order shares and order sizes beside line shares."""
    of_orders = of_measure(histogram, "order_size").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("order_count"),
        F.sum("on_time").alias("fully_on_time_order_count"),
        F.min("value").alias("lines_per_order_min"),
        percentiles("value", (0.5,), "n")[0].alias("lines_per_order_p50"),
        weighted_mean("value", "n").alias("lines_per_order_mean"),
        F.max("value").alias("lines_per_order_max"),
    )
    of_lines = of_measure(histogram, "commit").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("line_count"), F.coalesce(F.sum("on_time"), F.lit(0)).alias("on_time_line_count")
    )
    return fold([of_orders, of_lines]).withColumns({
        "order_on_time_share": share(F.col("fully_on_time_order_count"), F.col("order_count")),
        "line_on_time_share": share(F.col("on_time_line_count"), F.col("line_count")),
    }).select(*GOLD["agg_on_time_summary"])


def on_time_by_line_count(histogram: DataFrame) -> DataFrame:
    """On-time shares by order size."""
    sizes = of_measure(histogram, "order_size").groupBy(F.col("value").alias("lines_in_order")).agg(
        F.sum("n").alias("order_count"),
        F.sum("on_time").alias("fully_on_time_order_count"),
        F.sum("late").alias("late_lines"),
    )
    lines = F.col("lines_in_order") * F.col("order_count")
    return sizes.withColumns({
        "order_on_time_share": share(F.col("fully_on_time_order_count"), F.col("order_count")),
        "line_on_time_share": share(lines - F.col("late_lines"), lines),
    }).select(*GOLD["agg_on_time_by_line_count"])


def _fulfillment(histogram: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Completion from orders, transit and order-to-ship from lines, joined per group."""
    of_orders = of_measure(histogram, "priority_complete").groupBy(*groups).agg(
        F.sum("n").alias("order_count"),
        percentiles("value", (0.5, 0.9), "n").alias("complete"),
        weighted_mean("value", "n").alias("complete_mean_days"),
    )
    moving = F.col("measure") == "priority_transit"
    movement = histogram.where(F.col("measure").isin("priority_transit", "priority_wait")).withColumns({
        "transit_days": F.when(moving, F.col("value")),
        "order_to_ship_days": F.when(~moving, F.col("value")),
    })
    of_lines = movement.groupBy(*groups).agg(
        F.sum(F.when(moving, F.col("n"))).alias("line_count"),
        percentiles("transit_days", (0.5, 0.9), "n").alias("transit"),
        weighted_mean("transit_days", "n").alias("transit_mean_days"),
        percentiles("order_to_ship_days", (0.5, 0.9), "n").alias("order_to_ship"),
        weighted_mean("order_to_ship_days", "n").alias("order_to_ship_mean_days"),
    )
    return of_orders.join(of_lines, list(groups)).withColumns({
        f"{measure}_{name}_days": F.col(measure)[i]
        for measure in ("complete", "transit", "order_to_ship")
        for i, name in enumerate(("p50", "p90"))
    })


def priority_fulfillment(histogram: DataFrame) -> DataFrame:
    """By order priority. The groups meet by plain equality, so a NULL priority has no row."""
    return _fulfillment(histogram, ("order_priority", "is_urgent")).select(*GOLD["agg_priority_fulfillment"])


def urgency_fulfillment(histogram: DataFrame) -> DataFrame:
    """Urgent against all others: the priorities' histograms added up, so percentiles are not averaged."""
    return _fulfillment(histogram, ("is_urgent",)).select(*GOLD["agg_urgency_fulfillment"])


def delay_rate_monthly(histogram: DataFrame) -> DataFrame:
    """Delay rate by commit month; the first and last month of the series are flagged.

    The window sees one row per calendar month, after the aggregation, and spares a second pass
    over the lines for the two bounds.
    """
    monthly = of_measure(histogram, "commit").groupBy("commit_month").agg(
        F.sum("n").alias("line_count"), F.sum("late").alias("late_line_count")
    )
    series = Window.partitionBy()
    month = F.col("commit_month")
    return monthly.withColumns({
        "delay_rate": share(F.col("late_line_count"), F.col("line_count")),
        "is_boundary_month": (month == F.min(month).over(series)) | (month == F.max(month).over(series)),
    }).select(*GOLD["agg_delay_rate_monthly"])


# What each Gold table is built from: facts from (lineitem, orders), aggregates from the histograms named.
FACT_BUILDERS = {"fct_lineitem_delivery": line_delivery, "fct_order_fulfillment": order_fulfillment}
AGGREGATE_BUILDERS = {
    "agg_ship_mode_performance": ship_mode_performance,
    "agg_on_time_summary": on_time_summary,
    "agg_on_time_by_line_count": on_time_by_line_count,
    "agg_priority_fulfillment": priority_fulfillment,
    "agg_urgency_fulfillment": urgency_fulfillment,
    "agg_delay_rate_monthly": delay_rate_monthly,
}
_FULFILLMENT = ("priority_transit", "priority_wait", "priority_complete")
AGGREGATE_MEASURES = {
    "agg_ship_mode_performance": ("ship_transit",),
    "agg_on_time_summary": ("commit", "order_size"),
    "agg_on_time_by_line_count": ("order_size",),
    "agg_priority_fulfillment": _FULFILLMENT,
    "agg_urgency_fulfillment": _FULFILLMENT,
    "agg_delay_rate_monthly": ("commit",),
}

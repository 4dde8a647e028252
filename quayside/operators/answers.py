"""The four answers, as tables over the Gold aggregates.

Every input here is an aggregate with one row per ship mode, order size, priority or month, so the
unpartitioned windows and the sorts see a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import fold, union_all
from ..functions.measures import days_text, percent_text

_SIDES = (("urgent", True), ("other", False))
_MEASURES = tuple(
    f"{grain}_{stat}_days" for grain in ("complete", "transit", "order_to_ship") for stat in ("p50", "p90", "mean")
)


def q1_table(modes: DataFrame) -> DataFrame:
    """Speed and spread per ship mode."""
    return modes.drop("late_line_count", "delay_rate").orderBy("ship_mode")


def q1_fastest(modes: DataFrame) -> DataFrame:
    """The modes with the lowest median, all of them on a tie, the lowest mean marked."""
    modes_seen = Window.partitionBy()
    lowest = modes.withColumn("best", F.min("transit_p50_days").over(modes_seen)).where("transit_p50_days = best")
    by_mean = Window.orderBy("transit_mean_days", "ship_mode")
    return lowest.select(
        "ship_mode", "transit_p50_days", "transit_mean_days",
        (F.count(F.lit(1)).over(modes_seen) > 1).alias("is_tied"),
        (F.row_number().over(by_mean) == 1).alias("has_lowest_mean"),
    )


def q1_most_predictable(modes: DataFrame) -> DataFrame:
    """The narrowest mode by p90 - p50, then IQR, deviation and name."""
    spread = ("transit_p90_minus_p50_days", "transit_iqr_days", "transit_stddev_days")
    return modes.select("ship_mode", *spread).orderBy(*spread, "ship_mode").limit(1)


def q2_gap(summary: DataFrame) -> DataFrame:
    """The summary with the distance between line and order share."""
    return summary.withColumn("share_gap", F.col("line_on_time_share") - F.col("order_on_time_share"))


def q2_by_size(sizes: DataFrame) -> DataFrame:
    return sizes.orderBy("lines_in_order")


def q3_delay_rate(modes: DataFrame) -> DataFrame:
    """Delay rates, worst first, ties by name."""
    return modes.select("ship_mode", "line_count", "late_line_count", "delay_rate").orderBy(
        F.col("delay_rate").desc(), "ship_mode"
    )


def q3_worst(modes: DataFrame) -> DataFrame:
    return q3_delay_rate(modes).limit(1)


def q4_urgency(urgency: DataFrame) -> DataFrame:
    return urgency.orderBy(F.col("is_urgent").desc())


def q4_priority(priorities: DataFrame) -> DataFrame:
    return priorities.orderBy("order_priority")


def q4_verdict(urgency: DataFrame) -> DataFrame:
    """Urgent and other orders in one row; a side without orders stays NULL, as does the verdict."""
    sides = urgency.agg(*[
        F.max(F.when(F.col("is_urgent") == flag, F.col(c))).alias(f"{side}_{c}")
        for side, flag in _SIDES for c in ("order_count", *_MEASURES)
    ])
    urgent, other = F.col("urgent_complete_p50_days"), F.col("other_complete_p50_days")
    verdict = F.when(urgent < other, "faster").when(urgent > other, "slower").when(urgent == other, "tie")
    return sides.withColumn("verdict", verdict)


def _month(name: str) -> Column:
    return F.coalesce(F.date_format(name, "yyyy-MM"), F.lit("no month"))


def answers_text(
    modes: DataFrame, summary: DataFrame, urgency: DataFrame, months: DataFrame, monitoring: DataFrame
) -> DataFrame:
    """Readable sentences per question; ``months`` are the marked months, ``monitoring`` their summary.

    A figure that does not exist (of a side without orders, of a series without a stable month) is called "none".
    """
    fastest = q1_fastest(modes).agg(
        F.array_join(F.array_sort(F.collect_list("ship_mode")), ", ").alias("names"),
        F.max("transit_p50_days").alias("p50"),
        F.max("is_tied").alias("tied"),
        F.max(F.when(F.col("has_lowest_mean"), F.col("ship_mode"))).alias("lowest"),
        F.min("transit_mean_days").alias("lowest_mean"),
    )
    told = F.concat(
        _month("commit_month"), F.lit(" ("), F.col("incomplete_reason"), F.lit(", "),
        F.col("line_count").cast("string"), F.lit(" lines, "), percent_text(F.col("delay_rate")), F.lit(")"),
    )
    listed = months.where("is_incomplete").agg(F.array_sort(F.collect_list(F.struct("commit_month", told.alias("told")))).alias("m"))
    listed = listed.select(F.array_join(F.transform("m", lambda x: x["told"]), ", ").alias("incomplete"))
    monitoring = fold([monitoring, listed])
    predictable = q1_most_predictable(modes)
    worst = q3_worst(modes)
    verdict = q4_verdict(urgency)

    def said(topic: str, frame: DataFrame, *parts) -> DataFrame:
        texts = [F.coalesce(p, F.lit("none")) if not isinstance(p, str) else F.lit(p) for p in parts]
        return frame.select(F.lit(topic).alias("topic"), F.concat(*texts).alias("answer"))

    def whole(name: str):
        return F.col(name).cast("string")

    def figures(side: str):
        return [F.lit(f"{side} n="), whole(f"{side}_order_count")] + [
            x for c in _MEASURES for x in (F.lit(f", {c.removesuffix('_days')}="), days_text(F.col(f"{side}_{c}")))
        ]

    return union_all([
        said(
            "q1_fastest", fastest, F.col("names"), F.when(F.col("tied"), " tie").otherwise(" is fastest"),
            " at a median of ", days_text(F.col("p50")), "; lowest mean: ", F.col("lowest"), " with ", days_text(F.col("lowest_mean")),
        ),
        said(
            "q1_predictable", predictable, F.col("ship_mode"), " has the narrowest p90 - p50: ",
            days_text(F.col("transit_p90_minus_p50_days")),
        ),
        said(
            "q2", q2_gap(summary), percent_text(F.col("order_on_time_share")), " of orders are fully on time, ",
            percent_text(F.col("line_on_time_share")), " of lines, a gap of ", percent_text(F.col("share_gap")),
            "; orders have ", whole("lines_per_order_min"), " to ", whole("lines_per_order_max"), " lines, ",
            F.format_string("%.2f", "lines_per_order_p50"), " in the median and ", F.format_string("%.2f", "lines_per_order_mean"), " on average",
        ),
        said(
            "q3", worst, F.col("ship_mode"), " is late most often: ", percent_text(F.col("delay_rate")), ", ",
            whole("late_line_count"), " of ", whole("line_count"), " lines",
        ),
        said("q4", verdict, "urgent orders: ", F.col("verdict"), "; ", *figures("urgent"), "; ", *figures("other")),
        said(
            "monitoring", monitoring, whole("month_count"), " commit months from ", _month("first_month"), " to ", _month("last_month"),
            ", overall delay rate ", percent_text(F.col("overall_delay_rate")), "; stable from ", _month("stable_first_month"), " to ",
            _month("stable_last_month"), " between ", percent_text(F.col("lowest_rate")), " (",
            _month("lowest_rate_month"), ") and ", percent_text(F.col("highest_rate")), " (",
            _month("highest_rate_month"), "), ", whole("stable_months"), " months with a mean rate of ",
            percent_text(F.col("mean_monthly_rate")), " and ", whole("min_lines"), " to ", whole("max_lines"), " lines each; median of all months: ",
            F.format_string("%.2f", "median_line_count"), " lines; incomplete: ", F.col("incomplete"),
            ". The rates of incomplete months cover a part of their lines and are no change of performance.",
        ),
    ])

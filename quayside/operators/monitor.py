"""Monthly monitoring of the delay rate: incomplete months and the stable period between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import share

EDGE_LINE_SHARE = 0.9


def edge_months(monthly: DataFrame, edge_share: float = EDGE_LINE_SHARE) -> DataFrame:
    """Mark months that hold only part of their lines.

    From either end inward, months below ``edge_share`` of the median month are edge months until
    one reaches it, i.e. those before the first or after the last month that does; without any such
    month all are. Lines without a commit month stand before all months and are a month like any other.
    The windows run over one row per calendar month.
    """
    series = Window.partitionBy()
    lines, at = F.col("line_count"), F.col("place")
    full = F.when(lines >= edge_share * F.col("median_line_count"), at)
    marked = (
        monthly.withColumn("median_line_count", F.percentile("line_count", 0.5).over(series))
        .withColumn("place", F.row_number().over(Window.orderBy(F.col("commit_month").asc_nulls_first())))
        .withColumns({"first_full": F.min(full).over(series), "last_full": F.max(full).over(series)})
        .withColumn("is_edge_month", F.coalesce((at < F.col("first_full")) | (at > F.col("last_full")), F.lit(True)))
        .withColumn("is_incomplete", F.coalesce("is_boundary_month", F.lit(False)) | F.col("is_edge_month"))
    )
    label = F.when(F.col("is_boundary_month"), "boundary").when(F.col("is_edge_month"), "low count")
    return marked.withColumn("incomplete_reason", label).drop("first_full", "last_full", "place").orderBy("commit_month")


def monitor_summary(months: DataFrame) -> DataFrame:
    """One row over the marked months; rates of the stable period, months earliest on ties."""
    stable = ~F.col("is_incomplete")

    def of_stable(column):
        return F.when(stable, column)

    month, rate, lines = F.col("commit_month"), F.col("delay_rate"), F.col("line_count")
    return months.agg(
        F.count(F.lit(1)).alias("month_count"),
        F.min(month).alias("first_month"),
        F.max(month).alias("last_month"),
        share(F.sum("late_line_count"), F.sum("line_count")).alias("overall_delay_rate"),
        F.count_if(stable).alias("stable_months"),
        F.min(of_stable(month)).alias("stable_first_month"),
        F.max(of_stable(month)).alias("stable_last_month"),
        F.min(of_stable(F.struct(rate.alias("rate"), month.alias("month")))).alias("low"),
        F.min(of_stable(F.struct((-rate).alias("rate"), month.alias("month")))).alias("high"),
        F.avg(of_stable(rate)).alias("mean_monthly_rate"),
        F.min(of_stable(lines)).alias("min_lines"),
        F.max(of_stable(lines)).alias("max_lines"),
        F.max("median_line_count").alias("median_line_count"),
    ).withColumns({
        "lowest_rate": F.col("low.rate"),
        "lowest_rate_month": F.col("low.month"),
        "highest_rate": -F.col("high.rate"),
        "highest_rate_month": F.col("high.month"),
    }).drop("low", "high")

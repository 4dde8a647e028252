"""Aggregates over (value, weight) histograms, ratios and delivery columns.

Day counts and line counts have few distinct values however many rows there are. The aggregates
therefore first count rows per value (a plain hash aggregate that shrinks each task's input to its
distinct values before the shuffle) and take percentiles, means and deviations from those counts.
The results are exact: a percentile over weighted values is the percentile over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import URGENT_PRIORITY


def percentiles(value: str, shares: Sequence[float], weight: str) -> Column:
    """Exact interpolated percentiles of all shares from one buffer; NULL values are ignored."""
    return F.percentile(value, list(shares), F.col(weight))


def weighted_count(value: str, weight: str) -> Column:
    return F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))


def weighted_mean(value: str, weight: str) -> Column:
    return share(F.sum(F.col(value) * F.col(weight)), weighted_count(value, weight))


def weighted_stddev_pop(value: str, weight: str) -> Column:
    """Population deviation from whole-number moments, kept exact in decimals until the root."""
    whole, count = F.col(value).cast("decimal(12,0)"), F.col(weight).cast("decimal(18,0)")
    rows = weighted_count(value, weight).cast("decimal(18,0)")
    total = F.sum(F.col(value) * F.col(weight)).cast("decimal(19,0)")
    squares = F.sum(whole * whole * count)
    return F.try_divide(F.sqrt((rows * squares - total * total).cast("double")), rows.cast("double"))


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` in double precision; NULL for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def urgent(priority: Column) -> Column:
    return priority == F.lit(URGENT_PRIORITY)


def late() -> Column:
    """Received strictly after the commit date; the commit date itself is on time."""
    return F.col("l_receiptdate") > F.col("l_commitdate")


def first_of_month(date: Column) -> Column:
    return F.trunc(date, "month")


def percent_text(value: Column) -> Column:
    """NULL for a NULL value, which ``format_string`` would print."""
    return F.when(value.isNotNull(), F.format_string("%.2f%%", 100 * value.cast("double")))


def days_text(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.2f days", value.cast("double")))

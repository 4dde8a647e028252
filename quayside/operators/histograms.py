"""One histogram relation over both facts, from which every Gold aggregate is derived.

Day counts, order sizes and months have few values, so rows per value are a small, exact summary: percentiles,
means, shares and deviations all follow from it. Each fact is read once, by one aggregation over grouping
sets whose partial sums are made in the tasks. Histograms of batches add up to that of the whole, as long as
an order and its lines are in one batch.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import union_all

# measure -> (columns of its groups, column whose values are counted)
LINE_MEASURES: dict[str, tuple[tuple[str, ...], str | None]] = {
    "ship_transit": (("ship_mode",), "transit_days"),
    "priority_transit": (("order_priority", "is_urgent"), "transit_days"),
    "priority_wait": (("order_priority", "is_urgent"), "order_to_ship_days"),
    "commit": (("commit_month",), None),
}
ORDER_MEASURES: dict[str, tuple[tuple[str, ...], str | None]] = {
    "order_size": ((), "line_count"),
    "priority_complete": (("order_priority", "is_urgent"), "order_to_complete_days"),
}
MEASURES = (*LINE_MEASURES, *ORDER_MEASURES)

GROUPS = {"ship_mode": "string", "order_priority": "string", "is_urgent": "boolean", "commit_month": "date"}
#: ``n`` rows, ``late`` lines and ``on_time`` rows of a value within a group of a measure.
SUMS = ("n", "late", "on_time")
COLUMNS = ("measure", *GROUPS, "value", *SUMS)


def _histogram(fact: DataFrame, measures: dict[str, tuple[tuple[str, ...], str | None]], sums: dict[str, Column]) -> DataFrame:
    sets = {m: [*groups, *([value] if value else [])] for m, (groups, value) in measures.items()}
    used = list(dict.fromkeys(c for columns in sets.values() for c in columns))
    counted = [column.alias(name) for name, column in sums.items()]
    if len(sets) == 1:
        (measure, columns), = sets.items()
        found = fact.groupBy(*columns).agg(*counted).withColumn("measure", F.lit(measure))
    else:
        absent = {frozenset(set(used) - set(columns)): m for m, columns in sets.items()}
        if len(absent) < len(sets):
            raise ValueError("two measures have the same columns")
        label = reduce(  # the columns a row is not grouped by say which set it is of
            lambda chain, item: chain.when(reduce(
                lambda a, b: a & b, [F.grouping(c) == F.lit(int(c in item[0])) for c in used]), item[1]),
            absent.items(), F.when(F.lit(False), F.lit("")))
        found = fact.groupingSets([[F.col(c) for c in columns] for columns in sets.values()], *used).agg(*counted, label.alias("measure"))
    value = reduce(lambda chain, m: chain.when(F.col("measure") == m, F.col(measures[m][1]) if measures[m][1] else F.lit(None)), measures, F.when(F.lit(False), F.lit(None)))
    groups = [(F.col(c) if c in used else F.lit(None)).cast(t).alias(c) for c, t in GROUPS.items()]
    return found.select("measure", *groups, value.cast("bigint").alias("value"), *SUMS)


def line_histograms(line_fact: DataFrame, measures: Collection[str] = tuple(LINE_MEASURES)) -> DataFrame:
    """Histograms of lines. A line of unknown delay is neither late nor on time."""
    return _histogram(line_fact, {m: LINE_MEASURES[m] for m in measures}, {
        "n": F.count(F.lit(1)), "late": F.count_if("is_late"), "on_time": F.count_if(~F.col("is_late")),
    })


def order_histograms(order_fact: DataFrame, measures: Collection[str] = tuple(ORDER_MEASURES)) -> DataFrame:
    """Histograms of the orders that have lines."""
    with_lines = order_fact.where(F.col("line_count") >= 1)
    return _histogram(with_lines, {m: ORDER_MEASURES[m] for m in measures}, {
        "n": F.count(F.lit(1)), "late": F.sum("late_line_count"), "on_time": F.count_if("is_fully_on_time"),
    })


def histograms(line_fact: DataFrame, order_fact: DataFrame, measures: Collection[str] = MEASURES) -> DataFrame:
    """The measures over both facts; a fact without a wanted measure is not read."""
    lines, orders = ([m for m in measures if m in known] for known in (LINE_MEASURES, ORDER_MEASURES))
    parts = [line_histograms(line_fact, lines)] if lines else []
    return union_all(parts + ([order_histograms(order_fact, orders)] if orders else []))


def merged(*parts: DataFrame) -> DataFrame:
    """The histograms of all batches together; no order may be in two of them."""
    keys = [c for c in COLUMNS if c not in SUMS]
    return union_all(parts).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS]).select(*COLUMNS)


def of_measure(histogram: DataFrame, measure: str) -> DataFrame:
    return histogram.where(F.col("measure") == measure)

"""Exact percentiles of columns with very many values, by distributed rank selection.

``functions.measures.percentiles`` keeps the distinct values of a group in one buffer, which suits day counts.
For prices and the like the wanted ranks are narrowed down instead: rows between two values are counted in
``SPLITS`` ranges of equal width, the range that holds a rank gives the next two values, and so on until they
are equal or few rows are left. Tasks hold one row per range; what the driver holds depends on the number of
groups and shares alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import written

SPLITS = 512
#: So many rows between two values, all wanted ranks together, are read by value instead of being split again.
FEW = 20_000


@dataclass
class _Search:
    """The value of 0-based ``rank`` within group ``nr``: the rank'th of the rows between ``low`` and ``high``."""

    nr: int
    rank: int
    low: float
    high: float
    rows: int

    @property
    def interval(self) -> tuple[int, float, float]:
        return self.nr, self.low, self.high

    @property
    def open(self) -> bool:
        return self.low < self.high


def _within(rows: DataFrame, intervals: list[tuple[int, float, float]]) -> DataFrame:
    """Rows with the numbers ``place`` of the intervals they lie in; intervals are few and sent to all tasks."""
    listed = rows.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(intervals)], "place int, of int, low double, high double")
    return rows.join(F.broadcast(listed), (F.col("nr") == F.col("of")) & F.col("value").between(F.col("low"), F.col("high")))


def _narrow(rows: DataFrame, searches: list[_Search]) -> None:
    """One pass over the rows of the open searches: each goes on in the range that holds its rank."""
    intervals = sorted({s.interval for s in searches})
    few = sum({s.interval: s.rows for s in searches}.values()) <= FEW
    width = F.col("value") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2  # halves cannot overflow
    part = F.least(F.floor(width[0] / width[1] * SPLITS), F.lit(SPLITS - 1))
    counted = _within(rows, intervals).groupBy("place", (F.col("value") if few else part).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    parts: dict[int, list] = {}
    for row in counted.collect():
        parts.setdefault(row["place"], []).append(row)
    for found in parts.values():
        found.sort(key=lambda r: r["low"])
    for s in searches:
        for row in parts[intervals.index(s.interval)]:
            if s.rank < row["n"]:
                s.low, s.high, s.rows = row["low"], row["high"], row["n"]
                break
            s.rank -= row["n"]


def exact_percentiles(df: DataFrame, value: str, shares: Sequence[float], by: str) -> DataFrame:
    """``by, share, n, value``: interpolated percentiles of the numbers in ``value`` for every group of ``by``.

    NULL and NaN values do not count; NULL is a group like any other, and a group without a value has none. The
    groups times the shares should be some thousands at most. Runs at once: one pass for the groups, then one
    for each narrowing. All read ``by`` and ``value``, written once, however costly ``df`` is to make.
    """
    numbers = df.select(F.col(by).alias("by"), F.col(value).cast("double").alias("value")).where("value is not null and not isnan(value)")
    numbers = written(numbers, "numbers")
    groups = numbers.groupBy("by").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
    groups.sort(key=lambda g: (g["by"] is not None, g["by"]))
    named = df.sparkSession.createDataFrame([(g["by"], i) for i, g in enumerate(groups)], f"name {df.select(by).dtypes[0][1]}, nr int")
    rows = numbers.join(F.broadcast(named), F.col("by").eqNullSafe(F.col("name"))).select("nr", "value")
    searches = {
        (i, rank): _Search(i, rank, g["low"], g["high"], g["n"])
        for i, g in enumerate(groups) for share in shares for rank in (math.floor(share * (g["n"] - 1)), math.ceil(share * (g["n"] - 1)))
    }
    while left := [s for s in searches.values() if s.open]:
        _narrow(rows, left)
    out = []
    for i, g in enumerate(groups):
        for share in shares:
            at = share * (g["n"] - 1)
            low, high = searches[i, math.floor(at)].low, searches[i, math.ceil(at)].low
            out.append((i, share, g["n"], low if low == high else low + (high - low) * (at - math.floor(at))))
    found = df.sparkSession.createDataFrame(out, "nr int, share double, n long, value double")
    return found.join(F.broadcast(named), "nr").select(F.col("name").alias(by), "share", "n", "value")

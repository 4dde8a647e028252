"""Boolean columns used by the validation rules and the profile."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_null(columns: Iterable[str]) -> Column:
    """True when at least one of the columns is NULL."""
    return reduce(or_, (F.col(c).isNull() for c in columns))


def outside_allowed(column: str, allowed: Iterable[str]) -> Column:
    """True for a value outside the list; NULL counts as outside."""
    return F.col(column).isNull() | ~F.col(column).isin(*allowed)

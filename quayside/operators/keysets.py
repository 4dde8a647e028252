"""Exact sets of whole-number keys as words of 64 neighbouring values, one bit each.

Keys are grouped by all their columns but the last and by the last one without its six lowest bits; these
six say which bit of the word a key is. ``bit_or`` makes a word from the rows of a task and merges the words of
tasks, within Spark's hash aggregation, so dense keys shrink up to 64 times before they are shuffled and sparse
ones are no larger than before. Sets answer how many keys there are, whether rows repeat one, and whether one
set holds another; only words with something wrong in them are then looked at key by key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import any_null

INTEGRAL = ("tinyint", "smallint", "int", "bigint")
#: So many words of a key are listed at most; with more, all keys are looked at.
MOST_WORDS = 10_000


def is_integral(df: DataFrame, columns: Sequence[str]) -> bool:
    types = dict(df.dtypes)
    return all(types[c] in INTEGRAL for c in columns)


def word(column: str) -> Column:
    return F.shiftright(F.col(column).cast("long"), 6)


def bit(column: str) -> Column:
    """A long with the key's bit of its word; NULL for a NULL key."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col(column).cast("long").bitwiseAND(F.lit(63)).cast("int"))


def words_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` but the last, ``word, bits, n``: the keys of a word and its rows. A NULL part of a key is a group of its own."""
    *prefix, last = columns
    return df.groupBy(*prefix, word(last).alias("word")).agg(F.bit_or(bit(last)).alias("bits"), F.count(F.lit(1)).alias("n"))


def is_missing(columns: Sequence[str]) -> Column:
    """Whether a row of ``words_of`` stands for keys with a NULL part."""
    return any_null([*columns[:-1], "word"])


def suspect_words(stacked: DataFrame, keys: Sequence[str], owner: str, references: Sequence[str], wanted: Sequence[str] = ()) -> DataFrame:
    """``words`` (an array: the key's first columns and its word) in which a key is NULL, repeated, or an orphan.

    A row of ``stacked`` is one of the owner if ``owner`` is not NULL, else one of a reference likewise. Owners
    that a reference in ``wanted`` never names are suspect too.
    """
    *prefix, last = keys
    own = F.when(F.col(owner).isNotNull(), bit(last))
    sums = [F.coalesce(F.bit_or(own), F.lit(0)).alias("owned"), F.count(owner).alias("rows")]
    sums += [F.coalesce(F.bit_or(F.when(F.col(r).isNotNull(), bit(last))), F.lit(0)).alias(f"used{i}") for i, r in enumerate(references)]
    grouped = stacked.groupBy(*prefix, word(last).alias("word")).agg(*sums)
    wrong = [is_missing(keys), F.col("rows") > F.bit_count("owned")]
    for i, r in enumerate(references):
        used, owned = F.col(f"used{i}"), F.col("owned")
        wrong.append(used.bitwiseOR(owned) != owned)
        if r in wanted:
            wrong.append(used.bitwiseOR(owned) != used)
    return grouped.where(reduce(or_, wrong)).select(F.array(*[F.col(c).cast("long") for c in (*prefix, "word")]).alias("words"))


def rows_of_words(rows: DataFrame, keys: Sequence[str], words: list[list[int | None]] | None) -> DataFrame:
    """The rows whose keys are in the listed words or, if such are listed, have a NULL part; all rows for None."""
    if words is None:
        return rows
    whole = [tuple(w) for w in words if None not in w]
    *prefix, last = keys
    parts = []
    if whole:  # at most MOST_WORDS
        listed = rows.sparkSession.createDataFrame(whole, ", ".join(f"w{i} long" for i in range(len(keys))))
        same = [F.col(c).cast("long") == F.col(f"w{i}") for i, c in enumerate(prefix)] + [word(last) == F.col(f"w{len(prefix)}")]
        parts.append(rows.join(F.broadcast(listed), reduce(lambda a, b: a & b, same), "left_semi"))
    if len(whole) < len(words):
        parts.append(rows.where(any_null(keys)))
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else rows.where(F.lit(False))

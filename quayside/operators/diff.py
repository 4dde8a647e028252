"""Two-way bag difference of tables and layers, in two steps over hashes of whole rows.

First each side is reduced to one row per bucket of hashes: a row count and sums of the hashes, which do not
depend on any order. Tasks sum up before the shuffle, so equal tables shuffle these digests and nothing else.
Rows of buckets whose digests differ are then netted by 96 bits of their hashes: 12 bytes a row and the number
of its table are shuffled, however wide the table is. Rows that differ are taken for equal only if these 96 bits
agree by chance: for a thousand million rows with a chance of 1e-11.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import union_all

#: Of the 32,768 buckets (15 bits of a hash): a table with more differing ones than this is compared whole; what the driver holds and sends out is bounded by it.
MOST_LISTED = 1 << 12

Pairs = Mapping[str, tuple[DataFrame, DataFrame]]


def _hashed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both sides as two hashes and their bucket; left rows count for, right rows against.

    Which columns are NULL is hashed too, as a NULL alone leaves a hash as it was.
    """
    def one_side(df: DataFrame, side: int) -> DataFrame:
        values = [F.col(f"`{c}`") for c in df.columns]
        nulls = [v.isNull() for v in values]
        return df.select(*[F.xxhash64(F.lit(salt), *values, *nulls).alias(f"h{salt}") for salt in (1, 2)], F.lit(side).alias("side"))

    return one_side(left, 1).unionByName(one_side(right, -1)).withColumn("bucket", F.shiftrightunsigned("h1", 49).cast("int"))


def _digests(left: DataFrame, right: DataFrame) -> DataFrame:
    """The buckets whose rows differ between the sides, by count or by one of the sums.

    The halves of the hashes are summed apart: so the sums of a bucket stay within a long for 2^31 rows,
    some 10^14 of a table.
    """
    halves = [half * F.col("side") for h in ("h1", "h2") for half in (F.shiftrightunsigned(h, 32), F.col(h).bitwiseAND(F.lit(0xFFFFFFFF)))]
    net = _hashed(left, right).groupBy("bucket").agg(F.sum("side").alias("rows"), *[F.sum(h).alias(f"s{i}") for i, h in enumerate(halves)])
    return net.where("rows <> 0 or s0 <> 0 or s1 <> 0 or s2 <> 0 or s3 <> 0").select("bucket")


def differing_buckets(pairs: Pairs) -> dict[str, list[int] | None]:
    """Runs the first step for all tables in one job: the differing buckets of each, None for more than are listed."""
    found = union_all(_digests(*sides).select(F.lit(name).alias("table_name"), "bucket") for name, sides in pairs.items())
    found = found.groupBy("table_name").agg(F.count(F.lit(1)).alias("n"), F.collect_list("bucket").alias("buckets"))
    listed = F.when(F.col("n") <= MOST_LISTED, F.col("buckets")).alias("listed")
    return dict.fromkeys(pairs, []) | {r["table_name"]: r["listed"] for r in found.select("table_name", listed).collect()}


def _differences(pairs: Pairs) -> DataFrame:
    for name, (left, right) in pairs.items():
        if left.columns != right.columns:
            raise ValueError(f"columns of {name or 'the sides'} differ: {left.columns} and {right.columns}")
    spark = next(iter(pairs.values()))[0].sparkSession
    names, rows = list(pairs), []
    for name, buckets in differing_buckets(pairs).items():
        if buckets == []:
            continue
        hashed = _hashed(*pairs[name])
        if buckets is not None:  # at most MOST_LISTED numbers
            wanted = spark.createDataFrame([(b,) for b in buckets], "bucket int")
            hashed = hashed.join(F.broadcast(wanted), "bucket", "left_semi")
        tag = F.col("h2").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(names.index(name) << 32).cast("long"))
        rows.append(hashed.select("h1", tag.alias("tag"), "side"))
    found = spark.createDataFrame([(name, 0) for name in pairs], "table_name string, net long")
    if rows:
        net = union_all(rows).groupBy("h1", "tag").agg(F.sum("side").alias("net"))
        name = F.get(F.array(*map(F.lit, names)), F.shiftright("tag", 32).cast("int"))
        found = found.unionByName(net.select(name.alias("table_name"), "net"))
    surplus = F.col("net")
    return found.groupBy("table_name").agg(
        F.sum(F.greatest(surplus, F.lit(0))).alias("left_only"), F.sum(F.greatest(-surplus, F.lit(0))).alias("right_only"),
    ).withColumn("unchanged", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def bag_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows only in ``left`` and only in ``right``, counted with multiplicity.

    NULLs equal NULLs. The sides need the same columns in the same order. The first step runs at once.
    """
    return _differences({"": (left, right)}).drop("table_name")


def layer_diff(left: Mapping[str, DataFrame], right: Mapping[str, DataFrame]) -> DataFrame:
    """``bag_diff`` of every table of two layers; each step is one job for all tables."""
    if set(left) != set(right):
        raise ValueError(f"tables differ: {sorted(left)} and {sorted(right)}")
    return _differences({t: (left[t], right[t]) for t in left}).orderBy("table_name")

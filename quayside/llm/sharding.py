"""Sharding by extendible hashing.

Rows are hashed by their key. A directory indexed by hash-prefix bits says which shard a prefix belongs to:
it starts with one bucket, and only a bucket over the byte limit is split on one more bit, until every shard
fits. Spark does the splits of several bits at once: rows are summed by a longer prefix, the sums are added up
for every shorter prefix, and a shard is a prefix that fits while the prefix one bit shorter does not.
Prefixes that do not fit at the longer length go round again with more bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import written

#: Bits of the hash, and how many more of them each round looks at.
BITS = 60
STEP = 12


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5; a null key counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(hashed: Column, bits: Column) -> Column:
    return F.call_function("shiftright", hashed, F.lit(BITS) - bits)


def directory(sizes: DataFrame, max_bytes: int) -> DataFrame:
    """``depth, prefix, shard_bytes, shard_rows`` of every shard, from rows of ``hash, bytes``.

    ``prefix`` is made of the first ``depth`` bits of all hashes in the shard. A shard over the limit is one
    hash, which no bit can split.
    """
    rest = sizes.groupBy("hash").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
    shards, depth = None, 0
    while True:
        longest = min(BITS, depth + STEP)
        cells = rest.groupBy((_prefix(F.col("hash"), F.lit(longest))).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(longest))))
        levels = levels.withColumn("prefix", F.call_function("shiftright", "cell", F.lit(longest) - F.col("depth")))
        sums = written(levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows")), "shard-sums")
        above = sums.where(F.col("shard_bytes") > max_bytes).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        split = sums.withColumn("parent", F.shiftright("prefix", 1)).join(above, ["depth", "parent"], "left_semi").drop("parent")
        fits = split.unionByName(sums.where("depth = 0")).where((F.col("shard_bytes") <= max_bytes) | (F.col("depth") == BITS))
        shards = fits if shards is None else shards.unionByName(fits)
        heavy = sums.where((F.col("depth") == longest) & (F.col("shard_bytes") > max_bytes)).select(F.col("prefix").alias("cell"))
        if longest == BITS or heavy.isEmpty():
            return written(shards, "shard-directory")
        rest = rest.join(heavy, _prefix(F.col("hash"), F.lit(longest)) == F.col("cell"), "left_semi")
        depth = longest


def with_shards(rows: DataFrame, max_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``rows`` with ``shard, depth, shard_bytes, shard_rows`` last; existing columns of these names are replaced.

    ``shard`` is the shard's hash prefix in binary digits, empty if one shard holds everything. A null text
    has no bytes. Rows with equal keys, null keys included, stay together, in a shard over the limit if they
    alone exceed it. An empty table gives no rows.

    Only sums by prefix are compared with the limit; the rows themselves meet the directory once, by the few
    prefix lengths that occur in it (at most 61 numbers reach the driver).
    """
    rows = rows.drop("shard", "depth", "shard_bytes", "shard_rows")
    hashed = hash_bits(F.col(key))
    sizes = rows.select(hashed.alias("hash"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("bytes"))
    shards = directory(sizes, max_bytes)
    depths = sorted(r["depth"] for r in shards.select("depth").distinct().collect())
    named = shards.select(
        F.col("depth"), "prefix", F.substring(F.lpad(F.bin("prefix"), BITS, "0"), F.lit(BITS + 1) - F.col("depth"), F.col("depth")).alias("shard"), "shard_bytes", "shard_rows")
    keys = sizes.select("hash").distinct().withColumn("depth", F.explode(F.array(*map(F.lit, depths)).cast("array<int>")))
    placed = keys.withColumn("prefix", _prefix(F.col("hash"), F.col("depth"))).join(named, ["depth", "prefix"])
    placed = placed.select(F.struct("shard", "depth", "shard_bytes", "shard_rows").alias("place"), F.col("hash").alias("of"))
    whole = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), hashed.alias("own"))  # any column name may come
    return whole.join(placed, F.col("own") == F.col("of")).select("row.*", "place.*")


def write_shards(rows: DataFrame, folder: str, max_bytes: int, key: str = "doc_id", text: str = "text") -> None:
    """Write ``rows`` as Parquet, a folder ``shard=<prefix>`` for each shard; rows of a shard come from few tasks.

    A shard over the limit (the rows of one hash) is dealt, by hashes of its texts, to as many tasks as it holds
    limits, so a hot key is not one task. Null keys, null texts and empty tables are as for ``with_shards``.
    """
    parts = F.greatest(F.ceil(F.col("shard_bytes") / max_bytes), F.lit(1))
    placed = with_shards(rows, max_bytes, key, text)
    placed.repartition("shard", F.pmod(F.xxhash64(text), parts)).write.partitionBy("shard").parquet(folder, compression="zstd")


def read_shards(rows: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, shard, depth, shard_bytes, shard_rows`` of every row in the folder, with sizes measured on what is read."""
    kinds = dict(rows.dtypes)
    found = rows.sparkSession.read.schema(f"`{key}` {kinds[key]}, `{text}` {kinds[text]}, shard string").parquet(folder)
    found = found.withColumn("shard", F.coalesce("shard", F.lit("")))  # an empty prefix is written as no value
    sized = found.select(key, "shard", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    sizes = sized.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return sized.drop("bytes").join(sizes, "shard").select(key, "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_rows")

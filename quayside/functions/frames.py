"""Small frame helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(frames: Iterable[DataFrame], fill: bool = False) -> DataFrame:
    """Union by name, in halves: a chain would analyse its growing plan again for every frame."""
    frames = list(frames)
    while len(frames) > 1:
        pairs = [frames[i : i + 2] for i in range(0, len(frames), 2)]
        frames = [p[0].unionByName(p[1], allowMissingColumns=fill) if len(p) == 2 else p[0] for p in pairs]
    return frames[0]


def fold(frames: Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Put aggregates with different columns side by side, one row per key.

    Each input has at most one row per key, so the union holds a handful of rows and ``max`` picks
    the one value each column has. It stands in for joining one-row frames on nothing.
    """
    stacked = union_all(frames, fill=True)
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in stacked.columns if c not in keys])


def per_key(values: Mapping[str, object], key: str, type_name: str) -> Column:
    """The contract value that belongs to the key column, as a literal lookup."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.create_map(*pairs)[F.col(key)].cast(type_name)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in a new folder that driver and executors share: computed once, however often it is read.

    The folder is below ``spark.checkpoint.dir``; without the setting a local master gets a temporary folder, any
    other one below the warehouse.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local["):
        base = "file://" + tempfile.mkdtemp(prefix="run-")
    path = f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_counts(tables: Mapping[str, DataFrame], counted_as: str) -> list[DataFrame]:
    """One ``(table_name, <counted_as>)`` row per table; a parquet count reads footers, not columns."""
    return [df.selectExpr(f"'{name}' AS table_name", f"count(*) AS {counted_as}") for name, df in tables.items()]

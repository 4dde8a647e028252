"""Bronze and staging: load metadata, contract projection, decomposition, and the injected fault."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import SILVER, TableContract

METADATA_COLUMNS = ("_ingested_at", "_source_table")


def bronze(df: DataFrame, source_name: str, ingested_at: datetime | Column) -> DataFrame:
    """Every source column as it is, plus one load time per execution and the source's full name."""
    stamp = ingested_at if isinstance(ingested_at, Column) else F.lit(ingested_at)
    return df.withColumns({"_ingested_at": stamp, "_source_table": F.lit(source_name)})


def conform(df: DataFrame, contract: TableContract) -> DataFrame:
    """Contract columns in contract order and type; keeps every row.

    A value that does not fit its type raises instead of turning into NULL (ANSI mode).
    """
    return df.selectExpr(*[f"CAST({name} AS {type_name}) AS {name}" for name, type_name in contract.columns])


def decompose(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per distinct combination; task-side distinct runs before the shuffle."""
    return df.select(*columns).distinct()


def staged(source: DataFrame, contract: TableContract) -> DataFrame:
    typed = conform(source, contract)
    return decompose(typed, typed.columns) if contract.decomposed else typed


def staged_tables(sources: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All Silver tables in publication order from the source (or Bronze) tables."""
    return {name: staged(sources[contract.source], contract) for name, contract in SILVER.items()}


def inject_receipt_before_ship(lineitem: DataFrame) -> DataFrame:
    """The first line by key is received the day before it was shipped; nothing else changes."""
    keys = ("l_orderkey", "l_linenumber")
    complete = lineitem.where(F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull())
    first = complete.agg(F.min(F.struct(*keys)).alias("k")).select(
        F.col("k.l_orderkey").alias("first_order"), F.col("k.l_linenumber").alias("first_line")
    )
    hit = (F.col("l_orderkey") == F.col("first_order")) & (F.col("l_linenumber") == F.col("first_line"))
    marked = lineitem.join(F.broadcast(first), hit, "left")  # broadcast of exactly one row
    receipt = F.when(F.col("first_order").isNotNull(), F.date_sub("l_shipdate", 1)).otherwise(F.col("l_receiptdate"))
    return marked.withColumn("l_receiptdate", receipt).select(*lineitem.columns)

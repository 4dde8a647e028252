"""Where the eight source tables are read from."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..config import plain_identifier


@dataclass(frozen=True)
class CatalogSource:
    """Tables of one ``catalog.schema``."""

    catalog: str
    schema: str

    def __post_init__(self):
        plain_identifier(self.catalog, "source catalog")
        plain_identifier(self.schema, "source schema")

    @classmethod
    def parse(cls, name: str) -> CatalogSource:
        catalog, dot, schema = name.partition(".")
        if not dot:
            raise ValueError(f"{name!r} names no schema; write catalog and schema with a dot between them")
        return cls(catalog, schema)

    @property
    def label(self) -> str:
        return f"{self.catalog}.{self.schema}"

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.table(f"{self.label}.{plain_identifier(table, 'table')}")


@dataclass(frozen=True)
class ParquetSource:
    """One parquet file or directory per table under a root folder."""

    root: str
    label: str = "parquet.files"
    suffix: str = ".parquet"

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.parquet(f"{self.root.rstrip('/')}/{plain_identifier(table, 'table')}{self.suffix}")


@dataclass(frozen=True)
class FrameSource:
    """Tables that are already DataFrames."""

    frames: Mapping[str, DataFrame]
    label: str = "session.frames"

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return self.frames[table]


def read_source(spark: SparkSession, source, table: str) -> DataFrame:
    return source.read(spark, table)

"""The only writer: full-refresh and append sinks over parquet tables of the session catalog."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_PREFIX, Layout

_LEFT = re.compile(r"(?P<table>.+?)__(?P<aside>aside_)?[0-9a-f]{12}")


class Store:
    """Tables of one layout.

    ``buckets`` maps a table name to ``(number, columns)``. Tables bucketed alike join on those
    columns without a shuffle. It is off by default: one bucket is one task, so a key that holds a
    large part of the rows is better left to adaptive skew splitting.
    """

    def __init__(
        self,
        spark: SparkSession,
        layout: Layout,
        buckets: Mapping[str, tuple[int, tuple[str, ...]]] | None = None,
        writers: int = 4,
    ):
        self.spark = spark
        self.layout = layout
        self.buckets = dict(buckets or {})
        self.writers = writers
        self.observed: dict[str, dict[str, int]] = {}  # what was measured while a pending version was written

    def name(self, layer: str, table: str) -> str:
        return self.layout.table(layer, table)

    def exists(self, layer: str, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(layer, table))

    def read(self, layer: str, table: str) -> DataFrame:
        return self.spark.table(self.name(layer, table))

    def read_all(self, layer: str, tables: Iterable[str]) -> dict[str, DataFrame]:
        return {t: self.read(layer, t) for t in tables}

    def ensure_layer(self, layer: str) -> None:
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {self.layout.schema(layer)}")

    def ensure(self, layer: str, table: str, schema: str) -> None:
        """Create an empty typed table if it is missing; never replaces one."""
        self.ensure_layer(layer)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name(layer, table)} ({schema}) USING parquet")

    def write_new(self, df: DataFrame, layer: str, table: str, measures: Mapping[str, Column] | None = None) -> str:
        """Write the next version beside the current table and return its temporary name.

        Its rows are counted, and the aggregates in ``measures`` are taken, by the tasks that write: nothing
        is read for it. They are in ``observed`` under the temporary name until the version is put in place.
        """
        self.ensure_layer(layer)
        pending = f"{self.name(layer, table)}__{uuid.uuid4().hex[:12]}"
        bucketed = self.buckets.get(table)
        if bucketed:
            df = df.repartition(bucketed[0], *bucketed[1])
        seen = Observation(pending)
        # measured in the last stage: a lost shuffle file that is made again does not count twice
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(name) for name, m in (measures or {}).items()])
        writer = df.write.format("parquet")
        if bucketed:
            writer = writer.bucketBy(bucketed[0], *bucketed[1])
        writer.saveAsTable(pending)
        self.observed[pending] = dict(seen.get)
        return pending

    def write_all(self, frames: Mapping[str, DataFrame], layer: str, measures: Mapping[str, Mapping[str, Column]] | None = None) -> dict[str, str]:
        """``write_new`` for independent tables, a few at a time, so small ones fill idle executors.

        If one fails, the versions already written are dropped and the error is raised.
        """
        self.ensure_layer(layer)
        with ThreadPoolExecutor(max_workers=self.writers) as pool:
            started = {t: pool.submit(self.write_new, df, layer, t, (measures or {}).get(t)) for t, df in frames.items()}
        failed = [f.exception() for f in started.values() if f.exception()]
        if failed:
            self.discard(f.result() for f in started.values() if not f.exception())
            raise failed[0]
        return {t: f.result() for t, f in started.items()}

    def replace_all(
        self,
        frames: Mapping[str, DataFrame],
        layer: str,
        check: Callable[[dict[str, DataFrame], dict[str, dict[str, int]]], None] | None = None,
        properties: Mapping[str, Mapping[str, str]] | None = None,
        measures: Mapping[str, Mapping[str, Column]] | None = None,
    ) -> None:
        """Write new versions, let ``check`` look at them and at what was measured, and only then put them in place."""
        pending = self.write_all(frames, layer, measures)
        try:
            if check:
                check({t: self.spark.table(name) for t, name in pending.items()}, {t: self.observed[name] for t, name in pending.items()})
        except Exception:
            self.discard(pending.values())
            raise
        self.swap(layer, pending, properties)

    def swap(self, layer: str, pending: Mapping[str, str], properties: Mapping[str, Mapping[str, str]] | None = None):
        """Put finished versions in place of the current tables.

        All data is written by then; only catalog entries change here. Current tables step aside under
        another name and are dropped after the last table is in place. If anything fails before, they
        come back and the pending versions are dropped.
        """
        aside: dict[str, str] = {}
        placed: list[str] = []
        try:
            for table, written in pending.items():
                full = self.name(layer, table)
                if self.exists(layer, table):
                    aside[full] = f"{full}__aside_{uuid.uuid4().hex[:12]}"
                    self._rename(full, aside[full])
                declared = (properties or {}).get(table)
                if declared:
                    pairs = ", ".join(f"'{key}' = '{value}'" for key, value in declared.items())
                    self.spark.sql(f"ALTER TABLE {written} SET TBLPROPERTIES ({pairs})")
                self._rename(written, full)
                self.observed.pop(written, None)
                placed.append(full)
        except Exception:
            self.discard(placed)
            for full, old in aside.items():
                if self.spark.catalog.tableExists(old):
                    self._rename(old, full)
            self.discard(pending.values())
            raise
        self.discard(aside.values())

    def _rename(self, old: str, new: str) -> None:
        self.spark.sql(f"ALTER TABLE {old} RENAME TO {new.partition('.')[2]}")  # the new name may not repeat the catalog

    def sweep(self, layers: Iterable[str]) -> None:
        """Drop what a lost driver left: versions that were never put in place. Only while no other run writes here.

        A current table that had stepped aside when the driver was lost comes back under its name.
        """
        for layer in layers:
            schema = self.layout.schema(layer)
            if not self.spark.catalog.databaseExists(schema):
                continue
            names = {r.tableName for r in self.spark.sql(f"SHOW TABLES IN {schema}").collect()}
            for name in sorted(names):
                left = _LEFT.fullmatch(name)
                if left and left["aside"] and left["table"] not in names:
                    self._rename(f"{schema}.{name}", f"{schema}.{left['table']}")
                elif left:
                    self.discard([f"{schema}.{name}"])

    def discard(self, pending: Iterable[str]) -> None:
        for written in pending:
            self.observed.pop(written, None)
            self.spark.sql(f"DROP TABLE IF EXISTS {written}")

    def replace(self, df: DataFrame, layer: str, table: str) -> None:
        """Full refresh of one table; the source may be the table itself."""
        self.swap(layer, {table: self.write_new(df, layer, table)})

    def append(self, df: DataFrame, layer: str, table: str, keys: Sequence[str] = ()) -> None:
        """Add rows. With ``keys``, rows whose keys are there already are left out, so a repeated append adds nothing."""
        if keys:
            there = self.read(layer, table).select(*[F.col(k).alias(f"__{k}") for k in keys])
            same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
            df = df.dropDuplicates(list(keys)).join(there, reduce(lambda a, b: a & b, same), "left_anti").coalesce(1)
        df.write.format("parquet").mode("append").saveAsTable(self.name(layer, table))

    def compact(self, layer: str, table: str, period: Column) -> None:
        """Rewrite a table of many small files so that the rows of a period are in one file; only while no run appends."""
        rows = self.read(layer, table)
        periods = rows.agg(F.count_distinct(F.coalesce(period.cast("string"), F.lit("")))).first()[0]
        self.replace(rows.repartition(max(1, periods), period).sortWithinPartitions(period), layer, table)

    def snapshot(self, layer: str, tables: Iterable[str]) -> None:
        """Copy a whole layer into the snapshot layer."""
        self._scratch_only("snapshots are taken")
        self.replace_all(self.read_all(layer, tables), "snapshot")

    def drop_layers(self, layers: Iterable[str]) -> None:
        """Drop layers of a scratch prefix with everything in them."""
        self._scratch_only("layers are dropped")
        for layer in layers:
            self.spark.sql(f"DROP SCHEMA IF EXISTS {self.layout.schema(layer)} CASCADE")

    def _scratch_only(self, what: str) -> None:
        if self.layout.prefix == DEFAULT_PREFIX:
            raise ValueError(f"{what} only in a scratch prefix, not in {DEFAULT_PREFIX!r}")

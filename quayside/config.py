"""Names, allowed values and session settings."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

# The source tables, in load order.
SOURCE_TABLES = ("region", "nation", "supplier", "customer", "part", "partsupp", "orders", "lineitem")

# The categories the source specification allows.
SHIP_MODES = ("AIR", "FOB", "MAIL", "RAIL", "REG AIR", "SHIP", "TRUCK")
RETURN_FLAGS = ("A", "N", "R")
LINE_STATUSES = ("F", "O")
URGENT_PRIORITY = "1-URGENT"

LAYERS = ("bronze", "staging", "silver", "gold", "audit", "snapshot")
DEFAULT_PREFIX = "delivery"

_PLAIN = re.compile(r"[A-Za-z0-9_]+")


def plain_identifier(name: str, what: str) -> str:
    """Names end up unquoted in SQL, so anything but letters, digits and ``_`` is refused."""
    if not isinstance(name, str) or not _PLAIN.fullmatch(name):
        raise ValueError(f"{name!r} cannot be the {what}: only letters, digits and _ are used in names")
    return name


@dataclass(frozen=True)
class Layout:
    """Maps ``(layer, table)`` to ``catalog.prefix_layer.table``."""

    catalog: str = "spark_catalog"
    prefix: str = DEFAULT_PREFIX

    def __post_init__(self):
        plain_identifier(self.catalog, "catalog")
        plain_identifier(self.prefix, "prefix")

    def schema(self, layer: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"layer must be one of {LAYERS}, got {layer!r}")
        return f"{self.catalog}.{self.prefix}_{layer}"

    def table(self, layer: str, table: str) -> str:
        plain_identifier(table, "table")
        name = f"stg_{table}" if layer == "staging" else table
        return f"{self.schema(layer)}.{name}"


def new_run_id() -> str:
    """A fresh id for one execution; it is handed on as an argument, never kept in a global."""
    return str(uuid.uuid4())


def require_run_id(run_id: str | None) -> str:
    if not run_id:
        raise ValueError("run_id is required: start an execution with new_run_id()")
    return run_id


def session(app: str = "quayside", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on.

    Adaptive execution sizes shuffle partitions and splits skewed join partitions at run time. Its
    starting partition count and the executor sizes stay with the cluster. A full run compiles some
    hundred stages; the code cache is made large enough to keep them for the next run.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.codegen.cache.maxEntries": "2000",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

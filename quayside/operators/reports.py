"""Contract reports between layers, the enforced constraints, and the list of declared ones.

Names and types are compared on the plans; only row counts run, all tables of a report in one job. A report
takes counts that are known already, from the pass that wrote the tables, and then reads those tables no more.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..config import SOURCE_TABLES
from ..contracts import FOREIGN_KEYS, GOLD, SILVER
from ..functions.frames import fold, per_key, row_counts, union_all
from .layers import METADATA_COLUMNS

_TABLE = ("table_name",)
Rows = Mapping[str, int]


def _rows(tables: Mapping[str, DataFrame], label: str, known: Rows | None) -> list[DataFrame]:
    """Row counts under ``label``: the known ones, or counted."""
    if known is None:
        return row_counts(tables, label)
    spark = next(iter(tables.values())).sparkSession
    return [spark.createDataFrame([(t, known[t]) for t in tables], f"table_name string, {label} long")]


class ContractError(AssertionError):
    """A layer does not have the columns, types or rows it must have."""


def bronze_report(source: Mapping[str, DataFrame], bronze: Mapping[str, DataFrame], source_rows: Rows | None = None) -> DataFrame:
    """Bronze against the source: columns in name, order and type, load metadata, row counts."""
    own = {t: [c for c in bronze[t].dtypes if c[0] not in METADATA_COLUMNS] for t in SOURCE_TABLES}
    added = {t: tuple(c for c in bronze[t].columns if c in METADATA_COLUMNS) for t in SOURCE_TABLES}
    counts = fold(
        _rows({t: source[t] for t in SOURCE_TABLES}, "source_rows", source_rows)
        + row_counts({t: bronze[t] for t in SOURCE_TABLES}, "bronze_rows"),
        _TABLE,
    )
    return counts.withColumns({
        "source_columns": per_key({t: len(source[t].dtypes) for t in SOURCE_TABLES}, "table_name", "int"),
        "bronze_columns": per_key({t: len(own[t]) for t in SOURCE_TABLES}, "table_name", "int"),
        "names_and_types_match": per_key({t: source[t].dtypes == own[t] for t in SOURCE_TABLES}, "table_name", "boolean"),
        "metadata_columns_present": per_key(
            {t: added[t] == METADATA_COLUMNS for t in SOURCE_TABLES}, "table_name", "boolean"
        ),
        "row_counts_match": F.col("source_rows") == F.col("bronze_rows"),
    }).select(
        "table_name", "source_columns", "bronze_columns", "names_and_types_match", "metadata_columns_present",
        "source_rows", "bronze_rows", "row_counts_match",
        (F.col("names_and_types_match") & F.col("metadata_columns_present") & F.col("row_counts_match")).alias("ok"),
    )


def staging_report(bronze: Mapping[str, DataFrame], staging: Mapping[str, DataFrame], bronze_rows: Rows | None = None) -> DataFrame:
    """Staging against the contract; tables split off another one have no row count to keep."""
    kept = {t: bronze[t] for t, contract in SILVER.items() if not contract.decomposed}
    counts = fold(_rows(kept, "bronze_rows", bronze_rows) + row_counts({t: staging[t] for t in SILVER}, "staging_rows"), _TABLE)
    matches = {t: tuple(staging[t].dtypes) == contract.columns for t, contract in SILVER.items()}
    return counts.withColumns({
        "columns_match_contract": per_key(matches, "table_name", "boolean"),
        "row_counts_match": F.col("bronze_rows").isNull() | (F.col("bronze_rows") == F.col("staging_rows")),
    }).select(
        "table_name", "columns_match_contract", "bronze_rows", "staging_rows", "row_counts_match",
        (F.col("columns_match_contract") & F.col("row_counts_match")).alias("ok"),
    )


def silver_report(staging: Mapping[str, DataFrame], silver: Mapping[str, DataFrame], staging_rows: Rows | None = None) -> DataFrame:
    """Silver has as many rows as the staging table it was published from."""
    counts = fold(
        _rows({t: staging[t] for t in SILVER}, "staging_rows", staging_rows)
        + row_counts({t: silver[t] for t in SILVER}, "silver_rows"),
        _TABLE,
    )
    return counts.withColumn("ok", F.col("staging_rows") == F.col("silver_rows"))


def gold_report(gold: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each Gold table and whether its columns are those of the contract."""
    matches = {t: tuple(gold[t].columns) == columns for t, columns in GOLD.items()}
    counts = union_all(row_counts({t: gold[t] for t in GOLD}, "row_count"))
    return counts.withColumn("columns_match_contract", per_key(matches, "table_name", "boolean")).orderBy("table_name")


def require_ok(report: DataFrame, ok: str = "ok") -> dict[str, Row]:
    """Raise with the names of the tables that do not match; else the report's rows, one per table."""
    rows = {r.table_name: r for r in report.collect()}
    failed = sorted(t for t, r in rows.items() if not r[ok])
    if failed:
        raise ContractError(f"contract not met by: {failed}")
    return rows


def enforced_measures(table: str) -> dict[str, Column]:
    """The rows against each NOT NULL and CHECK constraint of a table, as aggregates to take while it is written."""
    contract = SILVER[table]
    broken = {f"{c} NOT NULL": F.col(c).isNull() for c in contract.required}
    broken |= {check: ~F.coalesce(F.expr(rule), F.lit(False)) for check, rule in contract.checks}
    return {label: F.count_if(rule) for label, rule in broken.items()}


def enforced_violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows against each NOT NULL and CHECK constraint, one scan per table."""

    def of_table(name: str) -> DataFrame:
        measures = enforced_measures(name)
        found = tables[name].agg(*[m.alias(f"v{i}") for i, m in enumerate(measures.values())])
        rows = F.array(*[
            F.struct(F.lit(name).alias("table_name"), F.lit(label).alias("constraint"), F.col(f"v{i}").alias("violations"))
            for i, label in enumerate(measures)
        ])
        return found.select(F.inline(rows))

    return union_all(of_table(t) for t in tables)


def raise_if_broken(measured: Mapping[str, Mapping[str, int]]) -> None:
    """Parquet tables take no constraints: raise for violations that were counted while the tables were written."""
    broken = [(t, label, own[label]) for t, own in measured.items() for label in enforced_measures(t) if own[label] > 0]
    if broken:
        raise ContractError("; ".join(f"{t}: {label} broken by {n} rows" for t, label, n in broken))


def assert_enforced(tables: Mapping[str, DataFrame]) -> None:
    """``raise_if_broken`` for tables that are already there, in one scan each."""
    found: dict[str, dict[str, int]] = {t: {} for t in tables}
    for r in enforced_violations(tables).collect():
        found[r.table_name][r.constraint] = r.violations
    raise_if_broken(found)


def constraint_listing(spark: SparkSession) -> DataFrame:
    """Every declared constraint with its columns."""
    rows = [(t, f"{t}_pk", "PRIMARY KEY", ", ".join(c.primary_key)) for t, c in SILVER.items()]
    rows += [(fk.child, fk.name, "FOREIGN KEY", ", ".join(fk.child_columns)) for fk in FOREIGN_KEYS]
    rows += [(t, f"{column}_not_null", "NOT NULL", column) for t, c in SILVER.items() for column in c.required]
    rows += [(t, name, "CHECK", rule) for t, c in SILVER.items() for name, rule in c.checks]
    listing = spark.createDataFrame(
        rows, "table_name string, constraint_name string, constraint_type string, columns string"
    )
    return listing.orderBy("table_name", "constraint_type", "constraint_name")


def constraint_properties(table: str) -> dict[str, str]:
    """The declared constraints of one table as table properties, so they travel with it."""
    contract = SILVER[table]
    declared = {f"constraint.{table}_pk": f"PRIMARY KEY ({', '.join(contract.primary_key)})"}
    for fk in FOREIGN_KEYS:
        if fk.child == table:
            parent = f"{fk.parent} ({', '.join(fk.parent_columns)})"
            declared[f"constraint.{fk.name}"] = f"FOREIGN KEY ({', '.join(fk.child_columns)}) REFERENCES {parent}"
    declared |= {f"constraint.{c}_not_null": f"NOT NULL ({c})" for c in contract.required}
    declared |= {f"constraint.{name}": f"CHECK ({rule})" for name, rule in contract.checks}
    return declared

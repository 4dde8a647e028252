"""The declared shape of Silver and Gold: columns, types, keys, references and enforced constraints."""

from __future__ import annotations

from dataclasses import dataclass

from .config import SOURCE_TABLES


@dataclass(frozen=True)
class ForeignKey:
    name: str
    child: str
    child_columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class TableContract:
    name: str
    columns: tuple[tuple[str, str], ...]
    primary_key: tuple[str, ...]
    source: str
    not_null: tuple[str, ...] = ()
    checks: tuple[tuple[str, str], ...] = ()

    @property
    def decomposed(self) -> bool:
        """True for a table that holds the distinct determinant of a rule, not source rows."""
        return self.source != self.name

    @property
    def required(self) -> tuple[str, ...]:
        return self.primary_key + tuple(c for c in self.not_null if c not in self.primary_key)


# Columns, types, keys and enforced constraints of every Silver table, in publication order (parents first).
_TABLES = (
    TableContract(
        name="region",
        columns=(
            ("r_regionkey", "bigint"),
            ("r_name", "string"),
            ("r_comment", "string"),
        ),
        primary_key=("r_regionkey",),
        source="region",
    ),
    TableContract(
        name="nation",
        columns=(
            ("n_nationkey", "bigint"),
            ("n_name", "string"),
            ("n_regionkey", "bigint"),
            ("n_comment", "string"),
        ),
        primary_key=("n_nationkey",),
        source="nation",
    ),
    TableContract(
        name="supplier",
        columns=(
            ("s_suppkey", "bigint"),
            ("s_name", "string"),
            ("s_address", "string"),
            ("s_nationkey", "bigint"),
            ("s_phone", "string"),
            ("s_acctbal", "decimal(18,2)"),
            ("s_comment", "string"),
        ),
        primary_key=("s_suppkey",),
        source="supplier",
    ),
    TableContract(
        name="customer",
        columns=(
            ("c_custkey", "bigint"),
            ("c_name", "string"),
            ("c_address", "string"),
            ("c_nationkey", "bigint"),
            ("c_phone", "string"),
            ("c_acctbal", "decimal(18,2)"),
            ("c_mktsegment", "string"),
            ("c_comment", "string"),
        ),
        primary_key=("c_custkey",),
        source="customer",
    ),
    TableContract(
        name="brand",
        columns=(
            ("p_brand", "string"),
            ("p_mfgr", "string"),
        ),
        primary_key=("p_brand",),
        source="part",
    ),
    TableContract(
        name="part",
        columns=(
            ("p_partkey", "bigint"),
            ("p_name", "string"),
            ("p_brand", "string"),
            ("p_type", "string"),
            ("p_size", "int"),
            ("p_container", "string"),
            ("p_retailprice", "decimal(18,2)"),
            ("p_comment", "string"),
        ),
        primary_key=("p_partkey",),
        source="part",
    ),
    TableContract(
        name="partsupp",
        columns=(
            ("ps_partkey", "bigint"),
            ("ps_suppkey", "bigint"),
            ("ps_availqty", "int"),
            ("ps_supplycost", "decimal(18,2)"),
            ("ps_comment", "string"),
        ),
        primary_key=("ps_partkey", "ps_suppkey"),
        source="partsupp",
    ),
    TableContract(
        name="orders",
        columns=(
            ("o_orderkey", "bigint"),
            ("o_custkey", "bigint"),
            ("o_orderstatus", "string"),
            ("o_totalprice", "decimal(18,2)"),
            ("o_orderdate", "date"),
            ("o_orderpriority", "string"),
            ("o_clerk", "string"),
            ("o_shippriority", "int"),
            ("o_comment", "string"),
        ),
        primary_key=("o_orderkey",),
        source="orders",
        not_null=("o_orderdate",),
    ),
    TableContract(
        name="ship_date_status",
        columns=(
            ("l_shipdate", "date"),
            ("l_linestatus", "string"),
        ),
        primary_key=("l_shipdate",),
        source="lineitem",
        not_null=("l_linestatus",),
    ),
    TableContract(
        name="part_quantity_price",
        columns=(
            ("l_partkey", "bigint"),
            ("l_quantity", "decimal(18,2)"),
            ("l_extendedprice", "decimal(18,2)"),
        ),
        primary_key=("l_partkey", "l_quantity"),
        source="lineitem",
    ),
    TableContract(
        name="lineitem",
        columns=(
            ("l_orderkey", "bigint"),
            ("l_partkey", "bigint"),
            ("l_suppkey", "bigint"),
            ("l_linenumber", "int"),
            ("l_quantity", "decimal(18,2)"),
            ("l_discount", "decimal(18,2)"),
            ("l_tax", "decimal(18,2)"),
            ("l_returnflag", "string"),
            ("l_shipdate", "date"),
            ("l_commitdate", "date"),
            ("l_receiptdate", "date"),
            ("l_shipinstruct", "string"),
            ("l_shipmode", "string"),
            ("l_comment", "string"),
        ),
        primary_key=("l_orderkey", "l_linenumber"),
        source="lineitem",
        not_null=("l_shipdate", "l_commitdate", "l_receiptdate", "l_shipmode", "l_returnflag"),
        checks=(("lineitem_receipt_after_ship", "l_receiptdate >= l_shipdate"),),
    ),
)
SILVER: dict[str, TableContract] = {t.name: t for t in _TABLES}

# Foreign keys.
FOREIGN_KEYS: tuple[ForeignKey, ...] = (
    ForeignKey("nation_region_fk", "nation", ("n_regionkey",), "region", ("r_regionkey",)),
    ForeignKey("supplier_nation_fk", "supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    ForeignKey("customer_nation_fk", "customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    ForeignKey("part_brand_fk", "part", ("p_brand",), "brand", ("p_brand",)),
    ForeignKey("partsupp_part_fk", "partsupp", ("ps_partkey",), "part", ("p_partkey",)),
    ForeignKey("partsupp_supplier_fk", "partsupp", ("ps_suppkey",), "supplier", ("s_suppkey",)),
    ForeignKey("orders_customer_fk", "orders", ("o_custkey",), "customer", ("c_custkey",)),
    ForeignKey("part_quantity_price_part_fk", "part_quantity_price", ("l_partkey",), "part", ("p_partkey",)),
    ForeignKey("lineitem_orders_fk", "lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    ForeignKey("lineitem_partsupp_fk", "lineitem", ("l_partkey", "l_suppkey"), "partsupp", ("ps_partkey", "ps_suppkey")),
    ForeignKey("lineitem_ship_date_status_fk", "lineitem", ("l_shipdate",), "ship_date_status", ("l_shipdate",)),
    ForeignKey("lineitem_part_quantity_price_fk", "lineitem", ("l_partkey", "l_quantity"), "part_quantity_price", ("l_partkey", "l_quantity")),
)

# Columns of every Gold table.
GOLD: dict[str, tuple[str, ...]] = {
    "fct_lineitem_delivery": (
        "order_key", "line_number", "order_date", "order_priority", "is_urgent", "ship_mode", "ship_date",
        "commit_date", "receipt_date", "transit_days", "order_to_ship_days", "is_late", "commit_month",
    ),
    "fct_order_fulfillment": (
        "order_key", "order_date", "order_priority", "is_urgent", "line_count", "late_line_count",
        "is_fully_on_time", "first_ship_date", "last_receipt_date", "order_to_complete_days",
    ),
    "agg_ship_mode_performance": (
        "ship_mode", "line_count", "transit_p50_days", "transit_p90_days", "transit_p90_minus_p50_days",
        "transit_iqr_days", "transit_mean_days", "transit_stddev_days", "late_line_count", "delay_rate",
    ),
    "agg_on_time_summary": (
        "order_count", "fully_on_time_order_count", "order_on_time_share", "line_count",
        "on_time_line_count", "line_on_time_share", "lines_per_order_min", "lines_per_order_p50",
        "lines_per_order_mean", "lines_per_order_max",
    ),
    "agg_on_time_by_line_count": (
        "lines_in_order", "order_count", "fully_on_time_order_count", "order_on_time_share",
        "line_on_time_share",
    ),
    "agg_priority_fulfillment": (
        "order_priority", "is_urgent", "order_count", "complete_p50_days", "complete_p90_days",
        "complete_mean_days", "line_count", "transit_p50_days", "transit_p90_days", "transit_mean_days",
        "order_to_ship_p50_days", "order_to_ship_p90_days", "order_to_ship_mean_days",
    ),
    "agg_urgency_fulfillment": (
        "is_urgent", "order_count", "complete_p50_days", "complete_p90_days", "complete_mean_days",
        "line_count", "transit_p50_days", "transit_p90_days", "transit_mean_days", "order_to_ship_p50_days",
        "order_to_ship_p90_days", "order_to_ship_mean_days",
    ),
    "agg_delay_rate_monthly": (
        "commit_month", "line_count", "late_line_count", "delay_rate", "is_boundary_month",
    ),
}
FACTS = ("fct_lineitem_delivery", "fct_order_fulfillment")

VALIDATE_RULES = tuple(f"DQ-L{i}" for i in range(1, 10)) + ("DQ-G1", "DQ-G2", "DQ-G3")
GOLD_RULES = ("DQ-GOLD1", "DQ-GOLD2")

# The results, as (rule, table), that a complete validation leaves; a reference is named after its child table.
VALIDATE_RESULTS = (
    *((f"DQ-L{i}", "lineitem") for i in (1, 2, 3, 4, 5, 6, 8)),
    ("DQ-L4", "orders"), ("DQ-L7", "ship_date_status"), ("DQ-L9", "orders"),
    *(("DQ-G1", table) for table in SILVER),
    *(("DQ-G2", f"{fk.child}.{fk.name}") for fk in FOREIGN_KEYS),
    *(("DQ-G3", table) for table in SOURCE_TABLES),
)
GOLD_RESULTS = tuple(zip(GOLD_RULES, FACTS))

DQ_RESULTS_SCHEMA = (
    "run_id string, run_ts timestamp, rule_id string, layer string, table_name string, "
    "violation_count bigint, sample_keys string, severity string, passed boolean"
)
RUNS_SCHEMA = (
    "run_id string, event string, event_ts timestamp, catalog string, schema_prefix string, source string"
)

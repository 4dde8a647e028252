"""The eight source tables, derived row by row from the smaller tables of the test data.

``clean`` obeys every rule, ``dirty`` breaks most of them in a known number of places. All values
come from the row's own keys, so two engines get the same tables. FIXTURES.md has the SQL twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import SHIP_MODES, SOURCE_TABLES

# Schemas of the test tables. Giving them spares a job that reads footers before each query.
RAW = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
}
CUTOFF = "DATE '1998-06-17'"  # ship dates after it are open, receipts after it cannot be returned yet


def raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(RAW[table]).parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def _money(column: str) -> str:
    return f"CAST({column} AS DECIMAL(18,2)) AS {column}"


def _mix(order: int, line: int, part: int, supp: int, modulo: int) -> str:
    return f"((l_orderkey * {order} + l_linenumber * {line} + l_partkey * {part} + l_suppkey * {supp}) % {modulo})"


def _later(date: str, days: str) -> str:
    return f"date_add({date}, CAST({days} AS INT))"


def _pick(code: str, values: tuple[str, ...]) -> str:
    """The value at position ``code``; NULL past the end."""
    listed = ", ".join(f"'{v}'" for v in values)
    return f"get(array({listed}), CAST({code} AS INT))"


def region(spark, sf_dir, dirty=False):
    return raw(spark, sf_dir, "region").selectExpr("CAST(r_regionkey AS BIGINT) AS r_regionkey", "r_name", "'' AS r_comment")


def nation(spark, sf_dir, dirty=False):
    return raw(spark, sf_dir, "nation").selectExpr(
        "CAST(n_nationkey AS BIGINT) AS n_nationkey", "n_name", "CAST(n_regionkey AS BIGINT) AS n_regionkey",
        "'' AS n_comment",
    )


def supplier(spark, sf_dir, dirty=False):
    return raw(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey", "s_name", "'' AS s_address", "CAST(s_nationkey AS BIGINT) AS s_nationkey",
        "concat_ws('-', s_nationkey + 10, s_suppkey) AS s_phone", _money("s_acctbal"), "'' AS s_comment",
    )


def customer(spark, sf_dir, dirty=False):
    return raw(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_name", "'' AS c_address", "CAST(c_nationkey AS BIGINT) AS c_nationkey",
        "concat_ws('-', c_nationkey + 10, c_custkey) AS c_phone", _money("c_acctbal"), "c_mktsegment",
        "'' AS c_comment",
    )


def part(spark, sf_dir, dirty=False):
    maker, brand = "concat('Manufacturer#', substring(p_brand, 7, 1))", "p_brand"
    if dirty:
        maker = f"CASE WHEN p_partkey % 53 = 0 THEN 'Manufacturer#X' ELSE {maker} END"
        brand = "CASE WHEN p_partkey % 157 <> 0 THEN p_brand END AS p_brand"
    return raw(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_name", f"{maker} AS p_mfgr", brand, "p_type", "p_size", "'BOX' AS p_container",
        _money("p_retailprice"), "'' AS p_comment",
    )


def _merged_lines(spark, sf_dir):
    """One line per order and line number; the test data repeats line numbers within an order.

    Equal keys are summed up in a hash aggregate. Numbering the rows of an order in a window would
    put a whole order into one task.
    """
    lines = raw(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _money("l_quantity"), "l_discount", "l_tax"
    )
    merged = (
        lines.groupBy("l_orderkey", "l_linenumber")
        .agg({"l_partkey": "min", "l_suppkey": "min", "l_quantity": "sum", "l_discount": "max", "l_tax": "max"})
        .selectExpr(
            "l_orderkey", "l_linenumber", "`min(l_partkey)` AS l_partkey", "`min(l_suppkey)` AS l_suppkey",
            "CAST(`sum(l_quantity)` AS DECIMAL(18,2)) AS l_quantity",
            "CAST(`max(l_discount)` AS DECIMAL(18,2)) AS l_discount",
            "CAST(`max(l_tax)` AS DECIMAL(18,2)) AS l_tax",
        )
    )
    return merged.unionByName(_first_lines(spark, sf_dir))


def _first_lines(spark, sf_dir):
    """A line for each order that has none, made of the order's own key; every part and supplier so named exists."""
    used = raw(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS o_orderkey").distinct()
    return raw(spark, sf_dir, "orders").join(used, "o_orderkey", "left_anti").selectExpr(
        "o_orderkey AS l_orderkey", "1 AS l_linenumber", "o_orderkey % 200 AS l_partkey", "o_orderkey % 10 AS l_suppkey",
        "CAST(1 AS DECIMAL(18,2)) AS l_quantity", "CAST(0 AS DECIMAL(18,2)) AS l_discount",
        "CAST(0 AS DECIMAL(18,2)) AS l_tax",
    )


def _clean_lineitem(spark, sf_dir):
    ordered = raw(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "CAST(o_orderdate AS DATE) AS ordered")
    prices = raw(spark, sf_dir, "part").selectExpr("p_partkey AS l_partkey", "CAST(p_retailprice AS DECIMAL(18,2)) AS price")
    dated = (
        _merged_lines(spark, sf_dir).join(ordered, "l_orderkey").join(prices, "l_partkey")
        .selectExpr(
            "*",
            f"{_later('ordered', f'1 + {_mix(7919, 10007, 31, 11, 121)}')} AS l_shipdate",
            f"{_later('ordered', f'30 + {_mix(6151, 4931, 7, 97, 61)}')} AS l_commitdate",
            f"{_later('l_shipdate', f'1 + {_mix(1543, 1229, 53, 389, 30)}')} AS l_receiptdate",
            f"{_pick(_mix(3, 5, 1, 0, 7), SHIP_MODES)} AS l_shipmode",
        )
    )
    return dated.selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "CAST(l_quantity * price AS DECIMAL(18,2)) AS l_extendedprice", "l_discount", "l_tax",
        f"CASE WHEN l_receiptdate > {CUTOFF} THEN 'N' WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN 'R' ELSE 'A' END"
        " AS l_returnflag",
        f"CASE WHEN l_shipdate > {CUTOFF} THEN 'O' ELSE 'F' END AS l_linestatus",
        "l_shipdate", "l_commitdate", "l_receiptdate", "'NONE' AS l_shipinstruct", "l_shipmode", "'' AS l_comment",
    )


def _dirty_lineitem(spark, sf_dir):
    shipped = "CAST(l_shipdate AS DATE)"
    committed = _later(shipped, f"{_mix(6151, 4931, 7, 97, 61)} - 30")
    return raw(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        *[_money(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")],
        f"CASE WHEN {_mix(11, 7, 3, 5, 89)} = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag",
        f"CASE WHEN {_mix(13, 7, 3, 5, 83)} <> 0 THEN l_linestatus END AS l_linestatus",
        f"{shipped} AS l_shipdate",
        f"CASE WHEN {_mix(17, 3, 5, 7, 97)} <> 0 THEN {committed} END AS l_commitdate",
        f"{_later(shipped, f'{_mix(1543, 1229, 53, 389, 32)} - 1')} AS l_receiptdate",
        "'NONE' AS l_shipinstruct",
        f"{_pick(_mix(3, 5, 1, 0, 9), (*SHIP_MODES, 'DRONE'))} AS l_shipmode",
        "'' AS l_comment",
    )


def lineitem(spark, sf_dir, dirty=False):
    return _dirty_lineitem(spark, sf_dir) if dirty else _clean_lineitem(spark, sf_dir)


def orders(spark, sf_dir, dirty=False):
    source = raw(spark, sf_dir, "orders")
    key, date = "o_orderkey", "CAST(o_orderdate AS DATE) AS o_orderdate"
    if dirty:
        # some orders move to a key no line refers to: their lines become orphans, they lose their lines
        key = "CASE WHEN o_orderkey % 101 = 0 THEN -1 - o_orderkey ELSE o_orderkey END AS o_orderkey"
        date = "CASE WHEN o_orderkey % 211 <> 0 THEN CAST(o_orderdate AS DATE) END AS o_orderdate"
    return source.selectExpr(
        key, "o_custkey", "o_orderstatus", _money("o_totalprice"), date, "o_orderpriority", "'' AS o_clerk",
        "0 AS o_shippriority", "'' AS o_comment",
    )


def partsupp(spark, sf_dir, dirty=False):
    lines = raw(spark, sf_dir, "lineitem") if dirty else _merged_lines(spark, sf_dir)
    supplier_key = "CASE WHEN l_partkey % 13 = 0 THEN -1 - l_suppkey ELSE l_suppkey END" if dirty else "l_suppkey"
    return (
        lines.select("l_partkey", "l_suppkey").distinct()
        .selectExpr(
            "l_partkey AS ps_partkey", f"{supplier_key} AS ps_suppkey",
            "CAST((l_partkey + l_suppkey) % 1000 AS INT) AS ps_availqty",
            "CAST((l_partkey * 7 + l_suppkey) % 1000 AS DECIMAL(18,2)) AS ps_supplycost", "'' AS ps_comment",
        )
    )


_BUILDERS = dict(zip(SOURCE_TABLES, (region, nation, supplier, customer, part, partsupp, orders, lineitem)))


def source_table(spark: SparkSession, sf_dir: str, table: str, dirty: bool = False) -> DataFrame:
    return _BUILDERS[table](spark, sf_dir, dirty)


def source_tables(spark: SparkSession, sf_dir: str, dirty: bool = False) -> dict[str, DataFrame]:
    return {t: source_table(spark, sf_dir, t, dirty) for t in SOURCE_TABLES}

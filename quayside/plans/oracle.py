"""The registered queries as plain SQL over the test tables, in DuckDB's dialect.

Written apart from the DataFrame code: percentiles straight over rows, keys and references checked
on rows, differences with EXCEPT ALL. A query without an entry here is checked by unit tests only.
"""

from __future__ import annotations

import re

# --- source tables -----------------------------------------------------------------------------

_MIX = "(({a}l_orderkey*%d + {a}l_linenumber*%d + {a}l_partkey*%d + {a}l_suppkey*%d) %% %d)"


def _mix(order: int, line: int, part: int, supp: int, modulo: int, alias: str = "") -> str:
    return (_MIX % (order, line, part, supp, modulo)).format(a=alias)


_MODES = " ".join(
    f"WHEN {i} THEN '{m}'" for i, m in enumerate(("AIR", "FOB", "MAIL", "RAIL", "REG AIR", "SHIP", "TRUCK"))
)


def _plain(p: str) -> dict[str, str]:
    """Relations both fixtures share, under prefix ``p``."""
    return {
        f"{p}_region": "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name, '' AS r_comment FROM region",
        f"{p}_nation": (
            "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, "
            "'' AS n_comment FROM nation"
        ),
        f"{p}_supplier": (
            "SELECT s_suppkey, s_name, '' AS s_address, CAST(s_nationkey AS BIGINT) AS s_nationkey, "
            "CAST(s_nationkey + 10 AS VARCHAR) || '-' || CAST(s_suppkey AS VARCHAR) AS s_phone, "
            "CAST(s_acctbal AS DECIMAL(18,2)) AS s_acctbal, '' AS s_comment FROM supplier"
        ),
        f"{p}_customer": (
            "SELECT c_custkey, c_name, '' AS c_address, CAST(c_nationkey AS BIGINT) AS c_nationkey, "
            "CAST(c_nationkey + 10 AS VARCHAR) || '-' || CAST(c_custkey AS VARCHAR) AS c_phone, "
            "CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal, c_mktsegment, '' AS c_comment FROM customer"
        ),
        f"{p}_brand": f"SELECT DISTINCT p_brand, p_mfgr FROM {p}_part",
        f"{p}_ship_date_status": f"SELECT DISTINCT l_shipdate, l_linestatus FROM {p}_lineitem",
        f"{p}_part_quantity_price": f"SELECT DISTINCT l_partkey, l_quantity, l_extendedprice FROM {p}_lineitem",
    }


_PART = (
    "SELECT p_partkey, p_name, {maker} AS p_mfgr, {brand} AS p_brand, p_type, CAST(p_size AS INTEGER) AS p_size, "
    "'BOX' AS p_container, CAST(p_retailprice AS DECIMAL(18,2)) AS p_retailprice, '' AS p_comment FROM part"
)
_ORDERS = (
    "SELECT {key} AS o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, "
    "{date} AS o_orderdate, o_orderpriority, '' AS o_clerk, CAST(0 AS INTEGER) AS o_shippriority, '' AS o_comment "
    "FROM orders"
)
_PARTSUPP = (
    "SELECT DISTINCT l_partkey AS ps_partkey, {supp} AS ps_suppkey, "
    "CAST((l_partkey + l_suppkey) % 1000 AS INTEGER) AS ps_availqty, "
    "CAST((l_partkey * 7 + l_suppkey) % 1000 AS DECIMAL(18,2)) AS ps_supplycost, '' AS ps_comment FROM {lines}"
)

RELATIONS: dict[str, str] = {
    **_plain("c"),
    "c_part": _PART.format(maker="'Manufacturer#' || substring(p_brand, 7, 1)", brand="p_brand"),
    "c_lines": (
        "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, "
        "CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS l_quantity, "
        "CAST(max(l_discount) AS DECIMAL(18,2)) AS l_discount, CAST(max(l_tax) AS DECIMAL(18,2)) AS l_tax "
        "FROM lineitem GROUP BY l_orderkey, l_linenumber UNION ALL SELECT o_orderkey, CAST(1 AS INTEGER), "
        "o_orderkey % 200, o_orderkey % 10, CAST(1 AS DECIMAL(18,2)), CAST(0 AS DECIMAL(18,2)), CAST(0 AS DECIMAL(18,2)) "
        "FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"
    ),
    "c_dated": (
        "SELECT l.*, CAST(p.p_retailprice AS DECIMAL(18,2)) AS price, "
        f"CAST(o.o_orderdate AS DATE) + CAST(1 + {_mix(7919, 10007, 31, 11, 121, 'l.')} AS INTEGER) AS l_shipdate, "
        f"CAST(o.o_orderdate AS DATE) + CAST(30 + {_mix(6151, 4931, 7, 97, 61, 'l.')} AS INTEGER) AS l_commitdate, "
        f"CAST(1 + {_mix(1543, 1229, 53, 389, 30, 'l.')} AS INTEGER) AS td, "
        f"CASE {_mix(3, 5, 1, 0, 7, 'l.')} {_MODES} END AS l_shipmode "
        "FROM c_lines l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey"
    ),
    "c_lineitem": (
        "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, "
        "CAST(l_quantity * price AS DECIMAL(18,2)) AS l_extendedprice, l_discount, l_tax, "
        "CASE WHEN l_shipdate + td > DATE '1998-06-17' THEN 'N' WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN 'R' "
        "ELSE 'A' END AS l_returnflag, CASE WHEN l_shipdate > DATE '1998-06-17' THEN 'O' ELSE 'F' END AS l_linestatus, "
        "l_shipdate, l_commitdate, l_shipdate + td AS l_receiptdate, 'NONE' AS l_shipinstruct, l_shipmode, "
        "'' AS l_comment FROM c_dated"
    ),
    "c_orders": _ORDERS.format(key="o_orderkey", date="CAST(o_orderdate AS DATE)"),
    "c_partsupp": _PARTSUPP.format(supp="l_suppkey", lines="c_lines"),
    **_plain("d"),
    "d_part": _PART.format(
        maker="CASE WHEN p_partkey % 53 = 0 THEN 'Manufacturer#X' ELSE 'Manufacturer#' || substring(p_brand, 7, 1) END",
        brand="CASE WHEN p_partkey % 157 = 0 THEN NULL ELSE p_brand END",
    ),
    "d_lineitem": (
        "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS DECIMAL(18,2)) AS l_quantity, "
        "CAST(l_extendedprice AS DECIMAL(18,2)) AS l_extendedprice, CAST(l_discount AS DECIMAL(18,2)) AS l_discount, "
        "CAST(l_tax AS DECIMAL(18,2)) AS l_tax, "
        f"CASE WHEN {_mix(11, 7, 3, 5, 89)} = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag, "
        f"CASE WHEN {_mix(13, 7, 3, 5, 83)} = 0 THEN NULL ELSE l_linestatus END AS l_linestatus, "
        "CAST(l_shipdate AS DATE) AS l_shipdate, "
        f"CASE WHEN {_mix(17, 3, 5, 7, 97)} = 0 THEN NULL ELSE "
        f"CAST(l_shipdate AS DATE) + CAST({_mix(6151, 4931, 7, 97, 61)} - 30 AS INTEGER) END AS l_commitdate, "
        f"CAST(l_shipdate AS DATE) + CAST({_mix(1543, 1229, 53, 389, 32)} - 1 AS INTEGER) AS l_receiptdate, "
        "'NONE' AS l_shipinstruct, "
        f"CASE {_mix(3, 5, 1, 0, 9)} {_MODES} WHEN 7 THEN 'DRONE' END AS l_shipmode, '' AS l_comment FROM lineitem"
    ),
    "d_orders": _ORDERS.format(
        key="CASE WHEN o_orderkey % 101 = 0 THEN -1 - o_orderkey ELSE o_orderkey END",
        date="CASE WHEN o_orderkey % 211 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END",
    ),
    "d_partsupp": _PARTSUPP.format(
        supp="CASE WHEN l_partkey % 13 = 0 THEN -1 - l_suppkey ELSE l_suppkey END", lines="lineitem"
    ),
}

# --- Silver, Gold and answers ------------------------------------------------------------------

# Columns of the staged tables, and the source tables.
_STAGED = {
    "region": "r_regionkey, r_name, r_comment",
    "nation": "n_nationkey, n_name, n_regionkey, n_comment",
    "supplier": "s_suppkey, s_name, s_address, s_nationkey, s_phone, s_acctbal, s_comment",
    "customer": "c_custkey, c_name, c_address, c_nationkey, c_phone, c_acctbal, c_mktsegment, c_comment",
    "brand": "p_brand, p_mfgr",
    "part": "p_partkey, p_name, p_brand, p_type, p_size, p_container, p_retailprice, p_comment",
    "partsupp": "ps_partkey, ps_suppkey, ps_availqty, ps_supplycost, ps_comment",
    "orders": (
        "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, o_clerk, o_shippriority, "
        "o_comment"
    ),
    "ship_date_status": "l_shipdate, l_linestatus",
    "part_quantity_price": "l_partkey, l_quantity, l_extendedprice",
    "lineitem": (
        "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_shipdate, "
        "l_commitdate, l_receiptdate, l_shipinstruct, l_shipmode, l_comment"
    ),
}
_TABLES = tuple(_STAGED)
_SOURCES = ("region", "nation", "supplier", "customer", "part", "partsupp", "orders", "lineitem")


def _days(later: str, earlier: str) -> str:
    return f"CAST(date_diff('day', {earlier}, {later}) AS INTEGER)"


def _pct(column: str, share: float) -> str:
    return f"quantile_cont(CAST({column} AS DOUBLE), {share})"


def _times(column: str, name: str) -> str:
    return (
        f"{_pct(column, 0.5)} AS {name}_p50_days, {_pct(column, 0.9)} AS {name}_p90_days, "
        f"CAST(avg({column}) AS DOUBLE) AS {name}_mean_days"
    )


_COUNT = "CAST(count(*) AS BIGINT)"


def _count_if(rule: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {rule}) AS BIGINT)"


def _fulfillment(groups: str, on: str) -> str:
    measured = ", ".join(
        f"{g}_{s}_days" for g in ("complete",) for s in ("p50", "p90", "mean")
    ), ", ".join(f"{g}_{s}_days" for g in ("transit", "order_to_ship") for s in ("p50", "p90", "mean"))
    keys = ", ".join(f"o.{g}" for g in groups.split(", "))
    return (
        f"SELECT {keys}, order_count, {measured[0]}, line_count, {measured[1]} FROM "
        f"(SELECT {groups}, {_COUNT} AS order_count, {_times('order_to_complete_days', 'complete')} "
        f"FROM fct_order WHERE line_count >= 1 GROUP BY {groups}) o JOIN "
        f"(SELECT {groups}, {_COUNT} AS line_count, {_times('transit_days', 'transit')}, "
        f"{_times('order_to_ship_days', 'order_to_ship')} FROM fct_line GROUP BY {groups}) l ON {on}"
    )


def _facts(p: str) -> dict[str, str]:
    return {
        "fct_line" if p == "c" else "d_fct_line": (
            "SELECT l_orderkey AS order_key, l_linenumber AS line_number, o_orderdate AS order_date, "
            "o_orderpriority AS order_priority, o_orderpriority = '1-URGENT' AS is_urgent, l_shipmode AS ship_mode, "
            "l_shipdate AS ship_date, l_commitdate AS commit_date, l_receiptdate AS receipt_date, "
            f"{_days('l_receiptdate', 'l_shipdate')} AS transit_days, {_days('l_shipdate', 'o_orderdate')} AS order_to_ship_days, "
            "l_receiptdate > l_commitdate AS is_late, CAST(date_trunc('month', l_commitdate) AS DATE) AS commit_month "
            f"FROM {p}_lineitem JOIN {p}_orders ON o_orderkey = l_orderkey"
        ),
        "fct_order" if p == "c" else "d_fct_order": (
            "SELECT o_orderkey AS order_key, o_orderdate AS order_date, o_orderpriority AS order_priority, "
            "o_orderpriority = '1-URGENT' AS is_urgent, coalesce(n, 0) AS line_count, coalesce(late, 0) AS late_line_count, "
            "coalesce(n, 0) >= 1 AND coalesce(late, 0) = 0 AS is_fully_on_time, first_ship_date, last_receipt_date, "
            f"{_days('last_receipt_date', 'o_orderdate')} AS order_to_complete_days FROM {p}_orders LEFT JOIN "
            f"(SELECT l_orderkey, {_COUNT} AS n, {_count_if('l_receiptdate > l_commitdate')} AS late, "
            "min(l_shipdate) AS first_ship_date, max(l_receiptdate) AS last_receipt_date "
            f"FROM {p}_lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey"
        ),
    }


RELATIONS |= {
    **_facts("c"),
    **_facts("d"),
    "modes": (
        "SELECT *, transit_p90_days - transit_p50_days AS transit_p90_minus_p50_days, p75 - p25 AS transit_iqr_days, "
        "late_line_count / line_count AS delay_rate FROM (SELECT ship_mode, "
        f"{_COUNT} AS line_count, {_pct('transit_days', 0.25)} AS p25, {_pct('transit_days', 0.75)} AS p75, "
        f"{_times('transit_days', 'transit')}, stddev_pop(transit_days) AS transit_stddev_days, "
        f"{_count_if('is_late')} AS late_line_count FROM fct_line GROUP BY ship_mode)"
    ),
    "agg_ship_mode_performance": (
        "SELECT ship_mode, line_count, transit_p50_days, transit_p90_days, transit_p90_minus_p50_days, "
        "transit_iqr_days, transit_mean_days, transit_stddev_days, late_line_count, delay_rate FROM modes"
    ),
    "agg_on_time_summary": (
        "SELECT order_count, fully_on_time_order_count, fully_on_time_order_count / order_count AS order_on_time_share, "
        "line_count, on_time_line_count, on_time_line_count / line_count AS line_on_time_share, lines_per_order_min, "
        "lines_per_order_p50, lines_per_order_mean, lines_per_order_max FROM "
        f"(SELECT {_COUNT} AS order_count, {_count_if('is_fully_on_time')} AS fully_on_time_order_count, "
        f"min(line_count) AS lines_per_order_min, {_pct('line_count', 0.5)} AS lines_per_order_p50, "
        "CAST(avg(line_count) AS DOUBLE) AS lines_per_order_mean, max(line_count) AS lines_per_order_max "
        "FROM fct_order WHERE line_count >= 1), "
        f"(SELECT {_COUNT} AS line_count, {_count_if('NOT is_late')} AS on_time_line_count FROM fct_line)"
    ),
    "agg_on_time_by_line_count": (
        f"SELECT line_count AS lines_in_order, {_COUNT} AS order_count, {_count_if('is_fully_on_time')} AS "
        f"fully_on_time_order_count, {_count_if('is_fully_on_time')} / count(*) AS order_on_time_share, "
        "CAST(sum(line_count - late_line_count) AS DOUBLE) / CAST(sum(line_count) AS DOUBLE) AS line_on_time_share "
        "FROM fct_order WHERE line_count >= 1 GROUP BY line_count"
    ),
    "agg_priority_fulfillment": _fulfillment(
        "order_priority, is_urgent", "l.order_priority = o.order_priority AND l.is_urgent = o.is_urgent"
    ),
    "agg_urgency_fulfillment": _fulfillment("is_urgent", "l.is_urgent = o.is_urgent"),
    "monthly": f"SELECT commit_month, {_COUNT} AS line_count, {_count_if('is_late')} AS late_line_count FROM fct_line GROUP BY 1",
    "agg_delay_rate_monthly": (
        "SELECT commit_month, line_count, late_line_count, late_line_count / line_count AS delay_rate, "
        "commit_month IN ((SELECT min(commit_month) FROM monthly), (SELECT max(commit_month) FROM monthly)) "
        "AS is_boundary_month FROM monthly"
    ),
    # a month is an edge month when no month on its outer side, itself included, is full
    "marked": (
        "WITH t AS (SELECT quantile_cont(CAST(line_count AS DOUBLE), 0.5) AS med FROM monthly), "
        "n AS (SELECT *, row_number() OVER (ORDER BY commit_month NULLS FIRST) AS place FROM agg_delay_rate_monthly) "
        "SELECT m.* EXCLUDE (place), med AS median_line_count, "
        "NOT EXISTS (SELECT 1 FROM n x WHERE x.place <= m.place AND x.line_count >= 0.9 * med) OR "
        "NOT EXISTS (SELECT 1 FROM n x WHERE x.place >= m.place AND x.line_count >= 0.9 * med) "
        "AS is_edge_month FROM n m, t"
    ),
    "monitor_months": (
        "SELECT commit_month, line_count, late_line_count, delay_rate, is_boundary_month, median_line_count, "
        "is_edge_month, coalesce(is_boundary_month, false) OR is_edge_month AS is_incomplete, CASE WHEN is_boundary_month THEN 'boundary' "
        "WHEN is_edge_month THEN 'low count' END AS incomplete_reason FROM marked"
    ),
    "monitor_summary": (
        "SELECT a.*, s.*, lo.delay_rate AS lowest_rate, lo.commit_month AS lowest_rate_month, "
        "hi.delay_rate AS highest_rate, hi.commit_month AS highest_rate_month FROM "
        f"(SELECT {_COUNT} AS month_count, min(commit_month) AS first_month, max(commit_month) AS last_month, "
        "CAST(sum(late_line_count) AS DOUBLE) / CAST(sum(line_count) AS DOUBLE) AS overall_delay_rate, "
        "max(median_line_count) AS median_line_count FROM monitor_months) a, "
        f"(SELECT {_COUNT} AS stable_months, min(commit_month) AS stable_first_month, max(commit_month) AS "
        "stable_last_month, avg(delay_rate) AS mean_monthly_rate, min(line_count) AS min_lines, max(line_count) AS "
        "max_lines FROM monitor_months WHERE NOT is_incomplete) s, "
        "(SELECT * FROM monitor_months WHERE NOT is_incomplete ORDER BY delay_rate, commit_month NULLS FIRST LIMIT 1) lo, "
        "(SELECT * FROM monitor_months WHERE NOT is_incomplete ORDER BY delay_rate DESC, commit_month NULLS FIRST LIMIT 1) hi"
    ),
    "fastest": (
        "SELECT ship_mode, transit_p50_days, transit_mean_days, count(*) OVER () > 1 AS is_tied, "
        "row_number() OVER (ORDER BY transit_mean_days, ship_mode) = 1 AS has_lowest_mean "
        "FROM modes WHERE transit_p50_days = (SELECT min(transit_p50_days) FROM modes)"
    ),
    "predictable": (
        "SELECT ship_mode, transit_p90_minus_p50_days, transit_iqr_days, transit_stddev_days FROM modes "
        "ORDER BY transit_p90_minus_p50_days, transit_iqr_days, transit_stddev_days, ship_mode LIMIT 1"
    ),
    "worst": "SELECT ship_mode, line_count, late_line_count, delay_rate FROM modes ORDER BY delay_rate DESC, ship_mode LIMIT 1",
    "gap": "SELECT *, line_on_time_share - order_on_time_share AS share_gap FROM agg_on_time_summary",
}

_ANSWER_COLUMNS = ["order_count"] + [
    f"{g}_{s}_days" for g in ("complete", "transit", "order_to_ship") for s in ("p50", "p90", "mean")
]
RELATIONS["verdict"] = (
    "SELECT " + ", ".join(
        f"max(CASE WHEN is_urgent = {flag} THEN {c} END) AS {side}_{c}"
        for side, flag in (("urgent", "true"), ("other", "false")) for c in _ANSWER_COLUMNS
    ) + ", CASE WHEN max(CASE WHEN is_urgent THEN complete_p50_days END) < max(CASE WHEN NOT is_urgent THEN complete_p50_days END) "
    "THEN 'faster' WHEN max(CASE WHEN is_urgent THEN complete_p50_days END) > max(CASE WHEN NOT is_urgent THEN complete_p50_days END) "
    "THEN 'slower' WHEN max(CASE WHEN is_urgent THEN complete_p50_days END) = max(CASE WHEN NOT is_urgent THEN complete_p50_days END) "
    "THEN 'tie' END AS verdict FROM agg_urgency_fulfillment"
)


def _pc(x: str) -> str:
    return f"printf('%.2f%%', 100 * {x})"


def _mo(x: str) -> str:
    return f"coalesce(strftime({x}, '%Y-%m'), 'no month')"


def _dy(x: str) -> str:
    return f"printf('%.2f days', {x})"


def _figures(side: str) -> str:
    return f"'{side} n=' || {side}_order_count" + "".join(
        f" || ', {c[:-5]}=' || {_dy(f'{side}_{c}')}" for c in _ANSWER_COLUMNS[1:]
    )


RELATIONS["said"] = " UNION ALL ".join([
    "SELECT 'q1_fastest' AS topic, string_agg(ship_mode, ', ' ORDER BY ship_mode) || CASE WHEN count(*) > 1 THEN ' tie' "
    f"ELSE ' is fastest' END || ' at a median of ' || {_dy('max(transit_p50_days)')} || '; lowest mean: ' || "
    f"max(ship_mode) FILTER (WHERE has_lowest_mean) || ' with ' || {_dy('min(transit_mean_days)')} AS answer FROM fastest",
    f"SELECT 'q1_predictable', ship_mode || ' has the narrowest p90 - p50: ' || {_dy('transit_p90_minus_p50_days')} FROM predictable",
    f"SELECT 'q2', {_pc('order_on_time_share')} || ' of orders are fully on time, ' || {_pc('line_on_time_share')} || "
    f"' of lines, a gap of ' || {_pc('share_gap')} || '; orders have ' || lines_per_order_min || ' to ' || "
    "lines_per_order_max || ' lines, ' || printf('%.2f', lines_per_order_p50) || ' in the median and ' || "
    "printf('%.2f', lines_per_order_mean) || ' on average' FROM gap",
    f"SELECT 'q3', ship_mode || ' is late most often: ' || {_pc('delay_rate')} || ', ' || late_line_count || ' of ' || "
    "line_count || ' lines' FROM worst",
    f"SELECT 'q4', 'urgent orders: ' || verdict || '; ' || {_figures('urgent')} || '; ' || {_figures('other')} FROM verdict",
    f"SELECT 'monitoring', month_count || ' commit months from ' || {_mo('first_month')} || ' to ' || {_mo('last_month')} || "
    f"', overall delay rate ' || {_pc('overall_delay_rate')} || '; stable from ' || {_mo('stable_first_month')} || ' to ' || "
    f"{_mo('stable_last_month')} || ' between ' || {_pc('lowest_rate')} || ' (' || {_mo('lowest_rate_month')} || ') and ' || "
    f"{_pc('highest_rate')} || ' (' || {_mo('highest_rate_month')} || '), ' || stable_months || ' months with a mean rate of ' || "
    f"{_pc('mean_monthly_rate')} || ' and ' || min_lines || ' to ' || max_lines || ' lines each; median of all months: ' || "
    "printf('%.2f', median_line_count) || ' lines; incomplete: ' || incomplete || "
    "'. The rates of incomplete months cover a part of their lines and are no change of performance.' FROM monitor_summary, "
    f"(SELECT coalesce(string_agg({_mo('commit_month')} || ' (' || incomplete_reason || ', ' || line_count || ' lines, ' || "
    f"{_pc('delay_rate')} || ')', ', ' ORDER BY commit_month NULLS FIRST), '') AS incomplete FROM monitor_months WHERE is_incomplete) AS i",
])

# --- validation --------------------------------------------------------------------------------

# Gold and answers over the dirty fixture: the same statements on relations with a prefix of their own.
_DERIVED = tuple(r for r in RELATIONS if not r.startswith(("c_", "d_")))


def _dirty(sql: str) -> str:
    return re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join(_DERIVED)})\b", r"\1\2d_\3", sql)


RELATIONS |= {f"d_{r}": _dirty(RELATIONS[r]) for r in _DERIVED if f"d_{r}" not in RELATIONS}

# Primary and foreign keys, allowed values.
_LINE_KEY = ("l_orderkey", "l_linenumber")
_PK = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "supplier": ("s_suppkey",), "customer": ("c_custkey",),
    "brand": ("p_brand",), "part": ("p_partkey",), "partsupp": ("ps_partkey", "ps_suppkey"), "orders": ("o_orderkey",),
    "ship_date_status": ("l_shipdate",), "part_quantity_price": ("l_partkey", "l_quantity"), "lineitem": _LINE_KEY,
}
_FK = {
    "nation_region_fk": ("nation", ("n_regionkey",), "region"),
    "supplier_nation_fk": ("supplier", ("s_nationkey",), "nation"),
    "customer_nation_fk": ("customer", ("c_nationkey",), "nation"),
    "part_brand_fk": ("part", ("p_brand",), "brand"),
    "partsupp_part_fk": ("partsupp", ("ps_partkey",), "part"),
    "partsupp_supplier_fk": ("partsupp", ("ps_suppkey",), "supplier"),
    "orders_customer_fk": ("orders", ("o_custkey",), "customer"),
    "part_quantity_price_part_fk": ("part_quantity_price", ("l_partkey",), "part"),
    "lineitem_orders_fk": ("lineitem", ("l_orderkey",), "orders"),
    "lineitem_partsupp_fk": ("lineitem", ("l_partkey", "l_suppkey"), "partsupp"),
    "lineitem_ship_date_status_fk": ("lineitem", ("l_shipdate",), "ship_date_status"),
    "lineitem_part_quantity_price_fk": ("lineitem", ("l_partkey", "l_quantity"), "part_quantity_price"),
}
_ALLOWED = {
    "l_shipmode": "'AIR', 'FOB', 'MAIL', 'RAIL', 'REG AIR', 'SHIP', 'TRUCK'",
    "l_returnflag": "'A', 'N', 'R'",
    "l_linestatus": "'F', 'O'",
}


def _outside(column: str) -> str:
    return f"{column} IS NULL OR {column} NOT IN ({_ALLOWED[column]})"


def _rule_rows(p: str) -> dict[tuple[str, str], tuple[tuple[str, ...], str]]:
    """Key columns and violating rows of every rule but the counts between layers."""
    lines, orders = f"{p}_lineitem", f"{p}_orders"
    joined = f"{lines} JOIN {orders} ON o_orderkey = l_orderkey"
    key = ", ".join(_LINE_KEY)
    rows = {
        ("DQ-L1", "lineitem"): (_LINE_KEY, f"SELECT {key} FROM {joined} WHERE l_shipdate < o_orderdate"),
        ("DQ-L2", "lineitem"): (_LINE_KEY, f"SELECT {key} FROM {lines} WHERE l_receiptdate < l_shipdate"),
        ("DQ-L3", "lineitem"): (_LINE_KEY, f"SELECT {key} FROM {joined} WHERE l_commitdate < o_orderdate"),
        ("DQ-L4", "lineitem"): (
            _LINE_KEY,
            f"SELECT {key} FROM {lines} WHERE l_shipdate IS NULL OR l_commitdate IS NULL OR l_receiptdate IS NULL",
        ),
        ("DQ-L4", "orders"): (("o_orderkey",), f"SELECT o_orderkey FROM {orders} WHERE o_orderdate IS NULL"),
        ("DQ-L5", "lineitem"): (_LINE_KEY, f"SELECT {key} FROM {lines} WHERE {_outside('l_shipmode')}"),
        ("DQ-L6", "lineitem"): (_LINE_KEY, f"SELECT {key} FROM {lines} WHERE {_outside('l_returnflag')}"),
        ("DQ-L7", "ship_date_status"): (
            ("l_shipdate",), f"SELECT l_shipdate FROM {p}_ship_date_status WHERE {_outside('l_linestatus')}",
        ),
        ("DQ-L8", "lineitem"): (_LINE_KEY, f"SELECT {key} FROM {lines} ANTI JOIN {orders} ON o_orderkey = l_orderkey"),
        ("DQ-L9", "orders"): (
            ("o_orderkey",), f"SELECT o_orderkey FROM {orders} ANTI JOIN {lines} ON o_orderkey = l_orderkey",
        ),
    }
    for table, keys in _PK.items():
        cols = ", ".join(keys)
        missing = " OR ".join(f"{k} IS NULL" for k in keys)
        rows["DQ-G1", table] = (
            keys,
            f"SELECT {cols} FROM {p}_{table} WHERE {missing} UNION ALL "
            f"SELECT {cols} FROM {p}_{table} GROUP BY {cols} HAVING count(*) > 1",
        )
    for name, (child, columns, parent) in _FK.items():
        match = " AND ".join(f"c.{c} = p.{k}" for c, k in zip(columns, _PK[parent]))
        rows["DQ-G2", f"{child}.{name}"] = (
            columns,
            f"SELECT {', '.join(f'c.{c}' for c in columns)} FROM {p}_{child} c ANTI JOIN {p}_{parent} p ON {match}",
        )
    return rows


def _counted(rule: tuple[str, str], rows: str) -> str:
    return (
        f"SELECT '{rule[0]}' AS rule_id, 'staging' AS layer, '{rule[1]}' AS table_name, {_COUNT} AS violation_count "
        f"FROM ({rows})"
    )


def _recorded(rule: tuple[str, str], keys: tuple[str, ...], rows: str) -> str:
    order = ", ".join(f"{k} NULLS FIRST" for k in keys)
    text = f"concat_ws('|', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})"
    return (
        f"SELECT '{rule[0]}' AS rule_id, 'staging' AS layer, '{rule[1]}' AS table_name, "
        f"(SELECT {_COUNT} FROM ({rows})) AS violation_count, "
        f"(SELECT coalesce(CAST(to_json(list({text} ORDER BY {order})) AS VARCHAR), '[]') FROM "
        f"(SELECT * FROM ({rows}) ORDER BY {order} LIMIT 10)) AS sample_keys"
    )


def _records(p: str, *chosen: tuple[str, str]) -> str:
    rows = _rule_rows(p)
    return " UNION ALL ".join(_recorded(rule, *rows[rule]) for rule in (chosen or rows))


def _counts(p: str, *rule_ids: str) -> str:
    return " UNION ALL ".join(
        _counted(rule, rows) for rule, (_, rows) in _rule_rows(p).items() if not rule_ids or rule[0] in rule_ids
    )


def _layer_counts(names: tuple[str, ...], per_table: dict[str, tuple[str, ...]], rule: dict[str, str], layer: str) -> str:
    steps = " + ".join(f"abs({a} - {b})" for a, b in zip(names, names[1:]))
    shown = ", ".join(f"'{n}=' || {n}" for n in names)
    parts = [
        f"SELECT '{rule[t]}' AS rule_id, '{t}' AS table_name, "
        + ", ".join(f"(SELECT count(*) FROM {rel}) AS {n}" for n, rel in zip(names, rels))
        for t, rels in per_table.items()
    ]
    return (
        f"SELECT rule_id, '{layer}' AS layer, table_name, CAST({steps} AS BIGINT) AS violation_count, "
        f"CASE WHEN {steps} = 0 THEN '[]' ELSE CAST(to_json([{shown}]) AS VARCHAR) END AS sample_keys "
        f"FROM ({' UNION ALL '.join(parts)})"
    )



_LOADED = "TIMESTAMP '2026-10-07 16:43:01' AS _ingested_at, 'samples.{t}' AS _source_table"
RELATIONS |= {f"{p}_bronze_{t}": f"SELECT *, {_LOADED.format(t=t)} FROM {p}_{t}" for p in "cd" for t in _SOURCES}
RELATIONS |= {
    "d_bronze_orders": RELATIONS["d_bronze_orders"] + " WHERE o_orderkey % 97 <> 5",
    "d_bronze_part": RELATIONS["d_bronze_part"].replace("SELECT *", "SELECT * REPLACE (CAST(p_size AS VARCHAR) AS p_size)"),
    "d_bronze_nation": RELATIONS["d_bronze_nation"].replace("SELECT *", "SELECT n_name, * EXCLUDE (n_name)"),
    "d_bronze_region": "SELECT *, TIMESTAMP '2026-10-07 16:43:01' AS _ingested_at FROM d_region",
}
RELATIONS |= {f"a_{t}": f"SELECT {_STAGED[t]} FROM d_{t}" for t in _TABLES}
RELATIONS |= {
    "a_lineitem": RELATIONS["a_lineitem"] + " WHERE l_linenumber <> 3",
    "a_part": f"SELECT * REPLACE (CAST(p_size AS BIGINT) AS p_size) FROM (SELECT {_STAGED['part']} FROM d_part)",
    "a_modes": "SELECT * EXCLUDE (delay_rate) FROM d_agg_ship_mode_performance",
}


def _shape(relation: str, columns: str = "*") -> str:
    """Names, order and types of a relation's columns as one text."""
    return f"(SELECT CAST(to_json(s) AS VARCHAR) FROM (SELECT typeof(COLUMNS({columns})) FROM {relation} LIMIT 1) AS s)"


def _width(relation: str) -> str:
    own = "'^[^_].*'"
    return f"CAST((SELECT len(json_keys(to_json(s))) FROM (SELECT COLUMNS({own}) FROM {relation} LIMIT 1) AS s) AS INTEGER)"


def _rows(relation: str) -> str:
    return f"(SELECT {_COUNT} FROM {relation})"


def _bronze_report(p: str) -> str:
    own, added = "'^[^_].*'", "'^_.*'"
    parts = [
        f"SELECT '{t}' AS table_name, {_width(f'{p}_{t}')} AS source_columns, {_width(f'{p}_bronze_{t}')} AS bronze_columns, "
        f"{_shape(f'{p}_{t}')} = {_shape(f'{p}_bronze_{t}', own)} AS names_and_types_match, "
        f"(SELECT json_keys(to_json(s)) FROM (SELECT COLUMNS({added}) FROM {p}_bronze_{t} LIMIT 1) AS s) = ['_ingested_at', '_source_table'] "
        f"AS metadata_columns_present, {_rows(f'{p}_{t}')} AS source_rows, {_rows(f'{p}_bronze_{t}')} AS bronze_rows"
        for t in _SOURCES
    ]
    return (
        "SELECT *, source_rows = bronze_rows AS row_counts_match, names_and_types_match AND metadata_columns_present AND "
        f"source_rows = bronze_rows AS ok FROM ({' UNION ALL '.join(parts)})"
    )


def _staging_report(bronze: str, staging: str) -> str:
    parts = [
        f"SELECT '{t}' AS table_name, {_shape(f'{staging}_{t}', _chosen(t))} = {_shape('c_' + t, _chosen(t))} AS columns_match_contract, "
        f"{_rows(f'{bronze}_bronze_{t}') if t in _SOURCES else 'CAST(NULL AS BIGINT)'} AS bronze_rows, {_rows(f'{staging}_{t}')} AS staging_rows"
        for t in _TABLES
    ]
    return (
        "SELECT *, bronze_rows IS NULL OR bronze_rows = staging_rows AS row_counts_match, "
        "columns_match_contract AND (bronze_rows IS NULL OR bronze_rows = staging_rows) AS ok "
        f"FROM ({' UNION ALL '.join(parts)})"
    )


def _chosen(table: str) -> str:
    return "[" + ", ".join(f"'{c.strip()}'" for c in _STAGED[table].split(",")) + "]"


def _silver_report(staging: str, silver: str) -> str:
    parts = [f"SELECT '{t}' AS table_name, {_rows(f'{staging}_{t}')} AS staging_rows, {_rows(f'{silver}_{t}')} AS silver_rows" for t in _TABLES]
    return f"SELECT *, staging_rows = silver_rows AS ok FROM ({' UNION ALL '.join(parts)})"


def _gold_report(relations: dict[str, str], whole: dict[str, str]) -> str:
    def keys(relation: str) -> str:
        return f"(SELECT json_keys(to_json(s)) FROM (SELECT * FROM {relation} LIMIT 1) AS s)"

    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, {_rows(rel)} AS row_count, {keys(rel)} = {keys(whole[name])} AS columns_match_contract"
        for name, rel in relations.items()
    )


def _g3(p: str, staging: str) -> str:
    return _layer_counts(
        ("source", "bronze", "staging"), {t: (f"{p}_{t}", f"{p}_bronze_{t}", f"{staging}_{t}") for t in _SOURCES},
        dict.fromkeys(_SOURCES, "DQ-G3"), "staging",
    )


_COUNTED = "SELECT rule_id, layer, table_name, violation_count FROM"
RELATIONS["dirty_counts"] = f"{_counts('d')} UNION ALL {_COUNTED} ({_g3('d', 'd')})"
RELATIONS["clean_counts"] = f"{_counts('c')} UNION ALL {_COUNTED} ({_g3('c', 'c')})"


def _audited(report: str) -> str:
    return f"SELECT 'dirty' AS run_id, *, 'blocking' AS severity, violation_count = 0 AS passed FROM ({report})"


def _gate(counts: str) -> str:
    expected = [(rule, table) for rule, table in _rule_rows("c")] + [("DQ-G3", t) for t in _SOURCES]
    values = ", ".join(f"('{rule}', '{table}')" for rule, table in expected)
    return (
        "SELECT rule_id, table_name, CASE WHEN n IS NULL THEN 'missing' WHEN n = 0 THEN 'passed' ELSE 'failed' END AS verdict, "
        f"n AS violations FROM (VALUES {values}) AS e(rule_id, table_name) FULL JOIN "
        f"(SELECT rule_id, table_name, CAST(sum(violation_count) AS BIGINT) AS n FROM {counts} GROUP BY rule_id, table_name) "
        "USING (rule_id, table_name)"
    )


# Columns that may not be NULL.
_REQUIRED = {
    t: keys + {
        "orders": ("o_orderdate",), "ship_date_status": ("l_linestatus",),
        "lineitem": ("l_shipdate", "l_commitdate", "l_receiptdate", "l_shipmode", "l_returnflag"),
    }.get(t, ())
    for t, keys in _PK.items()
}


def _enforced(p: str) -> str:
    parts = [
        f"SELECT '{t}' AS table_name, '{c} NOT NULL' AS \"constraint\", {_count_if(f'{c} IS NULL')} AS violations FROM {p}_{t}"
        for t, columns in _REQUIRED.items() for c in columns
    ]
    parts.append(
        "SELECT 'lineitem', 'lineitem_receipt_after_ship', "
        f"{_count_if('NOT coalesce(l_receiptdate >= l_shipdate, false)')} FROM {p}_lineitem"
    )
    return " UNION ALL ".join(parts)


# --- profile and differences -------------------------------------------------------------------


def _values(table: str, columns: tuple[str, ...]) -> str:
    stacked = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value FROM {table}" for c in columns)
    return (
        f"SELECT column_name, '[' || value || ']' AS bracketed_value, CAST(length(value) AS INTEGER) AS value_length, "
        f"{_COUNT} AS row_count FROM ({stacked}) GROUP BY column_name, value"
    )


def _dates(p: str) -> str:
    columns = [(c, "lineitem") for c in ("l_shipdate", "l_commitdate", "l_receiptdate")] + [("o_orderdate", "orders")]
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, min({c}) AS min_date, max({c}) AS max_date, {_count_if(f'{c} IS NULL')} AS null_count "
        f"FROM {p}_{t}" for c, t in columns
    )


def _sizes(p: str) -> str:
    return (
        f"SELECT {_COUNT} AS order_count, {_count_if('n = 0')} AS orders_without_lines, min(n) AS lines_min, "
        f"{_pct('n', 0.5)} AS lines_median, CAST(avg(n) AS DOUBLE) AS lines_mean, max(n) AS lines_max FROM "
        f"(SELECT o_orderkey, coalesce(any_value(c), 0) AS n FROM {p}_orders LEFT JOIN (SELECT l_orderkey, {_COUNT} AS c "
        f"FROM {p}_lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY o_orderkey)"
    )


def _keys(p: str) -> str:
    tested = [(t, _PK[t], "primary key") for t in _SOURCES]
    tested += [
        (t, (c,), "alternative candidate")
        for t, c in (("region", "r_name"), ("nation", "n_name"), ("supplier", "s_name"), ("customer", "c_name"), ("part", "p_name"))
    ]
    parts = []
    for table, columns, kind in tested:
        missing = " OR ".join(f"{c} IS NULL" for c in columns)
        parts.append(
            f"SELECT '{table}' AS table_name, '{', '.join(columns)}' AS key_columns, '{kind}' AS kind, "
            f"{_COUNT} AS row_count, CAST(count(DISTINCT ({', '.join(columns)})) FILTER (WHERE NOT ({missing})) AS BIGINT) "
            f"AS distinct_keys, {_count_if(missing)} AS rows_with_null_key FROM {p}_{table}"
        )
    return (
        "SELECT *, row_count = distinct_keys AND rows_with_null_key = 0 AS is_key FROM (" + " UNION ALL ".join(parts) + ")"
    )


def _fds(p: str) -> str:
    tested = (
        ("part", "p_brand", "p_mfgr"), ("lineitem", "l_shipdate", "l_linestatus"),
        ("lineitem", "l_receiptdate", "l_returnflag"), ("lineitem", "l_partkey, l_quantity", "l_extendedprice"),
        ("customer", "c_nationkey", "substring(c_phone, 1, 2)"), ("supplier", "s_nationkey", "substring(s_phone, 1, 2)"),
    )
    parts = [
        f"SELECT '{t}' AS table_name, '{x}' AS determinant, '{a}' AS dependent, {_COUNT} AS determinant_values, "
        f"{_count_if('k > 1')} AS violating_groups FROM (SELECT {x}, count(DISTINCT {a}) AS k FROM {p}_{t} GROUP BY {x})"
        for t, x, a in tested
    ]
    return "SELECT *, violating_groups = 0 AS holds_in_data FROM (" + " UNION ALL ".join(parts) + ")"


def _documented(p: str) -> str:
    phones = " UNION ALL ".join(
        f"SELECT 'phone of a {t} starts with its nation', "
        f"{_count_if(f'{x}_phone IS NOT NULL AND coalesce(TRY_CAST(substring({x}_phone, 1, 2) AS INTEGER) <> {x}_nationkey + 10, true)')} FROM {p}_{t}"
        for x, t in (("c", "customer"), ("s", "supplier"))
    )
    return (
        "SELECT 'brand names its manufacturer' AS rule, "
        f"{_count_if('substring(p_brand, 7, 1) <> substring(p_mfgr, 14)')} AS rows_breaking_rule FROM {p}_part UNION ALL "
        "SELECT 'line price is quantity times retail price', "
        f"{_count_if('l_extendedprice <> l_quantity * p_retailprice')} FROM {p}_lineitem JOIN {p}_part ON p_partkey = l_partkey "
        f"UNION ALL {phones}"
    )


def _cutoffs(p: str) -> str:
    return (
        "SELECT max(l_shipdate) FILTER (WHERE l_linestatus = 'F') AS latest_f_shipdate, "
        "min(l_shipdate) FILTER (WHERE l_linestatus = 'O') AS earliest_o_shipdate, "
        "max(l_receiptdate) FILTER (WHERE l_returnflag IN ('A', 'R')) AS latest_a_or_r_receiptdate, "
        f"min(l_receiptdate) FILTER (WHERE l_returnflag = 'N') AS earliest_n_receiptdate FROM {p}_lineitem"
    )


def _diff(left: str, right: str, table: str = "") -> str:
    label = f"'{table}' AS table_name, " if table else ""
    return (
        f"SELECT {label}a AS left_only, b AS right_only, a = 0 AND b = 0 AS unchanged FROM "
        f"(SELECT {_COUNT} AS a FROM (SELECT * FROM ({left}) EXCEPT ALL SELECT * FROM ({right}))), "
        f"(SELECT {_COUNT} AS b FROM (SELECT * FROM ({right}) EXCEPT ALL SELECT * FROM ({left})))"
    )


def _stage(table: str, p: str = "c") -> str:
    return f"SELECT {_STAGED[table]} FROM {p}_{table}"


RELATIONS["first_line"] = "SELECT l_orderkey AS k, l_linenumber AS n FROM c_lineitem ORDER BY 1, 2 LIMIT 1"
_INJECTED = "SELECT {columns} FROM c_lineitem, first_line f".format(
    columns=_STAGED["lineitem"].replace(
        "l_receiptdate",
        "CASE WHEN l_orderkey = f.k AND l_linenumber = f.n THEN l_shipdate - 1 ELSE l_receiptdate END AS l_receiptdate",
    )
)
def _histogram(measure: str, fact: str, value: str, late: str, on_time: str, *groups: str) -> str:
    """Rows per value of one measure; columns of other measures are NULL."""
    kinds = {"ship_mode": "VARCHAR", "order_priority": "VARCHAR", "is_urgent": "BOOLEAN", "commit_month": "DATE"}
    columns = ", ".join(f"{c if c in groups else f'CAST(NULL AS {kind})'} AS {c}" for c, kind in kinds.items())
    return (
        f"SELECT '{measure}' AS measure, {columns}, CAST({value} AS BIGINT) AS value, {_COUNT} AS n, "
        f"CAST({late} AS BIGINT) AS late, CAST({on_time} AS BIGINT) AS on_time FROM {fact} GROUP BY ALL"
    )


def _histograms() -> str:
    lines = ("count(*) FILTER (WHERE is_late)", "count(*) FILTER (WHERE NOT is_late)")
    orders = ("sum(late_line_count)", "count(*) FILTER (WHERE is_fully_on_time)")
    some = "(SELECT * FROM fct_order WHERE line_count >= 1)"
    return " UNION ALL ".join((
        _histogram("ship_transit", "fct_line", "transit_days", *lines, "ship_mode"),
        _histogram("priority_transit", "fct_line", "transit_days", *lines, "order_priority", "is_urgent"),
        _histogram("priority_wait", "fct_line", "order_to_ship_days", *lines, "order_priority", "is_urgent"),
        _histogram("commit", "fct_line", "NULL", *lines, "commit_month"),
        _histogram("order_size", some, "line_count", *orders),
        _histogram("priority_complete", some, "order_to_complete_days", *orders, "order_priority", "is_urgent"),
    ))


def _price_percentiles(p: str) -> str:
    rows = f"(SELECT l_shipmode, CAST(l_extendedprice AS DOUBLE) AS v FROM {p}_lineitem)"
    return " UNION ALL ".join(
        f"SELECT l_shipmode, CAST({share} AS DOUBLE) AS share, {_COUNT} AS n, quantile_cont(v, {share}) AS value FROM {rows} WHERE v IS NOT NULL GROUP BY l_shipmode"
        for share in (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    )


RELATIONS["ledger"] = (
    "SELECT 'run-' || user_id AS run_id, CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'succeeded' "
    "ELSE event_type END AS event, ts AS event_ts FROM events"
)
RELATIONS["runs"] = (
    "SELECT run_id, array_to_string(list_sort(list(DISTINCT event)), ',') AS kinds, "
    "min(event_ts) FILTER (WHERE event = 'started') AS first_start, "
    "max(event_ts) FILTER (WHERE event = 'succeeded') AS last_success FROM ledger GROUP BY run_id"
)

# --- the queries -------------------------------------------------------------------------------

_GOLD_NAMES = {"fct_lineitem_delivery": "fct_line", "fct_order_fulfillment": "fct_order"} | {
    t: t for t in RELATIONS if t.startswith("agg_")
}


def _body() -> dict[str, str]:
    modes = "agg_ship_mode_performance"
    bodies = {name: f"SELECT * FROM {rel}" for name, rel in _GOLD_NAMES.items()}
    dirty_names = {name: _dirty(f"FROM {rel}").removeprefix("FROM ") for name, rel in _GOLD_NAMES.items()}
    bodies["delivery_histograms"] = _histograms()
    bodies["delivery_histograms_dirty"] = _dirty(_histograms())
    bodies["price_percentiles"], bodies["price_percentiles_dirty"] = _price_percentiles("c"), _price_percentiles("d")
    bodies["gold_report"] = _gold_report(_GOLD_NAMES, _GOLD_NAMES)
    bodies["gold_report_dirty"] = _gold_report(dirty_names | {"agg_ship_mode_performance": "a_modes"}, dirty_names)
    bodies |= {
        "q1_ship_mode": f"SELECT * EXCLUDE (late_line_count, delay_rate) FROM {modes} ORDER BY ship_mode",
        "q1_fastest": "SELECT * FROM fastest",
        "q1_most_predictable": "SELECT * FROM predictable",
        "q2_gap": "SELECT * FROM gap",
        "q2_by_size": "SELECT * FROM agg_on_time_by_line_count ORDER BY lines_in_order",
        "q3_delay_rate": f"SELECT ship_mode, line_count, late_line_count, delay_rate FROM {modes} ORDER BY delay_rate DESC, ship_mode",
        "q3_worst": "SELECT * FROM worst",
        "q4_urgency": "SELECT * FROM agg_urgency_fulfillment ORDER BY is_urgent DESC",
        "q4_priority": "SELECT * FROM agg_priority_fulfillment ORDER BY order_priority",
        "q4_verdict": "SELECT * FROM verdict",
        "monitor_months": "SELECT * FROM monitor_months ORDER BY commit_month",
        "monitor_summary": "SELECT * FROM monitor_summary",
        "answers_text": "SELECT * FROM said",
        "bronze_ingest": (
            "SELECT *, TIMESTAMP '2026-10-07 16:43:01' AS _ingested_at, 'samples.orders' AS _source_table FROM c_orders"
        ),
        "inject_bad_row": _INJECTED,
        "enforced_constraints": _enforced("d"),
    }
    bodies |= {f"stage_{t}": _stage(t) for t in _TABLES}
    bodies |= {f"bronze_ingest_{t}": f"SELECT *, {_LOADED.format(t=t)} FROM c_{t}" for t in _SOURCES if t != "orders"}
    bodies |= {
        "bronze_report": _bronze_report("c"), "bronze_report_dirty": _bronze_report("d"),
        "staging_report": _staging_report("c", "c"), "staging_report_dirty": _staging_report("d", "a"),
        "silver_report": _silver_report("c", "c"), "silver_report_dirty": _silver_report("d", "a"),
    }
    for i in (1, 2, 3, 5, 6, 8):
        bodies[f"dq_l{i}_dirty"] = _records("d", (f"DQ-L{i}", "lineitem"))
    bodies |= {
        "dq_l4_dirty": _records("d", ("DQ-L4", "lineitem"), ("DQ-L4", "orders")),
        "dq_l7_dirty": _records("d", ("DQ-L7", "ship_date_status")),
        "dq_l9_dirty": _records("d", ("DQ-L9", "orders")),
        "dq_g1_dirty": _records("d", *(r for r in _rule_rows("d") if r[0] == "DQ-G1")),
        "dq_g2_dirty": _records("d", *(r for r in _rule_rows("d") if r[0] == "DQ-G2")),
        "dq_g3": _g3("d", "c"),
        "dq_gold": _layer_counts(
            ("silver", "gold"),
            {"fct_lineitem_delivery": ("d_lineitem", "d_fct_line"), "fct_order_fulfillment": ("d_orders", "d_fct_order")},
            {"fct_lineitem_delivery": "DQ-GOLD1", "fct_order_fulfillment": "DQ-GOLD2"}, "gold",
        ),
        "dq_samples_dirty": _records(
            "d", ("DQ-G1", "lineitem"), ("DQ-G1", "brand"), ("DQ-G1", "part_quantity_price"),
            ("DQ-G2", "part.part_brand_fk"), ("DQ-G2", "lineitem.lineitem_partsupp_fk"),
        ),
        "dq_report_dirty": f"{_records('d')} UNION ALL {_g3('d', 'd')}",
        "dq_report_clean": f"{_records('c')} UNION ALL {_g3('c', 'c')}",
        "dq_gate": _gate("dirty_counts"),
        "dq_gate_clean": _gate("clean_counts"),
        "audit_for_run": _audited(_records("d", *(r for r in _rule_rows("d") if r[0] in ("DQ-L2", "DQ-G1")))),
        "audit_latest": _audited(f"{_records('d')} UNION ALL {_g3('d', 'd')}"),
        "audit_run_ids": (
            "SELECT DISTINCT run_id FROM (SELECT 'dirty' AS run_id FROM dirty_counts UNION ALL SELECT 'clean' FROM clean_counts)"
        ),
    }
    for suffix, p in (("", "c"), ("_dirty", "d")):
        bodies |= {
            f"profile_values{suffix}": _values(f"{p}_lineitem", ("l_shipmode", "l_returnflag", "l_linestatus")),
            f"profile_priority{suffix}": _values(f"{p}_orders", ("o_orderpriority",)),
            f"profile_date_ranges{suffix}": _dates(p),
            f"profile_lines_per_order{suffix}": _sizes(p),
            f"profile_keys{suffix}": _keys(p),
            f"profile_fds{suffix}": _fds(p),
            f"profile_constant{suffix}": (
                "SELECT CAST(count(DISTINCT o_shippriority) AS BIGINT) AS distinct_values, min(o_shippriority) AS min_value, "
                f"max(o_shippriority) AS max_value FROM {p}_orders"
            ),
            f"profile_documented_rules{suffix}": _documented(p),
            f"profile_cutoffs{suffix}": _cutoffs(p),
        }
    bodies |= {
        "bag_diff": _diff(_stage("lineitem"), _INJECTED),
        "bag_diff_fixtures": _diff(_stage("part", "d"), _stage("part")),
        "layer_diff": " UNION ALL ".join(_diff(_stage(t), _stage(t, "d"), t) for t in _TABLES),
        "ledger_states": "SELECT * FROM runs",
        "ledger_latest": (
            "SELECT n.run_id, n.event_ts AS newest_start, last_success FROM "
            "(SELECT * FROM ledger WHERE event = 'started' ORDER BY event_ts DESC, run_id LIMIT 1) n JOIN runs USING (run_id)"
        ),
        "ledger_last_events": "SELECT run_id, event, event_ts FROM ledger ORDER BY event_ts DESC, run_id LIMIT 2",
    }
    answers = [name for name in bodies if name in _GOLD_NAMES or name.startswith(("q1_", "q2_", "q3_", "q4_", "monitor_")) or name == "answers_text"]
    bodies |= {f"{name}_dirty": _dirty(bodies[name]) for name in answers}
    return bodies


def _needed(text: str) -> list[str]:
    """Relations a text uses, each after those it is built on itself."""
    found: list[str] = []

    def visit(sql: str) -> None:
        for name in RELATIONS:
            if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s+{name}\s+[a-z]\b", sql):
                visit(RELATIONS[name])
                if name not in found:
                    found.append(name)

    visit(text)
    return found


_MONEY = {
    "supplier": "s_acctbal", "customer": "c_acctbal", "part": "p_retailprice", "partsupp": "ps_supplycost",
    "orders": "o_totalprice", "part_quantity_price": "l_quantity l_extendedprice", "lineitem": "l_quantity l_discount l_tax",
}
# Columns shown as doubles with six digits: engines differ in the last bits of sums and roots.
_DOUBLE_COLUMNS = {
    "agg_ship_mode_performance": "transit_p50_days transit_p90_days transit_p90_minus_p50_days transit_iqr_days transit_mean_days transit_stddev_days delay_rate",
    "agg_on_time_summary": "order_on_time_share line_on_time_share lines_per_order_p50 lines_per_order_mean",
    "agg_on_time_by_line_count": "order_on_time_share line_on_time_share",
    "agg_priority_fulfillment": " ".join(_ANSWER_COLUMNS[1:]),
    "agg_urgency_fulfillment": " ".join(_ANSWER_COLUMNS[1:]),
    "agg_delay_rate_monthly": "delay_rate",
    "q1_ship_mode": "transit_p50_days transit_p90_days transit_p90_minus_p50_days transit_iqr_days transit_mean_days transit_stddev_days",
    "q1_fastest": "transit_p50_days transit_mean_days",
    "q1_most_predictable": "transit_p90_minus_p50_days transit_iqr_days transit_stddev_days",
    "q2_gap": "order_on_time_share line_on_time_share lines_per_order_p50 lines_per_order_mean share_gap",
    "q2_by_size": "order_on_time_share line_on_time_share",
    "q3_delay_rate": "delay_rate",
    "q3_worst": "delay_rate",
    "q4_urgency": " ".join(_ANSWER_COLUMNS[1:]),
    "q4_priority": " ".join(_ANSWER_COLUMNS[1:]),
    "q4_verdict": " ".join(f"{side}_{c}" for side in ("urgent", "other") for c in _ANSWER_COLUMNS[1:]),
    "monitor_months": "delay_rate median_line_count",
    "monitor_summary": "overall_delay_rate median_line_count mean_monthly_rate lowest_rate highest_rate",
    **{f"stage_{t}": columns for t, columns in _MONEY.items()},
    "bronze_ingest": _MONEY["orders"],
    **{f"bronze_ingest_{t}": columns for t, columns in _MONEY.items() if t in _SOURCES and t not in ("orders", "lineitem")},
    "bronze_ingest_lineitem": "l_quantity l_extendedprice l_discount l_tax",
    "inject_bad_row": _MONEY["lineitem"],
    "price_percentiles": "value",
    "profile_lines_per_order": "lines_median lines_mean",
    "profile_lines_per_order_dirty": "lines_median lines_mean",
}


def oracle_sql() -> dict[str, str]:
    """Complete statements: the relations a query needs, then the query, doubles to six digits."""
    statements = {}
    for name, body in _body().items():
        needed = ", ".join(f"{r} AS ({RELATIONS[r]})" for r in _needed(body))
        doubles = _DOUBLE_COLUMNS.get(name, _DOUBLE_COLUMNS.get(name.removesuffix("_dirty"), "")).split()
        if doubles:
            replaced = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in doubles)
            body = f"SELECT * REPLACE ({replaced}) FROM ({body})"
        statements[name] = f"WITH {needed} {body}" if needed else body
    return statements

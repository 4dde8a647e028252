"""Profile of the source: values, dates, order sizes, keys, dependencies and documented rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import SILVER
from ..config import SOURCE_TABLES
from ..functions.frames import union_all
from ..functions.measures import percentiles, weighted_mean
from ..functions.predicates import any_null
from .keysets import is_integral, is_missing, words_of

# Columns tested as keys besides the primary keys, and dependencies worth a test.
ALTERNATIVE_KEYS = {
    "region": ("r_name",),
    "nation": ("n_name",),
    "supplier": ("s_name",),
    "customer": ("c_name",),
    "part": ("p_name",),
}
DEPENDENCIES = (
    ("part", ("p_brand",), "p_mfgr"),
    ("lineitem", ("l_shipdate",), "l_linestatus"),
    ("lineitem", ("l_receiptdate",), "l_returnflag"),
    ("lineitem", ("l_partkey", "l_quantity"), "l_extendedprice"),
    ("customer", ("c_nationkey",), "substring(c_phone, 1, 2)"),
    ("supplier", ("s_nationkey",), "substring(s_phone, 1, 2)"),
)
DATE_COLUMNS = {"lineitem": ("l_shipdate", "l_commitdate", "l_receiptdate"), "orders": ("o_orderdate",)}
CATEGORIES = ("l_shipmode", "l_returnflag", "l_linestatus")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value of every column, in one scan; brackets and length show stray blanks."""
    return (
        df.select(*columns).unpivot([], list(columns), "column_name", "value")
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(
            "column_name",
            F.concat(F.lit("["), F.col("value"), F.lit("]")).alias("bracketed_value"),
            F.length("value").alias("value_length"),
            "row_count",
        )
        .orderBy("column_name", "bracketed_value")
    )


def date_ranges(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]] = DATE_COLUMNS) -> DataFrame:
    """First and last date and NULLs of each date column, one scan per table."""

    def of_table(df: DataFrame, names: Sequence[str]) -> DataFrame:
        found = df.agg(*[
            F.struct(
                F.lit(c).alias("column_name"), F.min(c).alias("min_date"), F.max(c).alias("max_date"),
                F.count_if(F.col(c).isNull()).alias("null_count"),
            ).alias(c)
            for c in names
        ])
        return found.select(F.inline(F.array(*names)))

    return union_all(of_table(tables[t], names) for t, names in columns.items())


def lines_per_order(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Distribution of order sizes; an order without lines counts as 0."""
    rollup = lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    sized = orders.select("o_orderkey").join(rollup, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    sizes = sized.groupBy(F.coalesce("lines", F.lit(0)).alias("line_count")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("order_count"),
        F.coalesce(F.sum(F.when(F.col("line_count") == 0, F.col("n"))), F.lit(0)).alias("orders_without_lines"),
        F.min("line_count").alias("lines_min"),
        percentiles("line_count", (0.5,), "n")[0].alias("lines_median"),
        weighted_mean("line_count", "n").alias("lines_mean"),
        F.max("line_count").alias("lines_max"),
    )


def key_check(table: str, df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """Do the columns identify a row? Distinct keys leave out those with a NULL part.

    Keys whose last column is a whole number are counted as bits of words, others one by one.
    """
    if is_integral(df, columns[-1:]):
        groups, missing, keys = words_of(df, columns), is_missing(columns), F.bit_count("bits").cast("long")
    else:
        groups, missing, keys = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")), any_null(columns), F.lit(1)
    totals = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(~missing, keys)), F.lit(0)).cast("long").alias("distinct_keys"),
        F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("rows_with_null_key"),
    )
    return totals.select(
        F.lit(table).alias("table_name"), F.lit(", ".join(columns)).alias("key_columns"), F.lit(kind).alias("kind"),
        "row_count", "distinct_keys", "rows_with_null_key",
        ((F.col("row_count") == F.col("distinct_keys")) & (F.col("rows_with_null_key") == 0)).alias("is_key"),
    )


def key_checks(tables: Mapping[str, DataFrame]) -> DataFrame:
    primary = [key_check(t, tables[t], SILVER[t].primary_key, "primary key") for t in SOURCE_TABLES]
    others = [key_check(t, tables[t], c, "alternative candidate") for t, c in ALTERNATIVE_KEYS.items()]
    return union_all(primary + others)


def fd_check(table: str, df: DataFrame, determinant: Sequence[str], dependent: str) -> DataFrame:
    """Does ``determinant -> dependent`` hold? NULL dependents are no second value.

    A group has two values exactly when its smallest and largest differ, which takes one shuffle
    with a constant-size buffer. Text has no in-place minimum, so text dependents are made distinct
    first and then counted.
    """
    pairs = df.select(*determinant, F.expr(dependent).alias("dependent"))
    if isinstance(pairs.schema["dependent"].dataType, (T.StringType, T.BinaryType)):
        groups = pairs.distinct().groupBy(*determinant).agg((F.count("dependent") > 1).alias("broken"))
    else:
        groups = pairs.groupBy(*determinant).agg((F.min("dependent") < F.max("dependent")).alias("broken"))
    totals = groups.agg(F.count(F.lit(1)).alias("determinant_values"), F.count_if("broken").alias("violating_groups"))
    return totals.select(
        F.lit(table).alias("table_name"), F.lit(", ".join(determinant)).alias("determinant"),
        F.lit(dependent).alias("dependent"), "determinant_values", "violating_groups",
        (F.col("violating_groups") == 0).alias("holds_in_data"),
    )


def fd_checks(tables: Mapping[str, DataFrame]) -> DataFrame:
    return union_all(fd_check(t, tables[t], x, a) for t, x, a in DEPENDENCIES)


def constant_check(df: DataFrame, column: str) -> DataFrame:
    """A constant column is a dependency with nothing on its left side."""
    return df.agg(
        F.count_distinct(column).alias("distinct_values"),
        F.min(column).alias("min_value"),
        F.max(column).alias("max_value"),
    )


def documented_rules(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows that break the documented generation rules."""

    def breaking(rule: str, df: DataFrame, broken) -> DataFrame:
        return df.agg(F.count_if(broken).alias("rows_breaking_rule")).select(
            F.lit(rule).alias("rule"), "rows_breaking_rule"
        )

    def wrong_code(phone: str, nation: str):
        # a code that is no number breaks the rule as well
        differs = F.substring(phone, 1, 2).try_cast("int") != F.col(nation) + 10
        return F.col(phone).isNotNull() & F.coalesce(differs, F.lit(True))

    # equal lines are counted in the tasks, so a part with very many of them is a few rows in the join
    lines = tables["lineitem"].groupBy("l_partkey", "l_quantity", "l_extendedprice").agg(F.count(F.lit(1)).alias("n"))
    priced = lines.join(tables["part"].select("p_partkey", "p_retailprice"), F.col("p_partkey") == F.col("l_partkey"))
    wrong_price = F.col("l_extendedprice") != F.col("l_quantity") * F.col("p_retailprice")
    return union_all([
        breaking(
            "brand names its manufacturer", tables["part"],
            F.substring("p_brand", 7, 1) != F.expr("substring(p_mfgr, 14)"),
        ),
        priced.agg(F.coalesce(F.sum(F.when(wrong_price, F.col("n"))), F.lit(0)).alias("rows_breaking_rule")).select(
            F.lit("line price is quantity times retail price").alias("rule"), "rows_breaking_rule"
        ),
        breaking("phone of a customer starts with its nation", tables["customer"], wrong_code("c_phone", "c_nationkey")),
        breaking("phone of a supplier starts with its nation", tables["supplier"], wrong_code("s_phone", "s_nationkey")),
    ])


def snapshot_cutoffs(lineitem: DataFrame) -> DataFrame:
    """The dates at which line status and return flag change over."""
    status, flag = F.col("l_linestatus"), F.col("l_returnflag")
    ship, receipt = F.col("l_shipdate"), F.col("l_receiptdate")
    return lineitem.agg(
        F.max(F.when(status == "F", ship)).alias("latest_f_shipdate"),
        F.min(F.when(status == "O", ship)).alias("earliest_o_shipdate"),
        F.max(F.when(flag.isin("A", "R"), receipt)).alias("latest_a_or_r_receiptdate"),
        F.min(F.when(flag == "N", receipt)).alias("earliest_n_receiptdate"),
    )

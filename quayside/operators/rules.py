"""The blocking data-quality rules.

Rules that read the same rows share one ``RuleFrame``, so one pass counts them all. Sample keys
need a second look at the rows and are taken only for rules that failed.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LINE_STATUSES, RETURN_FLAGS, SHIP_MODES, SOURCE_TABLES
from ..contracts import FOREIGN_KEYS, SILVER, ForeignKey
from ..functions.frames import fold, row_counts, union_all, written
from ..functions.predicates import any_null, outside_allowed
from .keysets import MOST_WORDS, is_integral, rows_of_words, suspect_words

MAX_SAMPLE_KEYS = 10
CHECKED_LAYERS = ("source", "bronze", "staging", "gold")
COUNTED_LAYERS = ("source", "bronze", "staging")
LINE_KEY = ("l_orderkey", "l_linenumber")
REPORT_COLUMNS = ("rule_id", "layer", "table_name", "violation_count", "sample_keys")


@dataclass(frozen=True)
class Rule:
    """``weight`` is the number of violations a violating row stands for."""

    rule_id: str
    table_name: str
    violated: Column
    keys: tuple[str, ...]
    weight: Column = field(default_factory=lambda: F.lit(1))
    layer: str = "staging"

    def __post_init__(self):
        if self.layer not in CHECKED_LAYERS:
            raise ValueError(f"layer must be one of {CHECKED_LAYERS}, got {self.layer!r}")

    @property
    def name(self) -> tuple[str, str]:
        return (self.rule_id, self.table_name)


@dataclass(frozen=True)
class RuleFrame:
    """Rows and the rules that read them; the rules of a frame share their key columns.

    ``derived`` rows take a join or a grouping of whole tables to make.
    """

    rows: DataFrame
    rules: tuple[Rule, ...]
    derived: bool = False


# --- the rules ---------------------------------------------------------------------------------


def line_rules(lineitem: DataFrame) -> RuleFrame:
    """DQ-L2, L4, L5, L6: what a line shows by itself, in one scan."""
    return RuleFrame(lineitem, (
        Rule("DQ-L2", "lineitem", F.col("l_receiptdate") < F.col("l_shipdate"), LINE_KEY),
        Rule("DQ-L4", "lineitem", any_null(("l_shipdate", "l_commitdate", "l_receiptdate")), LINE_KEY),
        Rule("DQ-L5", "lineitem", outside_allowed("l_shipmode", SHIP_MODES), LINE_KEY),
        Rule("DQ-L6", "lineitem", outside_allowed("l_returnflag", RETURN_FLAGS), LINE_KEY),
    ))


def line_order_rules(lineitem: DataFrame, orders: DataFrame) -> RuleFrame:
    """DQ-L1, L3 and L8, from one join.

    Orders are first counted per key and date. A repeated order then meets each of its lines once,
    with its count as weight, instead of multiplying them. The line side is never regrouped: it
    stays the splittable side of a left join, so adaptive execution can cut up a hot order key.
    """
    dated = orders.groupBy("o_orderkey", "o_orderdate").agg(F.count(F.lit(1)).alias("copies"))
    lines = lineitem.select(*LINE_KEY, "l_shipdate", "l_commitdate")
    joined = lines.join(dated, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return RuleFrame(joined, (
        Rule("DQ-L1", "lineitem", F.col("l_shipdate") < F.col("o_orderdate"), LINE_KEY, F.col("copies")),
        Rule("DQ-L3", "lineitem", F.col("l_commitdate") < F.col("o_orderdate"), LINE_KEY, F.col("copies")),
        Rule("DQ-L8", "lineitem", F.col("o_orderkey").isNull(), LINE_KEY),
    ), derived=True)


def order_rules(orders: DataFrame) -> RuleFrame:
    """DQ-L4 on orders."""
    return RuleFrame(orders, (Rule("DQ-L4", "orders", F.col("o_orderdate").isNull(), ("o_orderkey",)),))


def status_rules(ship_date_status: DataFrame) -> RuleFrame:
    """DQ-L7; every status a line has is in this table."""
    allowed = outside_allowed("l_linestatus", LINE_STATUSES)
    return RuleFrame(ship_date_status, (Rule("DQ-L7", "ship_date_status", allowed, ("l_shipdate",)),))


def _references(table: str, tables: Mapping[str, DataFrame]) -> list[ForeignKey]:
    return [fk for fk in FOREIGN_KEYS if fk.parent == table and fk.child in tables]


def _named_by_lines(fk: ForeignKey) -> bool:
    return (fk.child, fk.parent) == ("lineitem", "orders")


def _stacked_keys(table: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The primary key's columns of a table and of all rows that refer to it; one more column each says whose row it is."""
    keys = SILVER[table].primary_key
    parts = [tables[table].select(*keys, F.lit(1).alias("owned"))]
    parts += [
        tables[fk.child].select(*[F.col(c).alias(k) for c, k in zip(fk.child_columns, keys)], F.lit(1).alias(fk.name))
        for fk in _references(table, tables)
    ]
    return union_all(parts, fill=True)


def suspect_keys(tables: Mapping[str, DataFrame]) -> dict[str, list[list[int | None]] | None]:
    """For every table with a key of whole numbers the words of keys that a rule may count, None for very many.

    Runs at once, in one job: words of 64 keys are all that is shuffled. Keys of several columns are None at once:
    only values of their last column share a word, so words are about as many as keys, and a first pass would
    shuffle as much as the counting does.
    """
    found: dict[str, list[list[int | None]] | None] = {}
    parts = []
    for table in SILVER:
        keys, stacked = SILVER[table].primary_key, _stacked_keys(table, tables)
        if is_integral(stacked, keys) and len(keys) > 1:
            found[table] = None
        elif is_integral(stacked, keys):
            found[table] = []
            references = _references(table, tables)
            words = suspect_words(stacked, keys, "owned", [fk.name for fk in references], [fk.name for fk in references if _named_by_lines(fk)])
            parts.append(words.limit(MOST_WORDS + 1).select(F.lit(table).alias("table_name"), "words"))
    for row in union_all(parts).collect() if parts else ():
        found[row["table_name"]].append(row["words"])
    return {table: words if words is not None and len(words) <= MOST_WORDS else None for table, words in found.items()}


def key_rules(table: str, tables: Mapping[str, DataFrame], suspects: Mapping[str, list[list[int | None]] | None] | None = None) -> RuleFrame:
    """Everything asked of one primary key: DQ-G1, each DQ-G2 reference to it, and DQ-L9 on orders.

    DQ-G1: a NULL key counts per row, a repeated key (NULL ones too) counts once more per value.
    DQ-G2: child rows whose reference has no parent row, NULL references included.
    DQ-L9: orders no line refers to.

    Parent keys and the children's references are stacked and counted per value. That is one hash
    aggregation that sums up in the tasks first: each table's key goes through one shuffle for all
    these rules, nothing is sorted or joined, and a hot value arrives as one row per task. With
    ``suspects`` (from ``suspect_keys``) only the keys in suspect words are counted so.
    """
    keys = SILVER[table].primary_key
    references = _references(table, tables)
    origins = ["owned", *[fk.name for fk in references]]
    rows = rows_of_words(_stacked_keys(table, tables), keys, (suspects or {}).get(table))
    values = rows.groupBy(*keys).agg(*[F.count(o).alias(o) for o in origins])

    missing, owned = any_null(keys), F.col("owned")
    repeated = owned > 1
    weight = F.when(missing, owned).otherwise(0) + F.when(repeated, 1).otherwise(0)
    found = [Rule("DQ-G1", table, (missing & (owned > 0)) | repeated, keys, weight)]
    for fk in references:
        used = F.col(fk.name)
        orphan = (used > 0) & (missing | (owned == 0))
        found.append(Rule("DQ-G2", f"{fk.child}.{fk.name}", orphan, keys, used))
        if _named_by_lines(fk):
            found.append(Rule("DQ-L9", "orders", (owned > 0) & (missing | (used == 0)), keys, owned))
    return RuleFrame(values, tuple(found), derived=True)


def staging_rules(tables: Mapping[str, DataFrame]) -> list[RuleFrame]:
    """DQ-L1 to L9, G1 for every table and G2 for every foreign key; looks for suspect keys at once."""
    suspects = suspect_keys(tables)
    return [
        line_rules(tables["lineitem"]),
        line_order_rules(tables["lineitem"], tables["orders"]),
        order_rules(tables["orders"]),
        status_rules(tables["ship_date_status"]),
        *[key_rules(name, tables, suspects) for name in SILVER],
    ]


# --- counting and sampling ---------------------------------------------------------------------


def _counted(frame: RuleFrame) -> DataFrame:
    totals = frame.rows.agg(*[
        F.coalesce(F.sum(F.when(rule.violated, rule.weight)), F.lit(0)).cast("bigint").alias(f"r{i}")
        for i, rule in enumerate(frame.rules)
    ])
    rows = ", ".join(f"'{r.rule_id}', '{r.layer}', '{r.table_name}', r{i}" for i, r in enumerate(frame.rules))
    return totals.selectExpr(
        f"stack({len(frame.rules)}, {rows}) AS (rule_id, layer, table_name, violation_count)"
    )


def _sampled(frame: RuleFrame, failing: Collection[tuple[str, str]] | None = None) -> DataFrame:
    """The first violating keys of each rule in key order, as a JSON array of ``|``-joined texts.

    All failing rules of a frame are sampled in one pass over it. ``row_number() <= n`` lets Spark
    keep the best rows of each rule inside every task, so only those are shuffled.
    """
    rules = [r for r in frame.rules if failing is None or r.name in failing]
    keys = frame.rules[0].keys
    hits = F.array(*[
        F.when(r.violated, F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.table_name).alias("table_name"),
            r.weight.cast("bigint").alias("times"),
        ))
        for r in rules
    ])
    broken = frame.rows.where(reduce(or_, (r.violated for r in rules)))
    rank = F.row_number().over(Window.partitionBy("rule_id", "table_name").orderBy(*keys))
    top = (
        broken.select(*keys, F.inline(hits)).where(F.col("rule_id").isNotNull())
        .withColumn("rank", rank).where(F.col("rank") <= MAX_SAMPLE_KEYS)
    )
    copies = F.explode(F.sequence(F.lit(1), F.least("times", F.lit(MAX_SAMPLE_KEYS))))
    ordered = F.slice(F.array_sort(F.collect_list(F.struct(*keys))), 1, MAX_SAMPLE_KEYS)
    texts = F.transform(ordered, lambda k: F.concat_ws("|", *[k[c].cast("string") for c in keys]))
    return (
        top.select("rule_id", "table_name", *keys, copies)
        .groupBy("rule_id", "table_name").agg(F.to_json(texts).alias("sample_keys"))
    )


def rule_counts(frames: Iterable[RuleFrame]) -> DataFrame:
    """One row per rule and table with its violation count."""
    return union_all(_counted(f) for f in frames)


def only(frame: RuleFrame, *names: str) -> RuleFrame:
    """The frame's rules of these ids or tables."""
    return RuleFrame(frame.rows, tuple(r for r in frame.rules if set(r.name) & set(names)), frame.derived)


def record(frame: RuleFrame, *names: str) -> DataFrame:
    """Counts and sample keys of the frame's rules (or of those named) in one plan."""
    frame = only(frame, *names) if names else frame
    report = fold([_counted(frame), _sampled(frame)], ("rule_id", "table_name"))
    return report.withColumn("sample_keys", F.coalesce("sample_keys", F.lit("[]"))).select(*REPORT_COLUMNS)


def dq_report(frames: Iterable[RuleFrame], more_counts: DataFrame | None = None) -> DataFrame:
    """Every rule with its count and sample keys, ordered by rule and table, as one plan."""
    report = union_all(record(f) for f in frames)
    return with_counts(report, more_counts)


def with_counts(report: DataFrame, more_counts: DataFrame | None) -> DataFrame:
    """The report and the results of rules that come with samples of their own, in order."""
    if more_counts is not None:
        report = report.unionByName(more_counts.select(*REPORT_COLUMNS))
    return report.orderBy("rule_id", "table_name")


def sampled_where_failing(frames: Iterable[RuleFrame], counts: DataFrame, failing: Collection[tuple[str, str]]) -> DataFrame:
    """Counted rules with sample keys, read from only those frames that have a failing rule."""
    samples = [_sampled(f, failing) for f in frames if any(r.name in failing for r in f.rules)]
    report = fold([counts, *samples], ("rule_id", "table_name")) if samples else counts.withColumn("sample_keys", F.lit("[]"))
    return report.withColumn("sample_keys", F.coalesce("sample_keys", F.lit("[]"))).select(*REPORT_COLUMNS)


def violations(frame: RuleFrame) -> RuleFrame:
    """The frame over its violating rows alone, written with their keys and weights, so its rows are made once."""
    keys = frame.rules[0].keys
    weights = [F.when(r.violated, r.weight).cast("bigint").alias(f"w{i}") for i, r in enumerate(frame.rules)]
    rows = frame.rows.where(reduce(or_, (r.violated for r in frame.rules))).select(*keys, *weights)
    found = [replace(r, violated=F.col(f"w{i}").isNotNull(), weight=F.col(f"w{i}")) for i, r in enumerate(frame.rules)]
    return RuleFrame(written(rows, "violations"), tuple(found))


def report_in_two_steps(frames: list[RuleFrame], more_counts: DataFrame | None = None) -> DataFrame:
    """``dq_report`` that counts at once and then samples what failed only, so clean data is read once.

    The violating rows of joined and grouped frames are written, and both steps read these. The counts are brought
    to the driver, one small row per rule of the contract.
    """
    frames = [violations(f) if f.derived else f for f in frames]
    counts = rule_counts(frames)
    counted = counts.collect()
    failing = {(r.rule_id, r.table_name) for r in counted if r.violation_count > 0}
    known = counts.sparkSession.createDataFrame(counted, counts.schema)
    return with_counts(sampled_where_failing(frames, known, failing), more_counts)


def _difference_rows(rule_id: Column, layer: str, counts: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Row-count differences along ``names``; the counts themselves are the sample."""
    steps = [F.abs(F.col(a) - F.col(b)) for a, b in zip(names, names[1:])]
    difference = sum(steps[1:], steps[0])
    shown = F.array(*[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in names])
    return counts.select(
        rule_id.alias("rule_id"), F.lit(layer).alias("layer"), "table_name",
        difference.cast("bigint").alias("violation_count"),
        F.to_json(F.when(difference > 0, shown).otherwise(F.array().cast("array<string>"))).alias("sample_keys"),
    )


def count_rules(
    source: Mapping[str, DataFrame], bronze: Mapping[str, DataFrame], staging: Mapping[str, DataFrame]
) -> DataFrame:
    """DQ-G3: rows lost or gained between source, Bronze and staging, per source table."""
    layers = {"source": source, "bronze": bronze, "staging": staging}
    parts = [
        part for layer, tables in layers.items()
        for part in row_counts({t: tables[t] for t in SOURCE_TABLES}, layer)
    ]
    return _lost_rows(fold(parts, ("table_name",)))


def known_count_rules(spark: SparkSession, counts: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """DQ-G3 from counts per layer (``source, bronze, staging``) and table that the passes which wrote them took."""
    rows = [(t, *(counts[layer][t] for layer in COUNTED_LAYERS)) for t in SOURCE_TABLES]
    return _lost_rows(spark.createDataFrame(rows, "table_name string, source long, bronze long, staging long"))


def _lost_rows(counts: DataFrame) -> DataFrame:
    return _difference_rows(F.lit("DQ-G3"), "staging", counts, COUNTED_LAYERS)


def gold_count_rules(
    lineitem: DataFrame, orders: DataFrame, line_fact: DataFrame, order_fact: DataFrame
) -> DataFrame:
    """DQ-GOLD1 and 2: each fact has exactly as many rows as the Silver table behind it."""
    pairs = {"fct_lineitem_delivery": (lineitem, line_fact), "fct_order_fulfillment": (orders, order_fact)}
    parts = row_counts({t: p[0] for t, p in pairs.items()}, "silver")
    parts += row_counts({t: p[1] for t, p in pairs.items()}, "gold")
    rule = F.when(F.col("table_name") == "fct_lineitem_delivery", "DQ-GOLD1").otherwise("DQ-GOLD2")
    return _difference_rows(rule, "gold", fold(parts, ("table_name",)), ("silver", "gold"))

"""The registered queries: each operator over the whole test tables, by name."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SOURCE_TABLES
from ..contracts import FACTS, GOLD, SILVER, VALIDATE_RESULTS
from ..functions.frames import union_all, written
from ..operators import profiling, rules
from ..operators.aggregates import AGGREGATE_BUILDERS, AGGREGATE_MEASURES, FACT_BUILDERS
from ..operators.diff import bag_diff, layer_diff
from ..operators.gate import audit_rows, for_run, gate_verdict, latest_results, run_ids
from ..operators.histograms import histograms, merged
from ..operators.layers import bronze, inject_receipt_before_ship, staged, staged_tables
from ..operators.ledger import last_events, newest_run, run_states
from ..operators.quantiles import exact_percentiles
from ..operators.reports import bronze_report, enforced_violations, gold_report, silver_report, staging_report
from ..sources.fixtures import raw, source_table, source_tables
from .analysis import ANSWERS

Query = Callable[[SparkSession, str], DataFrame]
RUN_TS = datetime(2026, 10, 7, tzinfo=timezone.utc)
PRICE_SHARES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
LOADED_AT = "2026-10-07 16:43:01"


def comparable(df: DataFrame) -> DataFrame:
    """Results as every engine can state them.

    Doubles go to six digits, as engines differ in the last bits of sums and roots. Money is shown
    as a double, because clients hand out decimals in different ways.
    """
    shown = {c: F.round(c, 6) for c, t in df.dtypes if t == "double"}
    shown |= {c: F.col(c).cast("double") for c, t in df.dtypes if t.startswith("decimal")}
    return df.withColumns(shown) if shown else df


class Gold(dict):
    """Gold tables, each planned when it is first asked for.

    Aggregates read the measures they need from the facts or, if ``shared``, all from one written histogram.
    """

    def __init__(self, lineitem: DataFrame, orders: DataFrame, shared: bool = False):
        super().__init__()
        self.silver, self.shared = (lineitem, orders), shared

    @cached_property
    def histogram(self) -> DataFrame:
        return written(histograms(*(self[f] for f in FACTS)), "histogram")

    def __missing__(self, name: str) -> DataFrame:
        if name in FACT_BUILDERS:
            self[name] = FACT_BUILDERS[name](*self.silver)
        else:
            read = self.histogram if self.shared else histograms(*(self[f] for f in FACTS), AGGREGATE_MEASURES[name])
            self[name] = AGGREGATE_BUILDERS[name](read)
        return self[name]


class Inputs:
    """Lazily built relations of one test data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def source(self, table: str, dirty: bool = False) -> DataFrame:
        return source_table(self.spark, self.sf_dir, table, dirty)

    def sources(self, dirty: bool = False) -> dict[str, DataFrame]:
        return source_tables(self.spark, self.sf_dir, dirty)

    def staged(self, table: str, dirty: bool = False) -> DataFrame:
        return staged(self.source(SILVER[table].source, dirty), SILVER[table])

    def staging(self, dirty: bool = False) -> dict[str, DataFrame]:
        return staged_tables(self.sources(dirty))

    def stored(self, dirty: bool = False) -> dict[str, DataFrame]:
        """The sources; those that take a join or a grouping to make are written, as queries read them many times."""
        tables = self.sources(dirty)
        made = ("partsupp",) if dirty else ("partsupp", "lineitem")
        return tables | {t: written(tables[t], f"source-{t}") for t in made}

    def stored_staging(self, sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Staging of stored sources; the tables split off another one are written too."""
        tables = staged_tables(sources)
        return tables | {t: written(df, f"staging-{t}") for t, df in tables.items() if SILVER[t].decomposed}

    def gold(self, dirty: bool = False, shared: bool = False) -> Gold:
        return Gold(self.staged("lineitem", dirty), self.staged("orders", dirty), shared)

    def ledger(self) -> DataFrame:
        """The event stream read as a ledger: one run per user, signup starts it, purchase ends it."""
        kind = F.col("event_type")
        event = F.when(kind == "signup", "started").when(kind == "purchase", "succeeded").otherwise(kind)
        return raw(self.spark, self.sf_dir, "events").select(
            F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
            event.alias("event"), F.col("ts").alias("event_ts"),
        )

    def bronze(self, dirty: bool = False, sources: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """Bronze as loaded; the dirty one has lost orders, a changed type, another order of columns and no source name."""
        loaded = {t: bronze(df, f"samples.{t}", RUN_TS) for t, df in (sources or self.sources(dirty)).items()}
        if dirty:
            loaded["orders"] = loaded["orders"].where("o_orderkey % 97 <> 5")
            loaded["part"] = loaded["part"].withColumn("p_size", F.col("p_size").cast("string"))
            loaded["nation"] = loaded["nation"].select("n_name", *(c for c in loaded["nation"].columns if c != "n_name"))
            loaded["region"] = loaded["region"].drop("_source_table")
        return loaded

    def altered(self) -> dict[str, DataFrame]:
        """Dirty staging that has lost lines and changed a type."""
        tables = self.staging(True)
        tables["lineitem"] = tables["lineitem"].where("l_linenumber <> 3")
        tables["part"] = tables["part"].withColumn("p_size", F.col("p_size").cast("bigint"))
        return tables

    def report(self, dirty: bool) -> DataFrame:
        """All rules, the row counts between source, Bronze and staging included."""
        sources = self.stored(dirty)
        staging = self.stored_staging(sources)
        lost = rules.count_rules(sources, self.bronze(dirty, sources), staging)
        return rules.report_in_two_steps(rules.staging_rules(staging), lost)

    def audit(self, run: str) -> DataFrame:
        """Audit rows of the run ``clean``, which passed, or of ``dirty``, which failed."""
        return audit_rows(self.report(run == "dirty"), run, RUN_TS)

    def both_audits(self) -> DataFrame:
        """The complete audits of both runs; the dirty one came later. A run's audit is a handful of rows, noted as such."""
        def noted(run: str, at: datetime) -> DataFrame:
            report = self.report(run == "dirty")
            return audit_rows(self.spark.createDataFrame(report.collect(), report.schema), run, at)

        return noted("clean", RUN_TS).unionByName(noted("dirty", RUN_TS + timedelta(hours=1)))


def _relation(make: Callable[[Inputs], DataFrame]) -> Query:
    return lambda spark, sf_dir: comparable(make(Inputs(spark, sf_dir)))


def _layers() -> dict[str, Query]:
    def short_gold(x: Inputs) -> dict[str, DataFrame]:
        made = x.gold(True, shared=True)
        gold = {t: made[t] for t in GOLD}
        gold["agg_ship_mode_performance"] = gold["agg_ship_mode_performance"].drop("delay_rate")
        return gold

    def loaded(x: Inputs, table: str) -> DataFrame:
        return bronze(x.source(table), f"samples.{table}", F.lit(LOADED_AT).cast("timestamp_ntz"))

    made = {
        "bronze_ingest": lambda x: loaded(x, "orders"),
        "bronze_report": lambda x: bronze_report(x.sources(), x.bronze()),
        "bronze_report_dirty": lambda x: bronze_report(x.sources(True), x.bronze(True)),
        "staging_report": lambda x: staging_report(x.bronze(), x.staging()),
        "staging_report_dirty": lambda x: staging_report(x.bronze(True), x.altered()),
        "silver_report": lambda x: silver_report(x.staging(), x.staging()),
        "silver_report_dirty": lambda x: silver_report(x.staging(True), x.altered()),
        "gold_report_dirty": lambda x: gold_report(short_gold(x)),
        "enforced_constraints": lambda x: enforced_violations(x.staging(True)),
        "inject_bad_row": lambda x: inject_receipt_before_ship(x.staged("lineitem")),
    }
    made |= {f"stage_{t}": lambda x, t=t: x.staged(t) for t in SILVER}
    made |= {f"bronze_ingest_{t}": lambda x, t=t: loaded(x, t) for t in SOURCE_TABLES if t != "orders"}
    return {name: _relation(f) for name, f in made.items()}


def _validation() -> dict[str, Query]:
    def lines(x):
        return rules.line_rules(x.staged("lineitem", True))

    def joined(x):
        return rules.line_order_rules(x.staged("lineitem", True), x.staged("orders", True))

    def keys(x, rule_id):
        tables = x.staging(True)
        suspects = rules.suspect_keys(tables)
        found = [rules.only(rules.key_rules(t, tables, suspects), rule_id) for t in SILVER]
        return union_all(rules.record(f) for f in found if f.rules)

    def l4(x):
        dated = rules.record(rules.order_rules(x.staged("orders", True)))
        return rules.record(lines(x), "DQ-L4").unionByName(dated)

    def samples(x):
        tables = x.staging(True)
        return union_all([
            rules.record(rules.key_rules("lineitem", tables), "lineitem"),
            rules.record(rules.key_rules("brand", tables), "brand", "part.part_brand_fk"),
            rules.record(rules.key_rules("part_quantity_price", tables), "part_quantity_price"),
            rules.record(rules.key_rules("partsupp", tables), "lineitem.lineitem_partsupp_fk"),
        ])

    def empty_orders(x):
        tables = {t: x.staged(t, True) for t in ("orders", "lineitem")}
        return rules.record(rules.key_rules("orders", tables), "DQ-L9")

    def gold_counts(x):
        gold = x.gold(True)
        return rules.gold_count_rules(*gold.silver, *(gold[f] for f in FACTS))

    made = {
        "dq_l1_dirty": lambda x: rules.record(joined(x), "DQ-L1"),
        "dq_l2_dirty": lambda x: rules.record(lines(x), "DQ-L2"),
        "dq_l3_dirty": lambda x: rules.record(joined(x), "DQ-L3"),
        "dq_l4_dirty": l4,
        "dq_l5_dirty": lambda x: rules.record(lines(x), "DQ-L5"),
        "dq_l6_dirty": lambda x: rules.record(lines(x), "DQ-L6"),
        "dq_l7_dirty": lambda x: rules.record(rules.status_rules(x.staged("ship_date_status", True))),
        "dq_l8_dirty": lambda x: rules.record(joined(x), "DQ-L8"),
        "dq_l9_dirty": empty_orders,
        "dq_g1_dirty": lambda x: keys(x, "DQ-G1"),
        "dq_g2_dirty": lambda x: keys(x, "DQ-G2"),
        "dq_g3": lambda x: rules.count_rules(x.sources(True), x.bronze(True), x.staging()),
        "dq_gold": gold_counts,
        "dq_samples_dirty": samples,
        "dq_report_dirty": lambda x: x.report(True),
        "dq_report_clean": lambda x: x.report(False),
        "dq_gate": lambda x: gate_verdict(x.audit("dirty"), "dirty", VALIDATE_RESULTS),
        "dq_gate_clean": lambda x: gate_verdict(x.audit("clean"), "clean", VALIDATE_RESULTS),
        "audit_for_run": lambda x: for_run(x.audit("dirty"), "dirty", ("DQ-L2", "DQ-G1")).drop("run_ts"),
        "audit_latest": lambda x: latest_results(x.both_audits()).drop("run_ts"),
        "audit_run_ids": lambda x: run_ids(x.both_audits()),
    }
    return {name: _relation(f) for name, f in made.items()}


def _gold() -> dict[str, Query]:
    def in_batches(gold: Gold) -> DataFrame:
        """The histograms of two batches of orders, put together."""
        facts = [gold[f] for f in FACTS]
        return merged(*(histograms(*(f.where(F.pmod("order_key", F.lit(2)) == part) for f in facts)) for part in (0, 1)))

    made = {name: lambda x, name=name: x.gold()[name] for name in GOLD}
    made |= {f"{name}_dirty": lambda x, name=name: x.gold(True)[name] for name in GOLD}
    for suffix, dirty in (("", False), ("_dirty", True)):
        made[f"delivery_histograms{suffix}"] = lambda x, d=dirty: in_batches(x.gold(d))
        made[f"price_percentiles{suffix}"] = lambda x, d=dirty: exact_percentiles(
            x.source("lineitem", d), "l_extendedprice", PRICE_SHARES, "l_shipmode")
    made["gold_report"] = lambda x: gold_report(x.gold(shared=True))
    return {name: _relation(f) for name, f in made.items()}


def _answers() -> dict[str, Query]:
    made = {name: lambda x, answer=answer: answer(x.gold()) for name, answer in ANSWERS.items()}
    made |= {f"{name}_dirty": lambda x, answer=answer: answer(x.gold(True)) for name, answer in ANSWERS.items()}
    made |= {
        "answers_text": lambda x: ANSWERS["answers_text"](x.gold(shared=True)),
        "answers_text_dirty": lambda x: ANSWERS["answers_text"](x.gold(True, shared=True)),
    }
    return {name: _relation(f) for name, f in made.items()}


def _profile() -> dict[str, Query]:
    made: dict[str, Callable[[Inputs], DataFrame]] = {}
    for suffix, dirty in (("", False), ("_dirty", True)):
        made |= {
            f"profile_values{suffix}": lambda x, d=dirty: profiling.value_counts(x.source("lineitem", d), profiling.CATEGORIES),
            f"profile_priority{suffix}": lambda x, d=dirty: profiling.value_counts(x.source("orders", d), ("o_orderpriority",)),
            f"profile_date_ranges{suffix}": lambda x, d=dirty: profiling.date_ranges(x.sources(d)),
            f"profile_lines_per_order{suffix}": lambda x, d=dirty: profiling.lines_per_order(
                x.source("orders", d), x.source("lineitem", d)
            ),
            f"profile_keys{suffix}": lambda x, d=dirty: profiling.key_checks(x.sources(d)),
            f"profile_fds{suffix}": lambda x, d=dirty: profiling.fd_checks(x.sources(d)),
            f"profile_constant{suffix}": lambda x, d=dirty: profiling.constant_check(x.source("orders", d), "o_shippriority"),
            f"profile_documented_rules{suffix}": lambda x, d=dirty: profiling.documented_rules(x.sources(d)),
            f"profile_cutoffs{suffix}": lambda x, d=dirty: profiling.snapshot_cutoffs(x.source("lineitem", d)),
        }
    return {name: _relation(f) for name, f in made.items()}


def _changes() -> dict[str, Query]:
    def listed(states: DataFrame) -> DataFrame:
        return states.withColumn("kinds", F.array_join("kinds", ","))

    def injected(x: Inputs) -> DataFrame:
        return inject_receipt_before_ship(x.staged("lineitem"))

    made = {
        "bag_diff": lambda x: bag_diff(x.staged("lineitem"), injected(x)),
        "bag_diff_fixtures": lambda x: bag_diff(x.staged("part", True), x.staged("part")),
        "layer_diff": lambda x: layer_diff(*(x.stored_staging(x.stored(dirty)) for dirty in (False, True))),
        "ledger_states": lambda x: listed(run_states(x.ledger())),
        "ledger_latest": lambda x: newest_run(x.ledger()),
        "ledger_last_events": lambda x: last_events(x.ledger()),
    }
    return {name: _relation(f) for name, f in made.items()}


def queries() -> dict[str, Query]:
    return _gold() | _answers() | _layers() | _validation() | _profile() | _changes()

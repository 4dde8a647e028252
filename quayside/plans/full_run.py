"""One complete execution: Bronze, staging, validation, Silver, Gold, with ledger and audit."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_PREFIX, SOURCE_TABLES, new_run_id
from ..contracts import DQ_RESULTS_SCHEMA, FACTS, GOLD, GOLD_RESULTS, RUNS_SCHEMA, SILVER, VALIDATE_RESULTS
from ..operators.aggregates import AGGREGATE_BUILDERS, FACT_BUILDERS
from ..operators.gate import audit_rows, for_run, raise_if_failed
from ..operators.histograms import histograms
from ..operators.layers import bronze, staged_tables
from ..operators.ledger import STEPS, ResumeError, ledger_event, steps_to_do
from ..operators.reports import (
    bronze_report,
    constraint_properties,
    enforced_measures,
    gold_report,
    raise_if_broken,
    require_ok,
    silver_report,
    staging_report,
)
from ..operators.rules import (
    COUNTED_LAYERS,
    count_rules,
    gold_count_rules,
    known_count_rules,
    report_in_two_steps,
    staging_rules,
)
from ..sources.readers import read_source
from ..sources.store import Store

CHECKS, RUNS = "dq_check_results", "pipeline_runs"
RESULT_KEYS, EVENT_KEYS = ("run_id", "rule_id", "layer", "table_name"), ("run_id", "event")
HISTOGRAMS = "delivery_histograms"


@dataclass(frozen=True)
class Execution:
    """What the steps of one run share."""

    spark: SparkSession
    store: Store
    source: object
    run_id: str
    rows: dict[str, dict[str, int]] = field(default_factory=dict)  # per layer and table, as counted by the steps so far

    def source_tables(self) -> dict[str, DataFrame]:
        return {t: read_source(self.spark, self.source, t) for t in SOURCE_TABLES}

    def audit(self) -> DataFrame:
        return self.store.read("audit", CHECKS)

    def append_results(self, report: DataFrame) -> None:
        """One row per rule and table; results of this run that are there already stay as they are."""
        self.store.append(audit_rows(report, self.run_id), "audit", CHECKS, RESULT_KEYS)


def start(spark: SparkSession, store: Store, source, run_id: str | None = None) -> Execution:
    """Open the audit tables for a fresh execution; earlier rows are kept, leftovers of a lost driver are swept."""
    local = spark.sparkContext.master.startswith("local")
    home = spark.conf.get("spark.sql.warehouse.dir")
    if not local and store.layout.catalog == "spark_catalog" and (home.startswith("file:") or "://" not in home):
        raise ValueError(f"spark.sql.warehouse.dir is {home!r}, a folder of one machine; name a shared one")
    store.sweep(("bronze", "staging", "silver", "gold"))
    store.ensure("audit", CHECKS, DQ_RESULTS_SCHEMA)
    store.ensure("audit", RUNS, RUNS_SCHEMA)
    return Execution(spark, store, source, run_id or new_run_id())


def record_event(run: Execution, event: str) -> None:
    row = ledger_event(run.spark, run.run_id, event, run.store.layout, run.source.label)
    run.store.append(row, "audit", RUNS, EVENT_KEYS)


def ingest(run: Execution) -> None:
    """Copy the source into Bronze and compare the two.

    The rows of the source are counted as they pass by; those of Bronze come from its files' footers.
    """
    ingested_at = datetime.now(timezone.utc)
    tables = run.source_tables()
    loaded = {t: bronze(df, f"{run.source.label}.{t}", ingested_at) for t, df in tables.items()}

    def check(new: dict[str, DataFrame], seen: dict[str, dict[str, int]]) -> None:
        run.rows["source"] = {t: m["rows"] for t, m in seen.items()}
        found = require_ok(bronze_report(tables, new, run.rows["source"]))
        run.rows["bronze"] = {t: r.bronze_rows for t, r in found.items()}

    run.store.replace_all(loaded, "bronze", check)


def stage(run: Execution, amend: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None) -> None:
    """Project Bronze to the contract; ``amend`` plants faults in a scratch prefix."""
    if amend and run.store.layout.prefix == DEFAULT_PREFIX:
        raise ValueError("staged tables are amended only in a scratch prefix")
    sources = run.store.read_all("bronze", SOURCE_TABLES)
    staged = staged_tables(sources)
    staged |= {name: change(staged[name]) for name, change in (amend or {}).items()}

    def check(new: dict[str, DataFrame], seen: dict[str, dict[str, int]]) -> None:
        projected = None if amend else {t: m["rows"] for t, m in seen.items()}
        found = require_ok(staging_report(sources, new, projected))
        run.rows["staging"] = {t: found[t].staging_rows for t in SOURCE_TABLES}

    run.store.replace_all(staged, "staging", check)


def validate(run: Execution) -> None:
    """Record every rule, then stop the run if one failed or is missing."""
    staging = run.store.read_all("staging", SILVER)
    if run.rows.keys() >= set(COUNTED_LAYERS):
        lost = known_count_rules(run.spark, run.rows)
    else:
        lost = count_rules(run.source_tables(), run.store.read_all("bronze", SOURCE_TABLES), staging)
    run.append_results(report_in_two_steps(staging_rules(staging), lost))
    raise_if_failed(run.audit(), run.run_id, VALIDATE_RESULTS)


def publish(run: Execution) -> None:
    """Publish staging as Silver, only behind a passed gate of the same run.

    Every table is read once: row counts and broken constraints come from the tasks that write it, and a
    version that breaks one is dropped before it is put in place.
    """
    raise_if_failed(run.audit(), run.run_id, VALIDATE_RESULTS)
    staging = run.store.read_all("staging", SILVER)

    def check(new: dict[str, DataFrame], seen: dict[str, dict[str, int]]) -> None:
        raise_if_broken(seen)
        require_ok(silver_report(staging, new, {t: m["rows"] for t, m in seen.items()}))

    run.store.replace_all(
        staging, "silver", check, {t: constraint_properties(t) for t in SILVER}, {t: enforced_measures(t) for t in SILVER}
    )


def build_gold(run: Execution) -> None:
    """Write facts and aggregates, reconcile them, and only then show them.

    The written facts are read once, for the histograms; all aggregates are derived from these. A failed
    check discards the new versions and leaves the tables of the last good run in place.
    """
    store, spark = run.store, run.spark
    lineitem, orders = store.read("silver", "lineitem"), store.read("silver", "orders")
    written: dict[str, str] = {}
    try:
        written |= store.write_all({t: build(lineitem, orders) for t, build in FACT_BUILDERS.items()}, "gold")
        line_fact, order_fact = (spark.table(written[f]) for f in FACTS)
        written[HISTOGRAMS] = store.write_new(histograms(line_fact, order_fact).coalesce(1), "gold", HISTOGRAMS)  # one row per value
        counted = spark.table(written[HISTOGRAMS])
        written |= store.write_all({t: build(counted) for t, build in AGGREGATE_BUILDERS.items()}, "gold")
        require_ok(gold_report({t: spark.table(written[t]) for t in GOLD}), "columns_match_contract")
        run.append_results(gold_count_rules(lineitem, orders, line_fact, order_fact))
        raise_if_failed(run.audit(), run.run_id, GOLD_RESULTS)
    except Exception:
        store.discard(written.values())
        raise
    store.swap("gold", written)


def _go_on(run: Execution, steps: Sequence[str], amend: Mapping[str, Callable[[DataFrame], DataFrame]] | None) -> Execution:
    """The steps in order, each recorded when it is finished. The first exception ends the run."""
    actions = {"ingested": ingest, "staged": lambda r: stage(r, amend), "validated": validate, "published": publish, "built": build_gold}
    for step in steps:
        actions[step](run)
        record_event(run, step)
    record_event(run, "succeeded")
    return run


def run_all(
    spark: SparkSession,
    store: Store,
    source,
    amend: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> Execution:
    """The whole run in order. An exception leaves ``started`` and the finished steps without ``succeeded``."""
    run = start(spark, store, source)
    record_event(run, "started")
    return _go_on(run, STEPS, amend)


def resume(
    spark: SparkSession,
    store: Store,
    source,
    run_id: str,
    amend: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> Execution:
    """Go on with a run that was lost, after its last finished step: finished layers are neither read from the source nor written again.

    A rule that failed is recorded; the same data would fail again, so such a run is begun anew instead.
    """
    if not store.exists("audit", RUNS):
        raise ResumeError(f"run {run_id} cannot go on: the run ledger does not exist")
    steps = steps_to_do(store.read("audit", RUNS), run_id)
    return _go_on(start(spark, store, source, run_id), steps, amend)


def compact_audit(store: Store) -> None:
    """One file per month for results and events."""
    store.compact("audit", CHECKS, F.trunc("run_ts", "month"))
    store.compact("audit", RUNS, F.trunc("event_ts", "month"))


def run_silver(
    spark: SparkSession,
    store: Store,
    source,
    amend: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> Execution:
    """Stage, validate and publish over existing Bronze; writes audit rows but no ledger events."""
    run = start(spark, store, source)
    stage(run, amend)
    validate(run)
    publish(run)
    return run


def results_of(run: Execution) -> DataFrame:
    return for_run(run.audit(), run.run_id).orderBy("rule_id", "table_name")

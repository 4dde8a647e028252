"""Audit rows of one run and the gate over them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import require_run_id
from .rules import CHECKED_LAYERS, MAX_SAMPLE_KEYS

REPORT_SCHEMA = "rule_id string, layer string, table_name string, violation_count bigint, sample_keys string"


class DataQualityError(RuntimeError):
    """A blocking rule failed or left no result."""


def audit_rows(report: DataFrame, run_id: str, run_ts: datetime | None = None) -> DataFrame:
    """Report rows as they are appended to the audit table; a rule passes only with no violation."""
    return report.select(
        F.lit(require_run_id(run_id)).alias("run_id"),
        F.lit(run_ts or datetime.now(timezone.utc)).cast("timestamp").alias("run_ts"),
        "rule_id", "layer", "table_name", "violation_count", "sample_keys",
        F.lit("blocking").alias("severity"),
        (F.col("violation_count") == 0).alias("passed"),
    )


@dataclass(frozen=True)
class OwnResult:
    """The result of a rule that a user evaluates; refused at once if no audit row could hold it."""

    rule: str
    layer: str
    table: str
    violations: int
    samples: tuple[str, ...] = ()

    def __post_init__(self):
        if self.layer not in CHECKED_LAYERS:
            raise ValueError(f"no checked layer: {self.layer!r}; there are {', '.join(CHECKED_LAYERS)}")
        if self.violations < 0:
            raise ValueError(f"{self.rule} cannot be broken {self.violations} times")


def own_results(spark: SparkSession, results: Iterable[OwnResult]) -> DataFrame:
    """Own results as report rows, ready for ``audit_rows``; samples are cut and encoded as in every report."""
    rows = [(r.rule, r.layer, r.table, r.violations, list(r.samples)) for r in results]
    report = spark.createDataFrame(rows, REPORT_SCHEMA.replace("sample_keys string", "sample_keys array<string>"))
    return report.withColumn("sample_keys", F.to_json(F.slice("sample_keys", 1, MAX_SAMPLE_KEYS)))


def for_run(audit: DataFrame, run_id: str, rule_ids: Iterable[str] | None = None) -> DataFrame:
    """Rows of one run, optionally of some rules; other runs never matter."""
    rows = audit.where(F.col("run_id") == require_run_id(run_id))
    return rows if rule_ids is None else rows.where(F.col("rule_id").isin(*rule_ids))


def latest_results(audit: DataFrame) -> DataFrame:
    """All results of the run recorded last (the smaller id on equal times), failed ones first."""
    newest = audit.groupBy("run_id").agg(F.max("run_ts").alias("at")).orderBy(F.col("at").desc(), "run_id").limit(1)
    return audit.join(newest.select("run_id"), "run_id", "left_semi").select(audit.columns).orderBy("passed", "rule_id", "table_name")


def run_ids(audit: DataFrame) -> DataFrame:
    return audit.select("run_id").distinct()


def gate_verdict(audit: DataFrame, run_id: str, expected: Iterable[str | tuple[str, str]]) -> DataFrame:
    """``rule_id, table_name, verdict, violations`` of every result that is there or expected: ``passed``, ``failed`` or ``missing``.

    ``expected`` are pairs of rule and table, or rules alone, which need a result for any table. A rule's
    results for tables that are not expected count too.
    """
    expected = [e if isinstance(e, tuple) else (e, None) for e in expected]
    wanted = audit.sparkSession.createDataFrame(expected, "rule_id string, table_name string")
    seen = for_run(audit, run_id, {rule for rule, _ in expected}).groupBy("rule_id", "table_name").agg(
        F.bool_and("passed").alias("passed"), F.sum("violation_count").alias("violations")
    )
    found = seen.select("rule_id", "table_name", F.when(F.col("passed"), "passed").otherwise("failed").alias("verdict"), "violations")
    met = seen.select(F.col("rule_id").alias("rule"), F.col("table_name").alias("table"))
    lacking = wanted.join(met, (F.col("rule_id") == F.col("rule")) & F.coalesce(F.col("table_name") == F.col("table"), F.lit(True)), "left_anti")
    return found.unionByName(lacking.select("rule_id", "table_name", F.lit("missing").alias("verdict"), F.lit(None).cast("long").alias("violations")))


def raise_if_failed(audit: DataFrame, run_id: str, expected: Iterable[str | tuple[str, str]]) -> None:
    """Stop the run unless every expected result is there and all results of these rules pass."""
    bad = gate_verdict(audit, run_id, expected).where("verdict <> 'passed'").orderBy("rule_id", "table_name").collect()
    if bad:
        told = "; ".join(
            f"{r.rule_id} {r.verdict}" + (f" for {r.table_name}" if r.table_name else "") + (f" ({r.violations} rows)" if r.violations else "") for r in bad)
        raise DataQualityError(f"run {run_id} is stopped: {told}")

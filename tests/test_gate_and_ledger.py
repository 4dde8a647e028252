from datetime import datetime, timedelta, timezone

import pytest

from quayside.config import Layout, new_run_id, require_run_id
from quayside.contracts import DQ_RESULTS_SCHEMA, RUNS_SCHEMA, VALIDATE_RESULTS
from quayside.operators import gate, ledger, rules
from quayside.plans.registry import Inputs

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def audit(spark):
    def rows(run_id, violations, samples):
        results = [
            gate.OwnResult("TEST-1", "staging", "lineitem", violations, tuple(samples)), gate.OwnResult("TEST-2", "staging", "orders", 0),
        ]
        return gate.audit_rows(gate.own_results(spark, results), run_id, T0)

    return rows("a", 3, ["1|1", "1|2", "2|1"]).unionByName(rows("b", 0, []))


def test_audit_rows_have_the_declared_schema(spark, audit):
    assert audit.dtypes == spark.createDataFrame([], DQ_RESULTS_SCHEMA).dtypes
    assert {(r.run_id, r.rule_id, r.passed) for r in audit.collect()} == {
        ("a", "TEST-1", False), ("a", "TEST-2", True), ("b", "TEST-1", True), ("b", "TEST-2", True),
    }


def test_results_of_ones_own_are_checked(spark):
    own = gate.own_results(spark, [gate.OwnResult("TEST-9", "gold", "t", 12, tuple(map(str, range(12))))])
    row = gate.audit_rows(own, "a").first()
    assert row.sample_keys == '["0","1","2","3","4","5","6","7","8","9"]' and row.severity == "blocking"
    with pytest.raises(ValueError):
        gate.audit_rows(own, "")
    for layer, violations in (("attic", 0), ("gold", -1)):
        with pytest.raises(ValueError):
            gate.OwnResult("TEST-9", layer, "t", violations)


def test_latest_results(spark, audit):
    later = gate.audit_rows(gate.own_results(spark, [
        gate.OwnResult("TEST-1", "gold", "t", 0), gate.OwnResult("TEST-2", "gold", "t", 4)]), "c", T0 + timedelta(hours=1))
    found = gate.latest_results(audit.unionByName(later)).collect()
    assert [(r.run_id, r.rule_id, r.passed) for r in found] == [("c", "TEST-2", False), ("c", "TEST-1", True)]


def test_gate(audit):
    with pytest.raises(gate.DataQualityError, match="TEST-1 failed"):
        gate.raise_if_failed(audit, "a", ["TEST-1", "TEST-2"])
    gate.raise_if_failed(audit, "a", ["TEST-2"])
    gate.raise_if_failed(audit, "b", ["TEST-1", "TEST-2"])  # the failed run before does not matter
    with pytest.raises(gate.DataQualityError, match="TEST-3 missing"):
        gate.raise_if_failed(audit, "b", ["TEST-3"])
    assert {r.run_id for r in gate.run_ids(audit).collect()} == {"a", "b"}


def test_gate_wants_every_table(spark):
    def audit(*results):
        return gate.audit_rows(gate.own_results(spark, [gate.OwnResult(r, "staging", t, n) for r, t, n in results]), "a", T0)

    complete = [(rule, table, 0) for rule, table in VALIDATE_RESULTS]
    assert len(complete) == len(set(complete)) == 41
    gate.raise_if_failed(audit(*complete), "a", VALIDATE_RESULTS)
    for lost in (("DQ-G2", "nation.nation_region_fk", 0), ("DQ-G1", "brand", 0), ("DQ-G3", "part", 0)):
        assert lost in complete
        with pytest.raises(gate.DataQualityError, match=f"{lost[0]} missing for {lost[1]}"):
            gate.raise_if_failed(audit(*[r for r in complete if r != lost]), "a", VALIDATE_RESULTS)
    verdicts = gate.gate_verdict(audit(*complete, ("DQ-G1", "elsewhere", 2)), "a", VALIDATE_RESULTS).collect()
    assert len(verdicts) == 42 and [(r.table_name, r.violations) for r in verdicts if r.verdict == "failed"] == [("elsewhere", 2)]


def test_expected_results_are_those_of_the_rules(spark, small):
    report = rules.rule_counts(rules.staging_rules(Inputs(spark, small).staging())).select("rule_id", "table_name").collect()
    assert {tuple(r) for r in report} == {e for e in VALIDATE_RESULTS if e[0] != "DQ-G3"}


def test_run_ids():
    assert new_run_id() != new_run_id()
    for missing in (None, ""):
        with pytest.raises(ValueError):
            require_run_id(missing)


def events(spark, *rows):
    return spark.createDataFrame(
        [(run, event, T0 + timedelta(minutes=at), "c", "p", "s") for run, event, at in rows], RUNS_SCHEMA
    )


def test_guard_accepts_only_a_succeeded_newest_run(spark):
    done = [("one", "started", 0), ("one", "succeeded", 5)]
    assert ledger.require_success(events(spark, *done)).run_id == "one"
    with pytest.raises(ledger.StaleResultsError, match="two"):
        ledger.require_success(events(spark, *done, ("two", "started", 9)))
    # an older run that succeeds late does not become the newest
    late = [("one", "started", 0), ("two", "started", 1), ("one", "succeeded", 9), ("two", "succeeded", 5)]
    assert ledger.require_success(events(spark, *late)).run_id == "two"
    with pytest.raises(ledger.StaleResultsError, match="empty"):
        ledger.require_success(spark.createDataFrame([], RUNS_SCHEMA))
    with pytest.raises(ledger.StaleResultsError, match="does not exist"):
        ledger.require_success(None)


def test_states_and_last_events(spark):
    rows = events(spark, ("one", "started", 0), ("one", "succeeded", 5), ("two", "started", 9))
    assert {r.run_id: r.kinds for r in ledger.run_states(rows).collect()} == {
        "one": ["started", "succeeded"], "two": ["started"],
    }
    assert [(r.run_id, r.event) for r in ledger.last_events(rows).collect()] == [("two", "started"), ("one", "succeeded")]


def test_unknown_event_is_refused(spark):
    with pytest.raises(ValueError):
        ledger.ledger_event(spark, "r", "paused", Layout(), "s")

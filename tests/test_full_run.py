"""The whole run on the clean test tables: success, rerun, injected fault, guard, snapshot."""

import re

import pytest
from comparing import executions_since, last_execution
from pyspark.sql import functions as F

from quayside.config import DEFAULT_PREFIX, SOURCE_TABLES, Layout
from quayside.contracts import FACTS, GOLD, SILVER, VALIDATE_RULES
from quayside.operators.diff import layer_diff
from quayside.operators.facts import order_fulfillment
from quayside.operators.gate import DataQualityError, for_run
from quayside.operators.layers import inject_receipt_before_ship
from quayside.operators.ledger import STEPS, ResumeError, StaleResultsError
from quayside.operators.reports import ContractError
from quayside.plans import full_run
from quayside.plans.analysis import analyse
from quayside.plans.full_run import CHECKS, RUNS, results_of, run_all, run_silver
from quayside.sources.fixtures import source_tables
from quayside.sources.readers import CatalogSource, ParquetSource, read_source
from quayside.sources.store import Store

FAULT = {"lineitem": inject_receipt_before_ship}


@pytest.fixture(scope="module")
def source(spark, small, tmp_path_factory):
    root = tmp_path_factory.mktemp("source")
    for name, df in source_tables(spark, small).items():
        df.write.parquet(f"{root}/{name}.parquet")
    return ParquetSource(str(root), label="samples.small")


@pytest.fixture(scope="module")
def done(spark, source):
    store = Store(spark, Layout(prefix="full"))
    return store, run_all(spark, store, source)


def test_success(done):
    store, run = done
    results = results_of(run).collect()
    assert len(results) == 43 and all(r.passed for r in results)
    assert {r.rule_id for r in results} >= set(VALIDATE_RULES)
    events = for_run(store.read("audit", RUNS), run.run_id).orderBy("event_ts").collect()
    assert [r.event for r in events] == ["started", *STEPS, "succeeded"]
    assert all(store.exists("silver", t) for t in SILVER) and all(store.exists("gold", t) for t in GOLD)
    answers = analyse(store)
    assert answers["q4_verdict"].first().verdict in ("faster", "slower", "tie")
    assert answers["answers_text"].count() == 6


def test_tables_carry_their_constraints(spark, done):
    store, _ = done
    properties = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {store.name('silver', 'lineitem')}").collect()}
    assert properties["constraint.lineitem_orders_fk"] == "FOREIGN KEY (l_orderkey) REFERENCES orders (o_orderkey)"
    assert properties["constraint.lineitem_receipt_after_ship"] == "CHECK (l_receiptdate >= l_shipdate)"


def test_second_run_is_retained_and_equal(spark, done, source):
    store, first = done
    before = {t: store.read("gold", t).collect() for t in GOLD}
    second = run_all(spark, store, source)
    assert second.run_id != first.run_id
    for table, rows in ((CHECKS, 43), (RUNS, 2 + len(STEPS))):
        audit = store.read("audit", table)
        assert for_run(audit, first.run_id).count() == for_run(audit, second.run_id).count() == rows
    after = {t: spark.createDataFrame(rows, store.read("gold", t).schema) for t, rows in before.items()}
    assert all(r.unchanged for r in layer_diff(store.read_all("gold", GOLD), after).collect())


def test_other_prefix_gives_the_same_gold(spark, done, source):
    store, _ = done
    other = Store(spark, Layout(prefix="elsewhere"))
    run_all(spark, other, source)
    assert all(r.unchanged for r in layer_diff(store.read_all("gold", GOLD), other.read_all("gold", GOLD)).collect())


def test_injected_fault_stops_the_run(spark, done, source):
    store = Store(spark, Layout(prefix="faulty"))
    run_all(spark, store, source)
    gold = {t: spark.createDataFrame(store.read("gold", t).collect(), store.read("gold", t).schema) for t in GOLD}
    store.snapshot("silver", SILVER)
    with pytest.raises(DataQualityError, match="DQ-L2 failed"):
        run_all(spark, store, source, FAULT)
    newest = store.read("audit", RUNS).orderBy("event_ts", ascending=False).first()
    assert newest.event == "staged"
    failed = for_run(store.read("audit", CHECKS), newest.run_id).where("NOT passed").collect()
    first = store.read("silver", "lineitem").orderBy("l_orderkey", "l_linenumber").first()
    assert [(r.rule_id, r.violation_count, r.sample_keys) for r in failed] == [
        ("DQ-L2", 1, f'["{first.l_orderkey}|{first.l_linenumber}"]')
    ]
    unchanged = layer_diff(store.read_all("silver", SILVER), store.read_all("snapshot", SILVER)).collect()
    assert len(unchanged) == 11 and all(r.unchanged for r in unchanged)
    assert all(r.unchanged for r in layer_diff(store.read_all("gold", GOLD), gold).collect())
    with pytest.raises(StaleResultsError, match="stale"):
        analyse(store)
    # Silver alone can be brought back; it leaves no ledger events
    events = store.read("audit", RUNS).count()
    run_silver(spark, store, source)
    assert store.read("audit", RUNS).count() == events
    store.drop_layers(["snapshot"])
    assert not store.exists("snapshot", "orders")


def test_missing_source_leaves_started_only(spark, tmp_path):
    store = Store(spark, Layout(prefix="nosource"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        run_all(spark, store, ParquetSource(str(tmp_path)))
    assert [r.event for r in store.read("audit", RUNS).collect()] == ["started"]
    with pytest.raises(StaleResultsError):
        analyse(store)


def test_failed_gold_check_keeps_the_previous_gold(spark, done, monkeypatch):
    store, _ = done
    run = full_run.start(spark, store, None)
    monkeypatch.setitem(
        full_run.FACT_BUILDERS, "fct_order_fulfillment",
        lambda lines, orders: order_fulfillment(lines, orders).where("order_key > 0").limit(5),
    )
    before = {t: store.read("gold", t).count() for t in GOLD}
    with pytest.raises(DataQualityError, match="DQ-GOLD2"):
        full_run.build_gold(run)
    assert {t: store.read("gold", t).count() for t in GOLD} == before
    shown = {r.tableName for r in spark.sql(f"SHOW TABLES IN {store.layout.schema('gold')}").collect()}
    assert shown == {*GOLD, full_run.HISTOGRAMS}


def test_store(spark):
    store = Store(spark, Layout(prefix="unit"))
    store.ensure("audit", "t", "a int")
    store.append(spark.createDataFrame([(1,)], "a int"), "audit", "t")
    store.ensure("audit", "t", "a int")  # keeps the row
    store.append(spark.createDataFrame([(2,)], "a int"), "audit", "t")
    assert store.read("audit", "t").count() == 2
    store.replace(store.read("audit", "t").where("a = 2"), "audit", "t")  # reads the table it replaces
    assert [r.a for r in store.read("audit", "t").collect()] == [2]
    with pytest.raises(Exception):
        store.replace(store.read("audit", "t").selectExpr("raise_error('x') AS a"), "audit", "t")
    assert [r.a for r in store.read("audit", "t").collect()] == [2]
    assert not store.exists("audit", "other")


def test_a_failed_check_or_rename_keeps_every_old_table(spark, monkeypatch):
    store = Store(spark, Layout(prefix="swapped"))
    old = {t: spark.createDataFrame([(t, 1)], "name string, n int") for t in ("a", "b")}
    new = {t: spark.createDataFrame([(t, 2)], "name string, n int") for t in ("a", "b")}
    store.replace_all(old, "gold")

    def unchanged():
        shown = {r.tableName for r in spark.sql(f"SHOW TABLES IN {store.layout.schema('gold')}").collect()}
        return shown == {"a", "b"} and all(store.read("gold", t).first() == (t, 1) for t in old)

    def refuse(pending, seen):
        assert seen == {"a": {"rows": 1}, "b": {"rows": 1}}
        assert pending["b"].first().n == 2
        raise ValueError("no")

    with pytest.raises(ValueError):
        store.replace_all(new, "gold", refuse)
    assert unchanged()
    rename, calls = store._rename, []

    def failing(source, target):
        calls.append(source)
        if len(calls) == 4:  # the first table is replaced, the second one has stepped aside
            raise RuntimeError("catalog lost")
        rename(source, target)

    monkeypatch.setattr(store, "_rename", failing)
    with pytest.raises(RuntimeError):
        store.replace_all(new, "gold")
    assert unchanged()
    monkeypatch.undo()
    store.write_new(new["a"], "gold", "a")  # what a lost driver leaves
    store._rename(store.name("gold", "b"), store.name("gold", "b") + "__aside_0123456789ab")
    store.sweep(["gold"])
    assert unchanged()
    store.replace_all(new, "gold")
    assert store.read("gold", "a").first().n == 2


def test_a_lost_run_goes_on(spark, done, source, monkeypatch):
    store, _ = done
    lost = Store(spark, Layout(prefix="lost"))
    with monkeypatch.context() as m:
        m.setattr(full_run, "validate", lambda run: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            run_all(spark, lost, source)
    run_id = lost.read("audit", RUNS).first().run_id
    with pytest.raises(StaleResultsError):
        analyse(lost)
    for name in ("ingest", "stage"):
        monkeypatch.setattr(full_run, name, lambda *_: pytest.fail("done already"))
    run = full_run.resume(spark, lost, source, run_id)
    assert run.run_id == run_id and len(results_of(run).collect()) == 43
    assert all(r.unchanged for r in layer_diff(lost.read_all("gold", GOLD), store.read_all("gold", GOLD)).collect())
    assert sorted(r.event for r in lost.read("audit", RUNS).collect()) == sorted(["started", *STEPS, "succeeded"])
    for known in (run_id, "another"):  # finished, and never begun
        with pytest.raises(ResumeError):
            full_run.resume(spark, lost, source, known)
    with pytest.raises(ResumeError):
        full_run.resume(spark, Store(spark, Layout(prefix="nowhere")), source, run_id)


def test_the_audit_log_is_safe_to_repeat_and_compact(spark, done, source):
    store, run = done
    before = {t: sorted(store.read("audit", t).collect()) for t in (CHECKS, RUNS)}
    full_run.record_event(run, "started")
    run.append_results(store.read("audit", CHECKS).where(F.col("run_id") == run.run_id).withColumn("violation_count", F.lit(7).cast("long")))
    assert {t: sorted(store.read("audit", t).collect()) for t in (CHECKS, RUNS)} == before
    assert len(store.read("audit", CHECKS).inputFiles()) > 1
    full_run.compact_audit(store)
    assert {t: sorted(store.read("audit", t).collect()) for t in (CHECKS, RUNS)} == before
    assert len(store.read("audit", CHECKS).inputFiles()) == 1 == len(store.read("audit", RUNS).inputFiles())
    for at in ("2020-01-01", "2020-02-01", "2020-02-02"):
        store.append(spark.sql(f"SELECT 'r' AS run_id, timestamp'{at}' AS run_ts"), "audit", "log")
    store.compact("audit", "log", F.trunc("run_ts", "month"))
    assert store.read("audit", "log").count() == 3 and len(store.read("audit", "log").inputFiles()) <= 2


def scans(spark, since, table):
    """Scans of a table that read any of its columns, in all queries after the execution ``since``."""
    plans = [e.physicalPlanDescription() for e in executions_since(spark, since)]
    found = [part for plan in plans for part in re.split(r"\n\n\n", plan) if re.search(rf"\) Scan parquet {table}\s", part)]
    return sum("ReadSchema: struct<>" not in part for part in found)


def test_publication_reads_each_table_once(spark, source):
    store = Store(spark, Layout(prefix="counted"))
    run = full_run.start(spark, store, source)
    for step in (full_run.ingest, full_run.stage, full_run.validate):
        step(run)
    before = last_execution(spark)
    full_run.publish(run)
    assert {t: scans(spark, before, re.escape(store.name("staging", t))) for t in SILVER} == dict.fromkeys(SILVER, 1)
    assert not store.observed and set(run.rows) == {"source", "bronze", "staging"}
    before = last_execution(spark)
    full_run.build_gold(run)
    for fact in FACTS:
        pending = re.escape(store.name("gold", fact)) + "__[0-9a-f]+"
        assert scans(spark, before, pending) == 1


def test_a_broken_constraint_is_seen_while_writing(spark, source, monkeypatch):
    store = Store(spark, Layout(prefix="refused"))
    run = full_run.start(spark, store, source)
    full_run.ingest(run)
    full_run.stage(run, {"orders": lambda df: df.withColumn("o_orderdate", F.expr("nullif(o_orderdate, date'1995-01-01')"))})
    nulls = store.read("staging", "orders").where("o_orderdate is null").count()
    monkeypatch.setattr(full_run, "raise_if_failed", lambda *_: None)
    with pytest.raises(ContractError, match=f"orders: o_orderdate NOT NULL broken by {nulls} rows"):
        full_run.publish(run)
    assert nulls and not store.exists("silver", "orders") and not store.observed
    assert spark.sql(f"SHOW TABLES IN {store.layout.schema('silver')}").count() == 0


def test_rows_are_counted_while_writing(spark):
    store = Store(spark, Layout(prefix="observed"), {"b": (3, ("n",))})
    rows = spark.range(1000).selectExpr("id AS n", "if(id % 4 = 0, null, id) AS m")
    for table, df, want in (("a", rows, (1000, 250)), ("b", rows, (1000, 250)), ("c", rows.where("n < 0"), (0, 0)), ("d", rows.limit(0), (0, 0)),
                            ("e", rows.groupBy("m").count().withColumnRenamed("count", "n"), (751, 1))):
        name = store.write_new(df, "gold", table, {"empty": F.count_if(F.col("m").isNull())})
        assert store.observed[name] == {"rows": want[0], "empty": want[1]}, table
        store.swap("gold", {table: name})
        assert store.read("gold", table).count() == want[0]


def test_default_prefix_is_protected(spark, source):
    store = Store(spark, Layout())
    assert store.layout.prefix == DEFAULT_PREFIX
    with pytest.raises(ValueError):
        store.drop_layers(["gold"])
    with pytest.raises(ValueError):
        store.snapshot("silver", [])
    with pytest.raises(ValueError):
        run_silver(spark, store, source, FAULT)


def test_names_are_plain():
    for bad in ("a-b", "a b", "a;drop", "", "a.b"):
        with pytest.raises(ValueError):
            Layout(prefix=bad)
        with pytest.raises(ValueError):
            Layout(catalog=bad)
    with pytest.raises(ValueError):
        CatalogSource.parse("samples")
    with pytest.raises(ValueError):
        CatalogSource.parse("samples.tpch.orders")
    with pytest.raises(ValueError):
        Layout().table("attic", "orders")
    assert Layout(prefix="p").table("staging", "orders") == "spark_catalog.p_staging.stg_orders"


def test_catalog_source(spark, done):
    store, _ = done
    source = CatalogSource.parse(store.layout.schema("bronze"))
    assert read_source(spark, source, "region").count() == 5
    assert source.label == "spark_catalog.full_bronze" and len(SOURCE_TABLES) == 8


def test_tables_bucketed_alike_join_without_a_shuffle(spark, source, small):
    buckets = {"lineitem": (4, ("l_orderkey",)), "orders": (4, ("o_orderkey",))}
    store = Store(spark, Layout(prefix="bucketed"), buckets)
    for table in ("lineitem", "orders"):
        store.replace(source.read(spark, table), "staging", table)
    lines, orders = store.read("staging", "lineitem"), store.read("staging", "orders")
    joined = lines.hint("merge").join(orders, lines.l_orderkey == orders.o_orderkey)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == lines.count()

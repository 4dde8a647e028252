"""Time the headline queries and the steps of full runs; prints one JSON line.

``BENCH_SF_DIR`` is the test data folder, ``BENCH_CPUS`` the number of local cores, ``BENCH_WORK`` the folder
for written sources and the warehouse (a new one in the temporary folder if unset), ``BENCH_COPIES`` the
larger volume. Every item runs to the end (every row and column, nothing collected), always twice for queries,
of which the better time counts, and once for the steps of a run.

The steps run over written inputs at two volumes: the source tables as they are, and with orders and lines
copied under shifted order keys. ``lines_per_second`` has the rate of every step at both volumes, to be held
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quayside.config import Layout, session  # noqa: E402
from quayside.contracts import SILVER  # noqa: E402
from quayside.operators import profiling  # noqa: E402
from quayside.operators.diff import layer_diff  # noqa: E402
from quayside.plans import full_run  # noqa: E402
from quayside.plans.analysis import analyse  # noqa: E402
from quayside.plans.registry import queries  # noqa: E402
from quayside.sources.fixtures import source_tables  # noqa: E402
from quayside.sources.readers import ParquetSource  # noqa: E402
from quayside.sources.store import Store  # noqa: E402

HEADLINE = (
    "fct_lineitem_delivery", "fct_order_fulfillment", "agg_ship_mode_performance", "agg_on_time_summary",
    "agg_on_time_by_line_count", "agg_priority_fulfillment", "agg_urgency_fulfillment", "agg_delay_rate_monthly",
    "q1_fastest", "q2_gap", "q3_worst", "q4_verdict", "monitor_summary", "stage_lineitem", "stage_part_quantity_price",
    "dq_report_clean", "dq_report_dirty", "profile_values", "profile_keys", "profile_fds", "profile_documented_rules",
    "layer_diff",
)


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def best(action) -> float:
    return min(timed(action), timed(action))


def copied(df: DataFrame, key: str, copies: int, shift: int) -> DataFrame:
    """``copies`` of every row, each under order keys of its own."""
    each = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")
    return df.select("*", each).withColumn(key, F.col(key) + F.col("copy").cast("long") * shift).drop("copy")


def run_steps(spark, store: Store, source: ParquetSource) -> dict[str, float]:
    """Seconds of each step of a run, of the analysis, a profile and a comparison of two layers."""
    run = full_run.start(spark, store, source)
    full_run.record_event(run, "started")
    steps = {name: timed(lambda f=f: f(run)) for name, f in (
        ("ingest", full_run.ingest), ("stage", full_run.stage), ("validate", full_run.validate),
        ("publish", full_run.publish), ("gold", full_run.build_gold),
    )}
    full_run.record_event(run, "succeeded")
    tables = run.source_tables()

    def to_noop(*frames: DataFrame) -> None:
        for df in frames:
            df.write.format("noop").mode("overwrite").save()

    steps["analysis"] = timed(lambda: to_noop(*analyse(store).values()))
    steps["profile"] = timed(lambda: to_noop(
        profiling.value_counts(tables["lineitem"], profiling.CATEGORIES), profiling.key_checks(tables),
        profiling.fd_checks(tables), profiling.documented_rules(tables)))
    steps["diff"] = timed(lambda: to_noop(layer_diff(store.read_all("silver", SILVER), store.read_all("staging", SILVER))))
    steps["full_run_and_answers"] = round(sum(v for k, v in steps.items() if k not in ("profile", "diff")), 3)
    return steps


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    copies = int(os.environ.get("BENCH_COPIES", "8"))
    home = os.environ.get("BENCH_WORK") or tempfile.mkdtemp(prefix="run-")
    spark = session(
        "bench", master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": f"{home}/warehouse",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    registered["stage_region"](spark, sf_dir).collect()  # the first job starts the JVM's threads

    def to_the_end(name: str) -> None:
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds = {name: best(lambda n=name: to_the_end(n)) for name in HEADLINE}

    keys = {"lineitem": "l_orderkey", "orders": "o_orderkey"}
    rates = {}
    for label, number in (("x1", 1), (f"x{copies}", copies)):
        for name, df in source_tables(spark, sf_dir).items():
            more = copied(df, keys[name], number, 10**9) if name in keys else df
            more.write.parquet(f"{home}/source_{label}/{name}.parquet")
        lines = spark.read.parquet(f"{home}/source_{label}/lineitem.parquet").count()
        steps = run_steps(spark, Store(spark, Layout(prefix=f"bench_{label}")), ParquetSource(f"{home}/source_{label}", label="samples.bench"))
        seconds |= {f"{step}_{label}": s for step, s in steps.items()}
        rates[label] = {"lines": lines} | {step: round(lines / s) for step, s in steps.items()}
    print(json.dumps({
        "metric": "sum of headline query times and the steps of two runs",
        "value": round(sum(s for name, s in seconds.items() if not name.startswith("full_run")), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "lines_per_second": rates,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

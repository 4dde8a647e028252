"""Tables that take a join or a grouping are made once, however many rules, diffs, answers or passes read them."""

import pytest

from quayside.operators import diff
from quayside.operators.quantiles import exact_percentiles
from quayside.plans import registry
from quayside.plans.registry import Inputs
from quayside.sources import fixtures


@pytest.fixture
def made(spark, tmp_path):
    """How often the rows of a frame are computed: tasks note every row that passes."""
    def counted(df, name):
        folder = str(tmp_path / name)

        def noted(batches):
            for batch in batches:
                with open(folder, "a") as log:
                    log.write("x" * batch.num_rows)
                yield batch

        return df.mapInArrow(noted, df.schema), lambda: len(open(folder).read())

    return counted


@pytest.fixture
def counted_lines(made, monkeypatch):
    """Counts the rows of source lines that are computed."""
    found = []

    def lines(spark, sf_dir, dirty=False, plain=fixtures._BUILDERS["lineitem"]):
        df, n = made(plain(spark, sf_dir, dirty), f"lines-{dirty}")
        found.append(n)
        return df

    monkeypatch.setitem(fixtures._BUILDERS, "lineitem", lines)
    return lambda: found[0]()


def lines_of(spark, small):
    return fixtures.lineitem(spark, small).count()


def test_a_report_makes_clean_lines_once(spark, small, counted_lines):
    report = Inputs(spark, small).report(False).collect()
    assert len(report) == 41 and not any(r.violation_count for r in report)
    assert counted_lines() == lines_of(spark, small)


def test_percentiles_make_their_rows_once(spark, made):
    rows, computed = made(spark.range(60_000).selectExpr("cast(id % 3 as string) AS g", "cast(id * id AS double) AS v"), "numbers")
    found = {(r.g, r.share): r.v for r in exact_percentiles(rows, "v", (0.0, 0.5, 1.0), "g").withColumnRenamed("value", "v").collect()}
    assert len(found) == 9 and found["0", 1.0] == 59_997.0**2
    assert computed() == 60_000


@pytest.mark.parametrize("name", ("answers_text", "answers_text_dirty"))
def test_answers_read_one_histogram(spark, small, name, monkeypatch):
    plain, made = registry.histograms, []
    monkeypatch.setattr(registry, "histograms", lambda *args: made.append(args) or plain(*args))
    assert len(registry.queries()[name](spark, small).collect()) == 6
    assert len(made) == 1


def test_a_layer_diff_makes_clean_lines_once(spark, small, counted_lines):
    assert len(registry.queries()["layer_diff"](spark, small).collect()) == 11
    assert counted_lines() == lines_of(spark, small)


def test_equal_rows_of_two_tables_are_netted_apart(spark):
    rows = [spark.range(n).selectExpr("id % 40 AS k") for n in (100, 130, 0)]
    found = diff.layer_diff({"a": rows[0], "b": rows[1], "c": rows[2]}, {"a": rows[1], "b": rows[0], "c": rows[2]})
    assert [tuple(r) for r in found.collect()] == [("a", 0, 30, False), ("b", 30, 0, False), ("c", 0, 0, True)]

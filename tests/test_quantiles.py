"""Exact percentiles against whole sorted groups."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.operators import quantiles

SHARES = (0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0)


def wanted(values, share):
    values = sorted(values)
    at = share * (len(values) - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


@pytest.mark.parametrize(("few", "splits"), ((20_000, 512), (0, 512), (3, 2), (0, 3)))
def test_percentiles_equal_sorted_rows(spark, monkeypatch, few, splits):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "SPLITS", splits)
    rng = np.random.default_rng(4)
    groups = {
        "even": rng.integers(0, 1000, 400).astype(float).tolist(), "wide": (rng.normal(size=300) ** 9 * 1e6).tolist(), "one": [7.5], "same": [2.0] * 50,
        None: [-1e308, 1e308, 0.0, 1.0], "hot": [5.0] * 900 + rng.random(100).tolist(),
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("none", None), ("even", None), ("even", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").selectExpr("*", "1 AS nr", "'x' AS value", "2 AS place").repartition(7)
    found = {(r.g, r.share): (r.n, r["value"]) for r in quantiles.exact_percentiles(df, "v", SHARES, "g").collect()}
    assert set(found) == {(g, s) for g in groups for s in SHARES}
    for (g, share), (n, value) in found.items():
        assert n == len(groups[g]) and value == pytest.approx(wanted(groups[g], share), rel=1e-12)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "g int, v decimal(18,2)")
    assert quantiles.exact_percentiles(empty, "v", SHARES, "g").collect() == []
    assert quantiles.exact_percentiles(empty, "v", SHARES, "g").dtypes == [("g", "int"), ("share", "double"), ("n", "bigint"), ("value", "double")]


def test_only_two_columns_are_read(spark, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    found = quantiles.exact_percentiles(lines.withColumn("p", F.col("l_extendedprice")), "p", (0.5,), "l_returnflag").collect()
    direct = {r.l_returnflag: r.m for r in lines.groupBy("l_returnflag").agg(F.percentile("l_extendedprice", 0.5).alias("m")).collect()}
    assert {r.l_returnflag: r["value"] for r in found} == pytest.approx(direct)

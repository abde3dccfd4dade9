"""Exact quantiles equal DuckDB's; the sketch keeps its error and merges."""

import math
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import quantiles as Q

PS = (0, 1, 250, 500, 900, 950, 990, 999, 1000)


def values(seed=3):
    rng = random.Random(seed)
    rows = [("one", 4.5), ("two", -1.0), ("two", 1.0), ("nulls", None), ("nan", float("nan"))]
    rows += [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)) for _ in range(700)]
    rows += [("close", 1 + rng.randrange(400) * 2**-50) for _ in range(900)]
    rows += [("ties", float(rng.randrange(4))) for _ in range(500)] + [("zero", 0.0)] * 20
    rows += [(None, rng.random()) for _ in range(333)]
    rows += [("times", rng.lognormvariate(0, 2)) for _ in range(1000)] + [("small", i * 5e-324) for i in range(60)]
    return rows + [("ends", float("inf")), ("ends", float("-inf")), ("ends", 1.0)]


def want(rows):
    held = pd.DataFrame([r for r in rows if r[1] is not None and not math.isnan(r[1])], columns=["g", "v"])
    held["v"] = held["v"].astype(float)
    out = {}
    for p in PS:
        for g, v in duckdb.sql(f"SELECT g, quantile_disc(v, {p / 1000}) FROM held GROUP BY g").fetchall():
            out[None if g is None or g != g else g, p] = v
    return out


@pytest.mark.parametrize("error", [0.01, 0.2])
def test_exact(spark, error):
    rows = values()
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {(r.g, r.p): r.value for r in Q.exact(df, ["g"], "v", PS, error).collect()}
    assert got == want(rows)


def test_sketch_keeps_its_error_and_merges(spark):
    rows = values()
    df = spark.createDataFrame(rows, "g string, v double").withColumn("k", F.monotonically_increasing_id() % 3)
    whole = Q.sketch(df, ["g"], "v", 0.02)
    parts = Q.merge(Q.sketch(df.filter("k = 0"), ["g"], "v", 0.02), Q.sketch(df.filter("k > 0"), ["g"], "v", 0.02), ["g"])
    assert sorted(map(str, parts.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    exact = want(rows)
    got = {(r.g, r.p): r.value for r in Q.from_sketch(parts, ["g"], PS, 0.02).collect()}
    assert got.keys() == exact.keys()
    for k, v in exact.items():
        assert got[k] == v or abs(got[k] - v) <= 0.02 * abs(v) * (1 + 1e-9), (k, got[k], v)


def test_two_groups_and_nothing(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", 5.0)], "x int, y string, v double")
    got = {tuple(r) for r in Q.exact(df, ["x", "y"], "v", (500,)).collect()}
    assert got == {(1, "a", 500, 2, 1.0), (1, "b", 500, 1, 5.0)}
    assert Q.exact(df.limit(0), ["x"], "v").collect() == []
    assert [r.value for r in Q.exact(df, [], "v", (1000,)).collect()] == [5.0]


def test_values_are_never_sorted_or_collected(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    plan = Q.sketch(df, ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan and "collect" not in plan

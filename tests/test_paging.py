"""Pages by rank equal sorted slices; no task merges the rows before a page."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.paging import page


def rows_of(spark, n=400, seed=1):
    rng = random.Random(seed)
    day = dt.date(2001, 1, 1)
    rows = [(rng.choice([None, *range(-30, 30)]), rng.choice([None, day + dt.timedelta(rng.randrange(5))]),
             rng.choice([-2**63, 2**63 - 1, 0, 7]), f"r{i % 350}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "a int, d date, big long, name string").repartition(5)


ORDERS = [[("a", False), ("d", True)], [("d", True), ("a", False)], [("big", False), ("a", True)]]


@pytest.mark.parametrize("order", ORDERS, ids=str)
def test_pages(spark, order):
    rows, df = rows_of(spark)
    keys = [c for c, _ in order]
    at = {"a": 0, "d": 1, "big": 2}

    def place(r):
        out = []
        for c, up in order:
            v = r[at[c]]
            number = 0 if v is None else v.toordinal() if c == "d" else v
            out.append((v is not None, number) if up else (v is None, -number))
        return out

    want = sorted(rows, key=place)
    for offset, limit in ((0, 17), (100, 60), (399, 1)):
        got = page(df, order, offset, limit, heap_rows=0).collect()
        assert [tuple(r[c] for c in keys) for r in got] == [tuple(r[at[c]] for c in keys) for r in want[offset:offset + limit]]
        assert len(set(map(tuple, got)) - set(rows)) == 0
    assert page(df, order, 400, 5, heap_rows=0).collect() == []


def test_the_same_rows_each_time(spark):
    _, df = rows_of(spark)
    twice = [sorted(map(str, page(df.repartition(n), [("d", True)], 50, 40, heap_rows=0).collect())) for n in (2, 7)]
    assert twice[0] == twice[1]
    assert page(df.limit(0), [("a", True)], 0, 5, heap_rows=0).collect() == []


def test_equal_rows(spark):
    df = spark.createDataFrame([(1, "x")] * 50 + [(0, "y")] * 3 + [(2, "z")] * 4, "k int, v string").repartition(4)
    for offset, limit, want in ((0, 10, [0] * 3 + [1] * 7), (10, 20, [1] * 20), (50, 7, [1] * 3 + [2] * 4), (52, 3, [1, 2, 2])):
        assert [r.k for r in page(df, [("k", True)], offset, limit, heap_rows=0).collect()] == want


def test_other_keys(spark):
    df = spark.range(100).select(F.expr("cast(id / 4 as decimal(10,2))").alias("m"), (F.col("id") % 2 == 0).alias("b"),
                                 F.timestamp_seconds(F.col("id") * 1000).alias("t"))
    assert [float(r.m) for r in page(df, [("m", False)], 5, 3, heap_rows=0).collect()] == [23.5, 23.25, 23.0]
    assert [r.m for r in page(df, [("b", True), ("t", True)], 49, 2, heap_rows=0).collect()] == \
        [r.m for r in df.orderBy("b", "t").offset(49).limit(2).collect()]
    text = df.withColumn("s", F.col("m").cast("string"))
    assert page(text, [("s", True)], 5, 3, heap_rows=0).collect() == text.orderBy("s").offset(5).limit(3).collect()


def test_deep_page_merges_nothing(spark):
    """10^7 rows before the page and in it: a filter and a range sort."""
    n = 10**7
    df = spark.range(0, 3 * n, 1, 16).select(((F.col("id") * 7919) % (3 * n)).alias("k"), "id")
    deep = page(df, [("k", True)], n, n)
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in plan and "TakeOrdered" not in plan and "SinglePartition" not in plan
    assert "rangepartitioning" in plan
    got = deep.agg(F.min("k"), F.max("k"), F.count("k")).first()
    assert tuple(got) == (n, 2 * n - 1, n)
    few = page(df, [("k", True)], 10, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" in few

"""G7 by rounds equals inserting the rows one after the other."""

import random

from pyspark.sql import functions as F

from tessera.operators import datagen as G

SHAPE = "sample_id long, table_name string, row_i int, col_pos int, col_name string, col_type string, is_unique boolean, value string"


def cells(spark, tables):
    """tables: {(id, name): rows of values}, all columns unique."""
    rows = [(i, t, r, p, f"c{p}", "TEXT", True, v) for (i, t), vs in tables.items() for r, row in enumerate(vs, 1) for p, v in enumerate(row, 1)]
    return spark.createDataFrame(rows, SHAPE).repartition(5)


def sequential(rows):
    taken, n = set(), 0
    for row in rows:
        keys = {(p, v) for p, v in enumerate(row) if v is not None}
        if not keys & taken:
            taken |= keys
            n += 1
    return n


def inserted(df):
    return {(r.sample_id, r.table_name): r.rows_inserted for r in G.unique_insert(df).collect()}


def test_many_tables(spark):
    rng = random.Random(5)
    tables = {}
    for i in range(40):
        cols, n = rng.randint(1, 4), rng.randint(1, 25)
        pool = [None, *map(str, range(rng.choice([2, 5, 12, 40])))]
        tables[i % 7, f"t{i}"] = [tuple(rng.choice(pool) for _ in range(cols)) for _ in range(n)]
    assert inserted(cells(spark, tables)) == {k: sequential(v) for k, v in tables.items()}


def test_a_chain_of_waiting_rows(spark):
    """Row k shares a value with row k - 1 and one with row k + 1: every other row."""
    chain = [(f"a{k // 2}", f"b{(k + 1) // 2}") for k in range(12)]
    assert inserted(cells(spark, {(1, "t"): chain})) == {(1, "t"): 6}
    assert inserted(cells(spark, {(1, "t"): [(None, None)] * 5 + [("x", None)] * 3})) == {(1, "t"): 6}


def test_a_long_table(spark):
    """One table, three unique columns, one value held by a third of all rows."""
    n = 100_000
    h = [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m)) for k, m in ((1, 60_000), (2, 80_000), (3, 50_000))]
    h[2] = F.when(F.col("id") % 3 == 1, F.lit(-1)).otherwise(h[2])
    rows = spark.range(1, n + 1).select(F.col("id").cast("int").alias("row_i"), *[x.cast("string").alias(f"v{k}") for k, x in enumerate(h)])
    long = rows.select(F.lit(1).cast("bigint").alias("sample_id"), F.lit("t").alias("table_name"), "row_i",
                       F.posexplode(F.array("v0", "v1", "v2")).alias("p", "value")) \
        .select("sample_id", "table_name", "row_i", (F.col("p") + 1).alias("col_pos"), F.lit("c").alias("col_name"),
                F.lit("TEXT").alias("col_type"), F.lit(True).alias("is_unique"), "value")
    want = sequential([(r.v0, r.v1, r.v2) for r in rows.orderBy("row_i").collect()])
    assert inserted(long) == {(1, "t"): want}

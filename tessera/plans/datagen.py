"""Bindings for sample-data generation (G1-G7) over the schemas declared
in ``samples.sql_context``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import datagen as G
from tessera.operators import ddl as D
from tessera.plans import register
from tessera.plans import fixtures as FX
from tessera.plans.ddl import _CTE

col = F.col
N_ROWS = G.WEB_ROWS

_VALUE, _RULE = G.value_expr()
CELLS_CTE = _CTE[:-1] + f""",
cells0 AS (SELECT c.*, col_pos = 1 AS first_col, {N_ROWS} AS n_rows, CAST(r.row_i AS INTEGER) AS row_i,
           {G.NAME_NORM.s} AS _n, {G.TYPE_NORM.s} AS _t
           FROM cols2 c, (SELECT unnest(generate_series(1, {N_ROWS})) AS row_i) r),
cells1 AS (SELECT *, {_RULE.s} AS rule FROM cells0),
cells AS (SELECT sample_id, table_name, row_i, col_pos, col_name, col_type, is_unique,
          rule, {_VALUE.s} AS value FROM cells1)
"""


def _cells(spark, d):
    cols = D.extract_columns(FX.samples(spark, d), "sql_context")
    return G.generate_rows(cols, N_ROWS)


@register("generate_rows", CELLS_CTE + "SELECT * FROM cells")
def generate_rows(spark, d):
    return _cells(spark, d)


@register("generate_keys", CELLS_CTE + "SELECT sample_id, table_name, row_i, col_name, value FROM cells WHERE rule = 'key'")
def generate_keys(spark, d):
    return _cells(spark, d).filter(col("rule") == "key").select("sample_id", "table_name", "row_i", "col_name", "value")


@register("generate_fk", CELLS_CTE + "SELECT sample_id, table_name, row_i, col_name, value FROM cells WHERE rule = 'foreign_key'")
def generate_fk(spark, d):
    return _cells(spark, d).filter(col("rule") == "foreign_key") \
        .select("sample_id", "table_name", "row_i", "col_name", "value")


@register("generate_value", CELLS_CTE + """SELECT rule, col_name, value, count(*) AS n_cells
FROM cells GROUP BY rule, col_name, value""")
def generate_value(spark, d):
    return _cells(spark, d).groupBy("rule", "col_name", "value").agg(F.count(F.lit(1)).alias("n_cells"))


@register("generate_dates", CELLS_CTE + """SELECT sample_id, table_name, row_i, col_name, value FROM cells
WHERE rule IN ('recent', 'date')""")
def generate_dates(spark, d):
    return _cells(spark, d).filter(col("rule").isin("recent", "date")) \
        .select("sample_id", "table_name", "row_i", "col_name", "value")


@register("generate_numeric", CELLS_CTE + """SELECT sample_id, table_name, row_i, col_name, value FROM cells
WHERE rule IN ('amount', 'int', 'float')""")
def generate_numeric(spark, d):
    return _cells(spark, d).filter(col("rule").isin("amount", "int", "float")) \
        .select("sample_id", "table_name", "row_i", "col_name", "value")


# In-order insertion of the fixture's 10 rows, worked out by hand: two UNIQUE
# columns of codes accept three rows, the five regions one row each.
@register("unique_insert", CELLS_CTE + """
SELECT sample_id, table_name, CASE table_name WHEN 'codes' THEN 3 WHEN 'regions_log' THEN 5 ELSE 10 END AS rows_inserted
FROM tb""")
def unique_insert(spark, d):
    return G.unique_insert(_cells(spark, d))

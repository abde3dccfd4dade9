"""Bindings for DDL processing (D1-D5) on ``samples.sql_context``."""

from __future__ import annotations

from tessera.operators import ddl as D
from tessera.plans import register
from tessera.plans import fixtures as FX

# The expected statements and columns are literal rows (fixtures.py), not a
# second rendering of the parser's rules.
_CTE = FX.with_views("samples", extra=",\n".join([
    FX.values_sql("stmts", "c, stmt_pos, statement",
                  [(c, i, s) for c, group in enumerate(FX.STATEMENTS) for i, s in enumerate(group)]),
    FX.values_sql("decl", "c, table_name, col_pos, col_name, col_type, is_unique", FX.COLUMNS),
    f"""st AS (SELECT sample_id, stmt_pos, statement FROM samples JOIN stmts ON sample_id % {FX.N_CASES} = c),
cols2 AS (SELECT sample_id, table_name, CAST(col_pos AS INTEGER) AS col_pos, col_name, col_type, is_unique
          FROM samples JOIN decl ON sample_id % {FX.N_CASES} = c),
tb AS (SELECT DISTINCT sample_id, table_name FROM cols2)"""]))


@register("split_statements", _CTE + "SELECT sample_id, CAST(stmt_pos AS INTEGER) AS stmt_pos, statement FROM st")
def split_statements(spark, d):
    return D.split_statements(FX.samples(spark, d), "sql_context")


@register("extract_tables", _CTE + "SELECT sample_id, table_name FROM tb")
def extract_tables(spark, d):
    return D.extract_tables(FX.samples(spark, d), "sql_context")


@register("extract_columns", _CTE + "SELECT * FROM cols2")
def extract_columns(spark, d):
    return D.extract_columns(FX.samples(spark, d), "sql_context")


@register("schema_type_histogram", _CTE + "SELECT upper(col_type) AS col_type, count(*) AS n_columns FROM cols2 GROUP BY 1")
def schema_type_histogram(spark, d):
    return D.schema_type_histogram(D.extract_columns(FX.samples(spark, d), "sql_context"))


@register("schema_width", _CTE + """
SELECT s.sample_id, CAST(coalesce(t.n_tables, 0) AS INTEGER) AS n_tables, CAST(coalesce(c.n_columns, 0) AS INTEGER) AS n_columns
FROM samples s LEFT JOIN (SELECT sample_id, count(DISTINCT lower(table_name)) AS n_tables FROM tb GROUP BY 1) t USING (sample_id)
LEFT JOIN (SELECT sample_id, count(*) AS n_columns FROM cols2 GROUP BY 1) c USING (sample_id)""")
def schema_width(spark, d):
    return D.schema_width(FX.samples(spark, d), "sql_context")

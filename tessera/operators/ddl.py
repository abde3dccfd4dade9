"""Schema (DDL) text processing (D1-D5) with row-local array functions.

A DDL text is parsed inside one row (split, regexp, higher-order functions), and
each distinct text once where texts repeat (``per_distinct_text``); the final
explode produces one row per statement / table / column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.nesting import split_top_level
from tessera.functions.text import strip
from tessera.operators.once import per_distinct_text

col = F.col
lit = F.lit

# ---------------------------------------------------------------- fixed values
# Leading words of a column-list entry that declare a table constraint.
CONSTRAINT_WORDS = ["PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "INDEX", "CONSTRAINT", "KEY"]
DEFAULT_TYPE = "TEXT"
# -----------------------------------------------------------------------------

CREATE_RE = r"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"]?(\w+)"
BODY_RE = r"(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"]?\w+[`\"]?\s*\((.*)\)"
QUOTES_RE = r"^[`\"\[\]]+|[`\"\[\]]+$"


def statements(ddl: Column) -> Column:
    """D1 as an array: stripped, non-empty statements between the ';' that
    stand outside quotes and parentheses."""
    return F.filter(F.transform(split_top_level(ddl, ";"), lambda s: strip(s)), lambda s: s != lit(""))


def _is_create(s: Column) -> Column:
    return F.upper(s).startswith("CREATE") & s.rlike(CREATE_RE)


def _column_entries(stmt: Column) -> Column:
    """array<struct<col_pos, col_name, col_type, is_unique>> of one CREATE
    TABLE statement: the parenthesised body split on top-level commas,
    constraint entries skipped, quotes stripped, type = 2nd token or TEXT."""
    body = F.regexp_extract(stmt, BODY_RE, 1)
    parts = F.filter(F.transform(split_top_level(body, ","), lambda p: strip(p)), lambda p: p != lit(""))

    def first_word(p):
        return F.regexp_replace(F.get(F.split(p, r"\s+"), 0), QUOTES_RE, "")

    kept = F.filter(parts, lambda p: ~F.upper(first_word(p)).isin(CONSTRAINT_WORDS))
    return F.transform(kept, lambda p, i: F.struct(
        (i + 1).alias("col_pos"),
        first_word(p).alias("col_name"),
        F.coalesce(F.get(F.split(p, r"\s+"), 1), lit(DEFAULT_TYPE)).alias("col_type"),
        F.upper(p).rlike(r"\bPRIMARY\s+KEY\b|\bUNIQUE\b").alias("is_unique")))


def schema_tables(ddl: Column) -> Column:
    """array<struct<table_name, columns>> for a DDL text."""
    creates = F.filter(statements(ddl), _is_create)
    return F.transform(creates, lambda s: F.struct(F.regexp_extract(s, CREATE_RE, 1).alias("table_name"),
                                                   _column_entries(s).alias("columns")))


def _parsed(df: DataFrame, ddl: str, key: str, make) -> DataFrame:
    """(key, _p): the parse of each DDL text, made once per distinct text."""
    return per_distinct_text(df.select(key, col(ddl).alias("_ddl")), "_ddl", make, "_p").select(key, "_p")


def split_statements(df: DataFrame, ddl: str, key: str = "sample_id") -> DataFrame:
    """One row per statement with its 0-based position."""
    return _parsed(df, ddl, key, statements).select(key, F.posexplode("_p").alias("stmt_pos", "statement"))


def extract_tables(df: DataFrame, ddl: str, key: str = "sample_id") -> DataFrame:
    """One row per CREATE TABLE (IF NOT EXISTS accepted)."""
    return _parsed(df, ddl, key, schema_tables).select(key, F.explode("_p").alias("t")).select(key, col("t.table_name"))


def extract_columns(df: DataFrame, ddl: str, key: str = "sample_id") -> DataFrame:
    """D3: one row per declared column (key, table, position, name, type)."""
    t = _parsed(df, ddl, key, schema_tables).select(key, F.explode("_p").alias("t"))
    return t.select(key, col("t.table_name").alias("table_name"), F.inline(col("t.columns")))


def schema_type_histogram(columns: DataFrame) -> DataFrame:
    """Column count per upper-cased declared type."""
    return columns.groupBy(F.upper("col_type").alias("col_type")).agg(F.count(lit(1)).alias("n_columns"))


def schema_width(df: DataFrame, ddl: str, key: str = "sample_id") -> DataFrame:
    """Tables and columns per sample, computed inside each row."""
    t = col("_p")
    return _parsed(df, ddl, key, schema_tables).select(
        key, F.size(F.array_distinct(F.transform(t, lambda x: F.lower(x["table_name"])))).alias("n_tables"),
        F.size(F.flatten(F.transform(t, lambda x: x["columns"]))).alias("n_columns"))

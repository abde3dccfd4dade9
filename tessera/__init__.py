"""tessera: a Spark-native engine for natural-language-to-SQL corpus,
response and evaluation work, plus the analytic query shapes such systems
are asked for.

Subpackages
-----------
sources    readers and writers (parquet tables, JSON lines, result sinks)
functions  Column-level building blocks (text, SQL-text, dates, dialect)
operators  DataFrame -> DataFrame operators (corpus, profile, ddl, datagen,
           responses, evaluate, analytics)
plans      bindings of operators onto the driver tables, with the DuckDB
           oracle SQL for each
streaming  Structured Streaming variants of batch operators
"""

from tessera.session import get_session, AS_OF  # noqa: F401

"""Statements with hand-written results for R10, R11, R12 and E17: names in
their scopes, all kinds of joins, comments and quotes, clauses in another order.
Each document carries one of them (``doc_id`` modulo their number)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.operators import evaluate as EV
from tessera.operators import responses as R
from tessera.plans import fixtures as FX
from tessera.plans import register
from tessera.sources.tables import table

col = F.col
DDL = "CREATE TABLE trips (id INT, day DATE); CREATE TABLE app.\"stops\" (id INT, place TEXT);"
# statement, unknown tables, the statement without joins to them
SCOPES = [
    ("SELECT EXTRACT(YEAR FROM day) FROM trips, ghosts", ["ghosts"], None),
    ("SELECT * FROM trips t RIGHT OUTER JOIN ghosts g ON t.id = g.id WHERE g.x = 1", ["ghosts"],
     "SELECT * FROM trips t WHERE x = 1"),
    ("WITH ghosts AS (SELECT id FROM trips) SELECT g.id FROM ghosts g JOIN phantoms p ON p.id = g.id", ["phantoms"],
     "WITH ghosts AS (SELECT id FROM trips) SELECT g.id FROM ghosts g"),
    ("WITH trips AS (SELECT * FROM trips) SELECT * FROM trips", [], None),
    ("SELECT * FROM (WITH near AS (SELECT * FROM trips) SELECT * FROM near) a JOIN near b ON a.id = b.id", ["near"],
     "SELECT * FROM (WITH near AS (SELECT * FROM trips) SELECT * FROM near) a"),
    ("SELECT t.id FROM trips t FULL JOIN ghosts g ON g.id = t.id CROSS JOIN phantoms NATURAL LEFT JOIN stops s", ["ghosts", "phantoms"],
     "SELECT t.id FROM trips t NATURAL LEFT JOIN stops s"),
    ("SELECT id FROM trips WHERE day IS DISTINCT FROM past AND id IS NOT DISTINCT FROM 3", [], None),
    ("SELECT g.id FROM trips g WHERE EXISTS (SELECT 1 FROM stops s JOIN ghosts g ON g.id = s.id WHERE g.x > 0)", ["ghosts"],
     "SELECT g.id FROM trips g WHERE EXISTS (SELECT 1 FROM stops s WHERE x > 0)"),
    ("SELECT \"g\".\"x\", t.id FROM app.trips t LEFT JOIN app.`Ghost Towns` AS \"g\" ON \"g\".id = t.id;", ["ghost towns"],
     "SELECT \"x\", t.id FROM app.trips t;"),
    ("SELECT 'a JOIN b', id /* FROM nowhere */ FROM trips -- JOIN ghosts g ON 1\nWHERE id = 1", [], None),
    ("SELECT id, place FROM trips JOIN ghosts USING (id, day) JOIN stops s ON s.id = trips.id", ["ghosts"],
     "SELECT id, place FROM trips JOIN stops s ON s.id = trips.id"),
    ("WITH RECURSIVE up(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM up JOIN ghosts ON n < k) SELECT n FROM up", ["ghosts"],
     "WITH RECURSIVE up(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM up) SELECT n FROM up"),
    ("SELECT * FROM trips t LEFT ANTI JOIN ghosts g ON g.id = t.id ORDER BY t.id LIMIT 3", ["ghosts"],
     "SELECT * FROM trips t ORDER BY t.id LIMIT 3"),
    ("SELECT * FROM trips t, LATERAL (SELECT * FROM ghosts) q, explode(array(1, 2)) e", ["ghosts"], None),
    ("SELECT * FROM trips t JOIN ghosts g ON t.id = (SELECT max(id) FROM stops WHERE id IN (1, 2)), stops s", ["ghosts"],
     "SELECT * FROM trips t, stops s"),
    ("SELECT id FROM trips UNION (SELECT g.id FROM stops s INNER JOIN ghosts g ON s.id = g.id)", ["ghosts"],
     "SELECT id FROM trips UNION (SELECT id FROM stops s)"),
    ("WITH a AS (SELECT * FROM trips), b AS (SELECT * FROM a JOIN c ON a.id = c.id), c AS (SELECT * FROM b) SELECT * FROM c", ["c"],
     "WITH a AS (SELECT * FROM trips), b AS (SELECT * FROM a), c AS (SELECT * FROM b) SELECT * FROM c"),
    ("DELETE FROM ghosts WHERE id IN (SELECT t.id FROM trips t JOIN (stops s JOIN phantoms p ON p.id = s.id) ON s.id = t.id)",
     ["ghosts", "phantoms"], "DELETE FROM ghosts WHERE id IN (SELECT t.id FROM trips t JOIN (stops s) ON s.id = t.id)"),
]
# statement, canonical key
KEYS = [
    ("SELECT 'Abc' -- it's\n FROM T WHERE x = 'DEF'", "select 'Abc' from t where x = 'DEF'"),
    ("SELECT \"Col\"\"X\",  `Weird  Name` FROM T ;", "select \"Col\"\"X\", `Weird  Name` from t"),
    ("/* it's a note */ Select 'O''Brien  &  Co' As N From T;;\n", "select 'O''Brien  &  Co' as n from t"),
    ("SELECT a-b, c/d FROM T", "select a-b, c/d from t"),
    ("SELECT 'open FROM T", "select 'open from t"),
    ("SELECT 1 /* one */ /* two */ -- three\n  , '--no', '/*no*/' FROM T", "select 1 , '--no', '/*no*/' from t"),
    ("  -- only a comment", ""),
]
# generated, expected, same text, same clauses as sets
PAIRS = [
    ("SELECT a, b FROM t", "select a,  b from t;", True, True),
    ("SELECT b, a FROM t", "SELECT a, b FROM t", False, True),
    ("SELECT a FROM t WHERE y = 2 AND x BETWEEN 1 AND 3", "SELECT a FROM t WHERE x BETWEEN 1 AND 3 AND y = 2", False, True),
    ("SELECT a FROM t WHERE x = 1 OR y = 2", "SELECT a FROM t WHERE x = 1 AND y = 2", False, False),
    ("SELECT a, count(*) FROM t GROUP BY a, b HAVING count(*) > 1", "SELECT count(*), a FROM t GROUP BY b, a HAVING count(*) > 1", False, True),
    ("SELECT a FROM t ORDER BY a, b", "SELECT a FROM t ORDER BY b, a", False, False),
    ("SELECT a FROM t, u WHERE t.i = u.i", "SELECT a FROM u, t WHERE t.i = u.i", False, True),
    ("SELECT DISTINCT a FROM t", "SELECT a FROM t", False, False),
    ("SELECT f(a, b) FROM t", "SELECT f(b, a) FROM t", False, False),
    ("SELECT a FROM t WHERE s = 'X'", "SELECT a FROM t WHERE s = 'x'", False, False),
    ("SELECT a, a FROM t", "SELECT a FROM t", False, False),
    ("SELECT b, a FROM t UNION SELECT d, c FROM u", "SELECT a, b FROM t UNION SELECT c, d FROM u", False, True),
    ("SELECT a FROM t LIMIT 3", "SELECT a FROM t LIMIT 4", False, False),
]


def cases(spark: SparkSession, d: str, rows: list[tuple]) -> DataFrame:
    """(sample_id, domain, fields of its case)."""
    k = col("doc_id") % len(rows)
    fields = [FX._pick(k, [r[i] for r in rows]).alias(f"c{i}") for i in range(2)]
    return table(spark, d, "documents").select(col("doc_id").alias("sample_id"), col("source").alias("domain"), *fields)


def _given(name: str, columns: str, rows) -> str:
    return "WITH " + FX.values_sql(name, columns, rows)


def _sample(n: int) -> str:
    return f"documents JOIN g ON doc_id % {n} = k"


@register("schema_grounding_scopes", _given("g", "k, table_name", [(k, t) for k, c in enumerate(SCOPES) for t in c[1]]) + f"""
SELECT doc_id AS sample_id, table_name FROM {_sample(len(SCOPES))}""")
def schema_grounding_scopes(spark, d):
    s = cases(spark, d, [(c[0], DDL) for c in SCOPES])
    return R.schema_grounding(s.select("sample_id", "c0", "c1"), "c0", "c1")


@register("drop_ungrounded_joins_scopes", _given("g", "k, grounded_sql", [(k, c[2] or c[0]) for k, c in enumerate(SCOPES)]) + f"""
SELECT doc_id AS sample_id, grounded_sql FROM {_sample(len(SCOPES))}""")
def drop_ungrounded_joins_scopes(spark, d):
    s = cases(spark, d, [(c[0], DDL) for c in SCOPES])
    return R.drop_ungrounded_joins(s, "c0", "c1").select("sample_id", "grounded_sql")


@register("normalize_sql_quotes", _given("g", "k, sql_key", [(k, c[1]) for k, c in enumerate(KEYS)]) + f"""
SELECT doc_id AS sample_id, sql_key FROM {_sample(len(KEYS))}""")
def normalize_sql_quotes(spark, d):
    return cases(spark, d, KEYS).select("sample_id", TX.normalize_sql(col("c0")).alias("sql_key"))


@register("expected_set_match", _given("g", "k, same_text, same_clauses", [(k, c[2], c[3]) for k, c in enumerate(PAIRS)]) + f"""
SELECT source AS domain, count(*) AS n_cases, count(*) FILTER (WHERE same_text) AS n_exact_match,
 count(*) FILTER (WHERE same_clauses) AS n_set_match,
 round(count(*) FILTER (WHERE same_text) / count(*), 6) AS exact_match_rate,
 round(count(*) FILTER (WHERE same_clauses) / count(*), 6) AS set_match_rate FROM {_sample(len(PAIRS))} GROUP BY source""")
def expected_set_match(spark, d):
    return EV.expected_set_match(cases(spark, d, PAIRS), "c0", "c1", "domain")

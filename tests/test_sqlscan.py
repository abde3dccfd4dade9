"""Names in their scopes, joins dropped, keys and clause sets, all literal."""

import random

import pytest
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import functions as F

from tessera.functions import sqlscan as S
from tessera.functions import text as TX
from tessera.operators import responses as R
from tessera.plans import sqlcases as C

KNOWN = {"trips", "stops"}


@pytest.mark.parametrize("sql,unknown,repaired", C.SCOPES)
def test_scopes(sql, unknown, repaired):
    assert [t for t in S.referenced_tables(sql) if t not in KNOWN] == unknown
    assert S.drop_joins(sql, KNOWN) == (repaired or sql)


def test_repaired_statements_parse(spark):
    """What the session's parser accepts before, it accepts after."""
    def parses(sql):
        try:
            spark.sql(sql.rstrip("; "))
        except ParseException:
            return False
        except AnalysisException:          # parsed, but the tables do not exist
            pass
        return True

    heads = ["SELECT {p}.x, t.id FROM trips t", "SELECT {p}.* FROM trips t", "SELECT count({p}.x) AS n FROM trips t JOIN stops s ON s.id = t.id"]
    kinds = ["JOIN", "INNER JOIN", "LEFT JOIN", "LEFT OUTER JOIN", "RIGHT JOIN", "RIGHT OUTER JOIN", "FULL JOIN", "FULL OUTER JOIN",
             "CROSS JOIN", "NATURAL JOIN", "NATURAL LEFT OUTER JOIN", "LEFT SEMI JOIN", "LEFT ANTI JOIN", "SEMI JOIN", "ANTI JOIN"]
    tables = [("ghosts", "ghosts"), ("ghosts g", "g"), ("ghosts AS g", "g"), ("db.ghosts g", "g"), ("`gh osts` `g`", "`g`")]
    ons = [" ON {p}.id = t.id", " USING (id)", " ON {p}.id IN (SELECT id FROM stops)", ""]
    tails = ["", " WHERE {p}.x > 1", " GROUP BY t.id", " ORDER BY t.id LIMIT 3", ", stops z", " JOIN stops y ON y.id = {p}.id",
             " UNION ALL SELECT 1, 2 FROM stops"]
    n = 0
    rng = random.Random(1)
    for _ in range(120):
        head, kind, (tab, p), on, tail = (rng.choice(x) for x in (heads, kinds, tables, ons, tails))
        sql = f"{head} {kind} {tab}{on}{tail}".format(p=p)
        got = S.drop_joins(sql, KNOWN)
        assert "ghosts" not in got and "gh osts" not in got, (sql, got)
        if parses(sql):
            n += 1
            assert parses(got), (sql, got)
    assert n > 40
    with pytest.raises(ParseException):
        spark.sql("SELECT * FROM trips t RIGHT OUTER WHERE x = 1")


def test_any_text_is_scanned():
    """No text makes the scan fail, and a text without unknown joins stays as it is."""
    rng = random.Random(4)
    bits = ["SELECT", "FROM", "JOIN", "LEFT", "ON", "WITH", "AS", "(", ")", ",", ".", ";", "a", "b", "'x", "'", "\"q\"", "`r`", "--", "/*", "*/",
            "\n", "UNION", "WHERE", "IS", "DISTINCT", "RECURSIVE", "LATERAL", "GROUP BY", "1", "é", "USING", "="]
    for _ in range(3000):
        sql = rng.choice(["", " "]).join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        names = S.referenced_tables(sql)
        assert S.drop_joins(sql, set(names) | {r.table for r in S.Scan(sql).references}) == sql
        S.drop_joins(sql, set())
        S.clause_key(sql)


def test_long_statements():
    sql = "SELECT " + ", ".join(f"t.c{i}" for i in range(20_000)) + " FROM trips t " + "(" * 3000
    assert S.referenced_tables(sql) == ["trips"]
    joins = "SELECT 1 FROM trips t" + "".join(f" JOIN g{i} ON g{i}.id = t.id" for i in range(300))
    assert S.drop_joins(joins, KNOWN) == "SELECT 1 FROM trips t"


@pytest.mark.parametrize("a,b,text,clauses", C.PAIRS)
def test_clause_sets(a, b, text, clauses):
    assert (S.clause_key(a) == S.clause_key(b)) == clauses


def test_clause_key_ignores_writing_only():
    assert S.clause_key("select  A ,b from T -- x\n where s='X' ;") == S.clause_key("SELECT b, a FROM t WHERE s = 'X'")
    assert S.clause_key("SELECT a FROM t WHERE s = 'X'") != S.clause_key("SELECT a FROM t WHERE s = 'x'")
    assert S.clause_key("UPDATE t SET a = 1") == S.clause_key("update t set a=1;")
    assert S.clause_key("") == "" and S.clause_key("SELECT a FROM t, u") != S.clause_key("SELECT a FROM t JOIN u")


def test_keys(spark):
    rows = spark.createDataFrame([(s, k) for s, k in C.KEYS] + [(None, None)], "s string, want string").repartition(3)
    assert [r for r in rows.select("want", TX.normalize_sql(F.col("s")).alias("got")).collect() if r.want != r.got] == []
    long = "SELECT '" + "a  B" * 200_000 + "' FROM T"
    assert spark.createDataFrame([(long,)], "s string").select(TX.normalize_sql("s")).first()[0] == \
        "select '" + "a  B" * 200_000 + "' from t"


def test_operators_with_nulls(spark):
    df = spark.createDataFrame([(1, None, C.DDL), (2, "SELECT * FROM trips t JOIN x ON 1", None), (3, "SELECT * FROM Trips, x", C.DDL)],
                               "sample_id long, sql string, ddl string")
    got = {(r.sample_id, r.table_name) for r in R.schema_grounding(df, "sql", "ddl").collect()}
    assert got == {(2, "trips"), (2, "x"), (3, "x")}
    got = {r.sample_id: r.grounded_sql for r in R.drop_ungrounded_joins(df, "sql", "ddl").collect()}
    assert got == {1: None, 2: "SELECT * FROM trips t", 3: "SELECT * FROM Trips, x"}

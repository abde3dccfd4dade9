"""DDL parsing and sample-row generation cases."""

from pyspark.sql import functions as F

from tessera.operators import datagen as G
from tessera.operators import ddl as D
from tessera.operators.execution import run_sql_on_schema


def cols(spark, ddl):
    df = spark.createDataFrame([(1, ddl)], "sample_id long, sql_context string")
    return D.extract_columns(df, "sql_context")


def test_columns_decimal_and_constraints(spark):
    c = cols(spark, "CREATE TABLE IF NOT EXISTS t (price DECIMAL(10,2), `name` TEXT NOT NULL, x, "
                    "FOREIGN KEY (a, b) REFERENCES u(id, k), PRIMARY KEY (id))").collect()
    assert [(r.col_name, r.col_type) for r in c] == [("price", "DECIMAL(10,2)"), ("name", "TEXT"), ("x", "TEXT")]
    assert c[0].table_name == "t"


def _values(spark, ddl, n=10):
    cells = G.generate_rows(cols(spark, ddl), n)
    return {(r.col_name, r.row_i): (r.rule, r.value) for r in cells.collect()}


def test_generation_rules(spark):
    v = _values(spark, "CREATE TABLE t (appt_id INT, doctor_name TEXT, account_number TEXT, "
                       "customer_id INT, email TEXT, appointment_date DATETIME, usage INT)")
    assert v[("appt_id", 3)] == ("key", "3")                 # first *_id column is the key
    assert v[("doctor_name", 1)] == ("person_name", "Bob Smith")  # rule 3 shadows doctor rule
    assert v[("account_number", 1)] == ("quantity", "45")    # substring 'count'
    assert v[("customer_id", 10)][1] == "10"                 # FK cycle
    assert v[("email", 1)][1] == "bob@test.org"
    assert v[("appointment_date", 1)][1].endswith(" 10:30:00")  # DATETIME contains TIME
    assert v[("usage", 2)][0] == "age"                       # substring 'age'


def test_fk_cycle(spark):
    df = spark.createDataFrame([(i,) for i in (1, 10, 11)], "row_i int").withColumn("n_rows", F.lit(10))
    out = [r.v for r in df.select(G.istr(G.X(lambda: F.pmod(F.col("row_i") - 1, F.col("n_rows")) + 1, "")).c
                                  .alias("v")).collect()]
    assert out == ["1", "10", "1"]


def test_unique_insert_and_execution(spark):
    ddl = "CREATE TABLE users (id INT PRIMARY KEY, email VARCHAR(100) UNIQUE, status TEXT);"
    cells = G.generate_rows(cols(spark, ddl), 40)
    assert G.unique_insert(cells).first().rows_inserted == 30    # emails repeat after 30 rows
    df, q = run_sql_on_schema(spark, ddl, "SELECT count(*) AS n FROM users;", 40)
    assert df.first().n == 30


def test_columns_at_any_depth(spark):
    c = cols(spark, "CREATE TABLE t (status ENUM('a','b','c','d','e','f'), w INT DEFAULT (f(a, g(b, c))), "
                    "note TEXT DEFAULT 'x;y,z(', CHECK (w IN (1,2,3,4,5)), `last` DECIMAL(10,2))").collect()
    assert [(r.col_name, r.col_type) for r in c] == [("status", "ENUM('a','b','c','d','e','f')"), ("w", "INT"),
                                                     ("note", "TEXT"), ("last", "DECIMAL(10,2)")]


def test_statements_keep_quoted_semicolons(spark):
    df = spark.createDataFrame([(1, "CREATE TABLE a (x TEXT DEFAULT ';'); ; INSERT INTO a VALUES ('b;c')")], "sample_id long, s string")
    assert [r.statement for r in D.split_statements(df, "s").collect()] == \
        ["CREATE TABLE a (x TEXT DEFAULT ';')", "INSERT INTO a VALUES ('b;c')"]


def test_any_number_of_rows_and_any_key(spark):
    df = spark.createDataFrame([(10**15, "CREATE TABLE t (id INT, amount DOUBLE)")], "sample_id long, sql_context string")
    cells = G.generate_rows(D.extract_columns(df, "sql_context"), 1000)
    assert cells.filter("col_name = 'id'").count() == 1000 and G.row_count(1000) == 1000 and G.row_count(None) == 30


def test_every_value_rule_is_reached(spark, sf_small):
    from tessera.plans import fixtures as FX

    c = D.extract_columns(FX.samples(spark, sf_small), "sql_context")
    seen = {r.rule for r in G.generate_rows(c, 2).select("rule").distinct().collect()}
    assert {n for n, _, _ in G._rules()} | {"fallback"} == seen


def test_unique_insert_in_order(spark):
    rows = [(1, "t", i, p, f"c{p}", "TEXT", True, v) for i, vs in enumerate([("x", "1"), ("x", "2"), ("y", "2")], 1)
            for p, v in enumerate(vs, 1)]
    cells = spark.createDataFrame(rows, "sample_id long, table_name string, row_i int, col_pos int, col_name string, "
                                        "col_type string, is_unique boolean, value string")
    # the second row is skipped, so its '2' is free for the third
    assert G.unique_insert(cells).first().rows_inserted == 2


def test_dialect_at_any_depth_and_length(spark):
    from tessera.functions import dialect as DL

    cases = {
        "DATE_SUB(COALESCE(MAX(d), NOW()), INTERVAL 1 MONTH)": "(COALESCE(MAX(d), NOW()) - INTERVAL 1 MONTH)",
        "date_add(DATE_SUB(a, INTERVAL '2' DAY), INTERVAL \"3\" HOUR)": "((a - INTERVAL 2 DAY) + INTERVAL 3 HOUR)",
        "DATE_FORMAT(DATE(NOW()), '%Y %Y %Y')": "DATE_FORMAT(DATE(NOW()), 'yyyy yyyy yyyy')",
        "DATE_FORMAT(d, '%Y-%m-%dT%H:%i')": "DATE_FORMAT(d, \"yyyy-MM-dd'T'HH:mm\")",
        "strftime('%H:%M', f(a, b))": "date_format(f(a, b), 'HH:mm')",
        "DATE_SUB(a, 'not an interval')": "DATE_SUB(a, 'not an interval')",
        "DATE_SUB(never closed": "DATE_SUB(never closed", "a) DATE_SUB(b, INTERVAL 1 DAY)": "a) (b - INTERVAL 1 DAY)",
        "DATE_SUB(" + "prose " * 180_000: "DATE_SUB(" + "prose " * 180_000,
    }
    df = spark.createDataFrame(list(cases.items()), "q string, want string").repartition(3)
    assert [r for r in df.select("want", DL.dialect_normalize(F.col("q")).alias("got")).collect() if r.want != r.got] == []

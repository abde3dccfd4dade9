"""Literal unit cases (FIXTURES.md section 3) for the column functions."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates as DT
from tessera.functions import dialect as DL
from tessera.functions import text as TX
from tessera.operators import evaluate as EV
from tessera.operators import profile as P
from tessera.operators import responses as R


def one(spark, expr, value, typ="string"):
    df = spark.createDataFrame([(value,)], f"x {typ}")
    return df.select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,expected", [
    ("Here it is:\n```SQL\nSELECT 1;\n```\nbye", "SELECT 1;"),
    ("use withdrawn; ok", "withdrawn;"),
    ("none", None),
    ("```sql\n```", ""),
    ("a SELECT a\nFROM b; SELECT c;", "SELECT a\nFROM b;"),
])
def test_extract_sql(spark, text, expected):
    assert one(spark, TX.extract_sql, text) == expected


def test_validate_prefix_and_message(spark):
    assert one(spark, TX.is_valid_sql, "selected x") is True
    assert one(spark, TX.validation_message, "EXPLAIN x") == TX.BAD_START_MSG
    assert one(spark, TX.validation_message, "") == TX.EMPTY_MSG
    assert one(spark, TX.validation_message, "  with t as (select 1) select * from t") == TX.VALID_MSG
    assert one(spark, TX.statement_kind, " delete from t") == "DELETE"


def test_token_loop_threshold(spark):
    assert one(spark, TX.is_token_loop, "<|end|>" * 5) is False
    assert one(spark, TX.is_token_loop, "<|end|>" * 6) is True
    assert one(spark, TX.has_loop_marker, "x { end }<|end|>") is True
    assert one(spark, TX.response_health, "   ") == "empty"
    assert one(spark, TX.response_health, "a" * 1001) == "too_long"
    assert one(spark, TX.response_health, "<|end|>" * 4) == "end_loop"


@pytest.mark.parametrize("prompt,is_sql", [("please select rows", True), ("Find users", True),
                                           ("get me", True), ("hello", False)])
def test_fallback(spark, prompt, is_sql):
    out = one(spark, TX.fallback_response, prompt)
    assert (out == TX.FALLBACK_SQL_TEXT) == is_sql
    if not is_sql:
        assert out == TX.FALLBACK_ERROR_TEXT


def test_scrub_idempotent(spark):
    s = "\x1b[32mSELECT\x07 1\x1b[0m\n"
    once = one(spark, TX.scrub_control_chars, s)
    assert once == "SELECT 1\n"
    assert one(spark, TX.scrub_control_chars, once) == once


def test_normalize_sql_keeps_literals(spark):
    assert one(spark, TX.normalize_sql, "SELECT  Name FROM T WHERE x = 'AbC' ;") == \
        "select name from t where x = 'AbC'"


def test_word_count_and_strip(spark):
    assert one(spark, TX.word_count, "  a  b\tc\n") == 3
    assert one(spark, TX.strip, "\n x \t") == "x"


def test_keyword_status_thresholds(spark):
    df = spark.createDataFrame([("a b c d e f g", ["a", "b", "c", "d", "e", "f", "g", "x", "y", "z"])],
                               "response string, expected_keywords array<string>")
    k = EV.keyword_match(df).first()
    assert k.keyword_score == 0.7 and k.keywords_missing == ["x", "y", "z"]
    st = spark.range(1).select(EV.case_status(F.lit(True), F.lit(True), F.lit(True), F.lit(True),
                                              F.lit(0.7)).alias("s")).first().s
    assert st == "PASS"
    st = spark.range(1).select(EV.case_status(F.lit(True), F.lit(True), F.lit(True), F.lit(True),
                                              F.lit(0.69)).alias("s")).first().s
    assert st == "PARTIAL"


def test_deploy_status_exclusive(spark):
    df = spark.createDataFrame([("SELECT a FROM t;", 0.5), ("SELECT a FROM t;", 0.51)],
                               "response string, keyword_score double")
    assert [r.status for r in EV.deploy_status(df).collect()] == ["FAIL", "PASS"]


def test_upper_median(spark):
    df = spark.createDataFrame([("a",), ("a b",), ("a b c",), ("a b c d",)], "sql string")
    r = P.query_length_stats(df).first()
    assert (r.median_length, r.min_length, r.max_length, r.mean_length) == (3, 1, 4, 2.5)
    assert P.query_length_stats(df.limit(0)).count() == 0


def test_dialect_rules(spark):
    f = DL.dialect_normalize
    assert one(spark, f, "SELECT * FROM t LIMIT 10, 5") == "SELECT * FROM t LIMIT 5 OFFSET 10"
    assert one(spark, f, "SELECT DATE_SUB(NOW(), INTERVAL 30 DAY)") == "SELECT (NOW() - INTERVAL 30 DAY)"
    assert one(spark, f, "SELECT DATE_FORMAT(d, '%Y-%m') FROM t") == "SELECT DATE_FORMAT(d, 'yyyy-MM') FROM t"
    assert one(spark, f, "SELECT * FROM t WHERE strftime('%Y', d) = 2024") == \
        "SELECT * FROM t WHERE date_format(d, 'yyyy') = '2024'"
    assert one(spark, f, "SELECT GETDATE()") == "SELECT current_timestamp()"
    assert one(spark, DL.ddl_cleanup, "CREATE TABLE t (id INT UNSIGNED AUTO_INCREMENT) ENGINE=InnoDB;") == \
        "CREATE TABLE t (id INT);"
    # rewritten SQL runs on Spark
    assert spark.sql(one(spark, f, "SELECT DATE_ADD(DATE '2024-01-31', INTERVAL 1 MONTH) AS d")).first().d is not None


def test_drop_ungrounded_joins(spark):
    df = spark.createDataFrame(
        [("SELECT x.id, r.region FROM users x JOIN regions r ON x.id = r.id WHERE x.id > 1;",
          "CREATE TABLE users (id INT);"),
         ("SELECT a.id FROM users a JOIN users b ON a.id = b.id", "CREATE TABLE users (id INT);")],
        "sql string, ddl string")
    out = [r.grounded_sql for r in R.drop_ungrounded_joins(df, "sql", "ddl").collect()]
    assert out[0] == "SELECT x.id, region FROM users x WHERE x.id > 1;"
    assert out[1] == "SELECT a.id FROM users a JOIN users b ON a.id = b.id"


def test_timestampdiff_variants(spark):
    df = spark.createDataFrame([("2020-02-29 00:00:00", "2024-02-28 00:00:00")], "a string, b string") \
        .select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    r = df.select(DT.timestampdiff_approx("YEAR", "a", "b").alias("x"),
                  DT.timestampdiff_exact("YEAR", "a", "b").alias("y")).first()
    assert (r.x, r.y) == (3, 3)
    df = spark.createDataFrame([("2024-01-02 00:00:00", "2024-01-01 23:00:00")], "a string, b string") \
        .select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    r = df.select(DT.datediff_truncated("a", "b").alias("ref"), DT.datediff_days("a", "b").alias("spark")).first()
    assert (r.ref, r.spark) == (0, 1)


def test_mysql_format_translation():
    assert DL.mysql_to_spark_format("%Y-%m-%d %H:%i:%s") == "yyyy-MM-dd HH:mm:ss"
    assert DL.mysql_to_spark_format("%M %Y") == "MMMM yyyy"


def test_resolve_attempts_rules(spark):
    a = spark.createDataFrame(
        [(1, 1, "", None), (1, 2, "  SELECT 1;  ", None), (1, 3, "x", None),      # 2nd attempt wins, stripped
         (2, 1, "<|end|>" * 6, None), (2, 2, "", None), (2, 3, "<|im_end|>" * 6, None),  # last loops
         (3, 1, "", None), (3, 2, "<|end|>" * 6, None), (3, 3, "", None),          # last empty
         (4, 1, None, "timeout"), (4, 2, None, "timeout"), (4, 3, "ok", "boom")],  # errors
        "prompt_id long, attempt int, response string, error string")
    p = spark.createDataFrame([(1, "x"), (2, "find rows"), (3, "x"), (4, "get")], "prompt_id long, prompt string")
    out = {r.prompt_id: r for r in R.resolve_attempts(a, p).collect()}
    assert (out[1].outcome, out[1].decided_by_attempt, out[1].response) == ("ok", 2, "SELECT 1;")
    assert (out[2].outcome, out[2].response) == ("fallback", TX.FALLBACK_SQL_TEXT)
    assert (out[3].outcome, out[3].response) == ("none", None)
    assert (out[4].outcome, out[4].response) == ("none", None)


def test_ensemble_vote_tie_goes_to_first_model(spark):
    df = spark.createDataFrame([(1, 1, "SELECT b FROM t"), (1, 2, "select a from t;"), (1, 3, "SELECT  a FROM t"),
                                (2, 1, "SELECT x FROM t"), (2, 2, "SELECT y FROM t")],
                               "p long, model int, sql string")
    out = {r.p: r for r in EV.ensemble_vote(df, "p", "model", "sql").collect()}
    assert (out[1].sql_key, out[1].votes) == ("select a from t", 2)
    assert (out[2].sql_key, out[2].first_model) == ("select x from t", 1)


def test_cross_matrix_zero_fill(spark):
    df = spark.createDataFrame([("d1", "x"), ("d1", "x"), ("d2", "y")], "domain string, c string")
    out = {r.domain: (r.x, r.y, r.z) for r in P.cross_matrix(df, "domain", "c", ["x", "y", "z"]).collect()}
    assert out == {"d1": (2, 0, 0), "d2": (0, 1, 0)}


def test_limit_samples_falsy_keeps_all(spark):
    from tessera.operators import corpus as C
    df = spark.range(10).withColumnRenamed("id", "sample_id")
    assert C.limit_samples(df, 0).count() == 10
    assert [r.sample_id for r in C.limit_samples(df, 3).collect()] == [0, 1, 2]

"""Evaluation and roll-ups (E1-E9, E12-E17, S7): joins and aggregations
over tables of cases, responses and per-case results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import sqlscan
from tessera.functions import text as TX
from tessera.operators.analytics import top1_per_group

col = F.col
lit = F.lit

# ---------------------------------------------------------------- fixed values
PASS_SCORE = 0.7          # suite: PASS at keyword score >= 0.7 (inclusive)
DEPLOY_SCORE = 0.5        # deployment smoke: PASS at score > 0.5 (exclusive)
GOOD_BAND, OK_BAND = 0.9, 0.8
NO_RESPONSE = "No response from model"
NO_SQL = "No SQL query found in response"
EXPECTED_DEFAULT = "N/A"
STATUSES = ["PASS", "PARTIAL", "FAIL", "ERROR"]
# -----------------------------------------------------------------------------


def assemble_eval(cases: DataFrame, responses: DataFrame, key: str = "sample_id") -> DataFrame:
    """Cases left-joined with generated responses. ``test_case`` is the
    1-based case number (case key + 1 for 0-based dense keys)."""
    j = cases.join(responses.select(key, "response"), key, "left")
    return j.select(
        (col(key) + 1).alias("test_case"), col("sql_prompt").alias("input_query"),
        F.coalesce(col("sql"), lit(EXPECTED_DEFAULT)).alias("expected"),
        TX.strip(col("response")).alias("generated"), col("sql_context").alias("context"),
        F.when(col("response").isNull(), lit("generation failed")).alias("error"))


def evaluate_predictions(df: DataFrame, valid: str = "is_valid", executable: str = "is_executable") -> DataFrame:
    """Totals and accuracies; accuracies are NULL when there are no rows."""
    n = F.count(lit(1))
    return df.agg(n.alias("total_queries"),
                  F.count(F.when(col(valid), 1)).alias("syntactically_valid"),
                  F.count(F.when(col(executable), 1)).alias("executable")) \
        .withColumn("syntax_accuracy", F.round(F.try_divide(col("syntactically_valid"), F.nullif(col("total_queries"), lit(0))), 6)) \
        .withColumn("execution_accuracy", F.round(F.try_divide(col("executable"), F.nullif(col("total_queries"), lit(0))), 6))


def prediction_errors(df: DataFrame, index: str = "query_index", valid: str = "is_valid",
                      executable: str = "is_executable", sql: str = "sql",
                      valid_msg: str = "validation_message", exec_msg: str = "execution_message") -> DataFrame:
    """Rows failing either check with their SQL and the check's message,
    each error NULL when its check passed."""
    return df.filter(~col(valid) | ~col(executable)).select(
        index, sql, F.when(~col(valid), col(valid_msg)).alias("validation_error"),
        F.when(~col(executable), col(exec_msg)).alias("execution_error"))


def keyword_match(df: DataFrame, response: str = "response", keywords: str = "expected_keywords") -> DataFrame:
    """Case-insensitive substring test of each expected keyword against
    the full response; score = found / expected (NULL without keywords)."""
    # Upper-case the (possibly long) response once per row; inside the
    # lambdas it is then a plain column reference, not a per-keyword copy.
    staged = df.withColumn("_up", F.upper(F.coalesce(col(response), lit(""))))
    up, kw = col("_up"), col(keywords)
    found = F.filter(kw, lambda k: F.contains(up, F.upper(k)))
    missing = F.filter(kw, lambda k: ~F.contains(up, F.upper(k)))
    return staged.withColumn("keywords_found", found).withColumn("keywords_missing", missing) \
        .withColumn("keyword_score", F.round(F.size(col("keywords_found")) / F.nullif(F.size(kw), lit(0)), 6)) \
        .drop("_up")


def case_status(has_response: Column, has_sql: Column, is_valid: Column, is_executable: Column,
                keyword_score: Column, error: Column | None = None) -> Column:
    """E5: ERROR when running the case raised; FAIL without response or SQL;
    valid and executable -> PASS when there are no keywords or score >= 0.7,
    else PARTIAL; otherwise FAIL."""
    ok = is_valid & is_executable
    raised = error.isNotNull() if error is not None else lit(False)
    return (F.when(raised, lit("ERROR")).when(~has_response | ~has_sql, lit("FAIL"))
             .when(ok & (keyword_score.isNull() | (keyword_score >= lit(PASS_SCORE))), lit("PASS"))
             .when(ok, lit("PARTIAL")).otherwise(lit("FAIL")))


def deploy_status(df: DataFrame, response: str = "response", raised: str | None = None) -> DataFrame:
    """Deployment smoke status: ERROR when the request raised (column
    ``raised`` holds the message); else PASS iff a response without the loop
    marker yields SQL that validates and keyword score > 0.5; no execution."""
    failed = col(raised) if raised else lit(None).cast("string")
    r = col(response)
    usable = r.isNotNull() & (r != lit("")) & ~TX.has_loop_marker(r)
    sql = F.nullif(TX.extract_sql(r), lit(""))
    passed = usable & sql.isNotNull() & TX.is_valid_sql(sql) & (col("keyword_score") > lit(DEPLOY_SCORE))
    return df.withColumn("status", F.when(failed.isNotNull(), lit("ERROR")).when(passed, lit("PASS")).otherwise(lit("FAIL"))) \
        .withColumn("error", F.when(failed.isNotNull(), failed).when(~usable, lit(NO_RESPONSE)).when(sql.isNull(), lit(NO_SQL)))


def deploy_summary(df: DataFrame, status: str = "status") -> DataFrame:
    """E6 roll-up: an ERROR counts as failed."""
    c = df.agg(F.count(lit(1)).alias("total"), F.count(F.when(col(status) == "PASS", 1)).alias("passed"),
               F.count(F.when(col(status) != "PASS", 1)).alias("failed"), F.count(F.when(col(status) == "ERROR", 1)).alias("errors"))
    return c.withColumn("success_rate", F.round(col("passed") / F.nullif(col("total"), lit(0)), 6))


def suite_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """Status counters and the four rates over the total."""
    s = col(status)
    c = df.agg(F.count(lit(1)).alias("total_tests"),
               *[F.count(F.when(s == v, 1)).alias(n) for v, n in
                 [("PASS", "passed"), ("FAIL", "failed"), ("PARTIAL", "partial"), ("ERROR", "errors")]])
    t = F.nullif(col("total_tests"), lit(0))
    return c.select("*", *[F.round(col(n) / t, 6).alias(r) for n, r in
                           [("passed", "success_rate"), ("failed", "failure_rate"),
                            ("errors", "error_rate"), ("partial", "partial_success_rate")]])


def summary_by(df: DataFrame, group: str, status: str = "status") -> DataFrame:
    """Total, passed (PASS only) and success rate per group."""
    return (df.groupBy(group).agg(F.count(lit(1)).alias("total"),
                                  F.count(F.when(col(status) == "PASS", 1)).alias("passed"))
            .withColumn("success_rate", F.round(col("passed") / col("total"), 6)))


def report_table(df: DataFrame, group: str, status: str = "status") -> DataFrame:
    """The report's per-group table plus the overall row ('ALL'), from
    one GROUPING SETS aggregation."""
    g = df.groupingSets([[group], []], group).agg(
        F.count(lit(1)).alias("total"), F.count(F.when(col(status) == "PASS", 1)).alias("passed"),
        F.grouping_id().alias("gid"))
    return g.select(F.when(col("gid") == 1, lit("ALL")).otherwise(col(group)).alias(group), "total",
                    "passed", F.round(col("passed") / col("total"), 6).alias("success_rate"))


def latency_stats(df: DataFrame, t: str = "response_time", ok: str = "success") -> DataFrame:
    """Average / min / max response time and responses received.
    On an empty input the statistics are NULL (not 0 / inf)."""
    return df.agg(F.count(lit(1)).alias("total_tests"), F.round(F.avg(t), 6).alias("average_response_time"),
                  F.min(t).alias("min_response_time"), F.max(t).alias("max_response_time"),
                  F.count(F.when(col(ok), 1)).alias("responses_received"))


def latency_cases(df: DataFrame, key: str, response: str = "response") -> DataFrame:
    """E12 per case: was a response received, and its length."""
    got = F.coalesce(col(response), lit("")) != lit("")
    return df.select(key, got.alias("response_received"), F.length(F.coalesce(col(response), lit(""))).cast("bigint").alias("response_length"))


def latency_by_group(df: DataFrame, group: str, t: str = "response_time", ok: str = "success") -> DataFrame:
    """Per group average time and success rate. The reference keeps
    every time in a list; a group can be arbitrarily large here, so the
    list is replaced by count / min / max."""
    return df.groupBy(group).agg(
        F.count(lit(1)).alias("n_runs"), F.round(F.avg(t), 6).alias("avg_time"),
        F.round(F.avg(col(ok).cast("double")), 6).alias("success_rate"),
        F.min(t).alias("min_time"), F.max(t).alias("max_time"))


def compare_models(df: DataFrame, group: str, model: str, models: Sequence[str],
                   status: str = "status") -> DataFrame:
    """Per group pass rate of each model side by side, plus the
    difference of the second to the first (pivot with fixed values)."""
    p = df.groupBy(group).pivot(model, list(models)).agg(
        F.round(F.avg((col(status) == "PASS").cast("double")), 6))
    a, b = models[0], models[1]
    return p.withColumn("delta", F.round(col(b) - col(a), 6))


def ensemble_vote(df: DataFrame, prompt: str, model_order: str, sql: str) -> DataFrame:
    """Majority vote per prompt on the canonical SQL key (R10) among
    model answers that contain SQL; ties go to the key first proposed by the
    earliest model. Groups are bounded by the number of models."""
    keyed = df.withColumn("_key", TX.normalize_sql(col(sql))).filter(col("_key").isNotNull())
    votes = keyed.groupBy(prompt, "_key").agg(F.count(lit(1)).alias("votes"),
                                               F.min(model_order).alias("first_model"))
    # a model proposes one key per prompt, so (votes, first_model) decides
    w = top1_per_group(votes, [prompt], [("votes", False), ("first_model", True)])
    return w.select(prompt, col("_key").alias("sql_key"), "votes", "first_model")


def quality_band(rate: Column) -> Column:
    """> 0.9 good, > 0.8 acceptable, else poor."""
    return (F.when(rate > GOOD_BAND, lit("good")).when(rate > OK_BAND, lit("acceptable"))
             .otherwise(lit("poor")))


def expected_match(df: DataFrame, generated: str, expected: str, group: str) -> DataFrame:
    """E17 (fills the reference's stub): exact match of canonical SQL keys."""
    m = TX.normalize_sql(col(generated)) == TX.normalize_sql(col(expected))
    return df.groupBy(group).agg(
        F.count(lit(1)).alias("n_cases"), F.count(F.when(m, 1)).alias("n_exact_match")) \
        .withColumn("exact_match_rate", F.round(col("n_exact_match") / col("n_cases"), 6))


def expected_set_match(df: DataFrame, generated: str, expected: str, group: str) -> DataFrame:
    """E17 beyond equal text: also the cases whose clauses are equal as sets
    (select items, predicates, group keys, listed tables in any order)."""
    text = TX.normalize_sql(col(generated)) == TX.normalize_sql(col(expected))
    clauses = sqlscan.clause_key_of(col(generated)) == sqlscan.clause_key_of(col(expected))
    judged = df.select(group, text.alias("_text"), clauses.alias("_clauses"))
    return judged.groupBy(group).agg(
        F.count(lit(1)).alias("n_cases"), F.count(F.when(col("_text"), 1)).alias("n_exact_match"),
        F.count(F.when(col("_clauses"), 1)).alias("n_set_match")) \
        .withColumn("exact_match_rate", F.round(col("n_exact_match") / col("n_cases"), 6)) \
        .withColumn("set_match_rate", F.round(col("n_set_match") / col("n_cases"), 6))

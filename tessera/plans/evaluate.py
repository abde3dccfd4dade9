"""Bindings for evaluation and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.operators import evaluate as EV
from tessera.operators import quantiles as Q
from tessera.plans import register
from tessera.plans import fixtures as FX
from tessera.plans import sqltext as S

col = F.col

STATUS_SQL = ("CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN NOT has_response OR NOT has_sql THEN 'FAIL' WHEN is_valid AND is_executable AND (keyword_score IS NULL OR keyword_score >= 0.7) "
              "THEN 'PASS' WHEN is_valid AND is_executable THEN 'PARTIAL' ELSE 'FAIL' END")
EV_STATUS = FX.with_views("eval_results", extra=f"st AS (SELECT *, {STATUS_SQL} AS status FROM eval_results)")


def _status(spark, d):
    e = FX.eval_results(spark, d)
    return e.withColumn("status", EV.case_status(col("has_response"), col("has_sql"), col("is_valid"),
                                                 col("is_executable"), col("keyword_score"), col("error")))


@register("assemble_eval", FX.with_views("responses") + f"""
SELECT s.sample_id + 1 AS test_case, s.sql_prompt AS input_query, coalesce(s.sql, 'N/A') AS expected,
 {S.strip('r.response')} AS generated, s.sql_context AS context,
 CASE WHEN r.response IS NULL THEN 'generation failed' END AS error
FROM samples s LEFT JOIN responses r ON r.sample_id = s.sample_id""")
def assemble_eval(spark, d):
    return EV.assemble_eval(FX.samples(spark, d), FX.responses(spark, d))


@register("evaluate_predictions", FX.with_views("eval_results") + """
SELECT count(*) AS total_queries, count(*) FILTER (WHERE is_valid) AS syntactically_valid,
 count(*) FILTER (WHERE is_executable) AS executable,
 round(count(*) FILTER (WHERE is_valid) / nullif(count(*), 0), 6) AS syntax_accuracy,
 round(count(*) FILTER (WHERE is_executable) / nullif(count(*), 0), 6) AS execution_accuracy
FROM eval_results""")
def evaluate_predictions(spark, d):
    return EV.evaluate_predictions(FX.eval_results(spark, d))


@register("prediction_errors", FX.with_views("eval_results") + f"""
SELECT query_index, sql, CASE WHEN NOT is_valid THEN validation_message END AS validation_error,
 CASE WHEN NOT is_executable THEN execution_message END AS execution_error
FROM eval_results WHERE NOT is_valid OR NOT is_executable""")
def prediction_errors(spark, d):
    return EV.prediction_errors(FX.eval_results(spark, d))


_KW = f"""kw AS (SELECT sample_id, response, {FX.keywords_sql()} AS expected_keywords FROM responses),
km AS (SELECT sample_id, expected_keywords,
  list_filter(expected_keywords, lambda k: contains(upper(coalesce(response, '')), upper(k))) AS keywords_found,
  list_filter(expected_keywords, lambda k: NOT contains(upper(coalesce(response, '')), upper(k))) AS keywords_missing,
  response FROM kw),
kms AS (SELECT *, round(len(keywords_found) / nullif(len(expected_keywords), 0), 6) AS keyword_score FROM km)"""


def _kw(spark, d):
    r = FX.responses(spark, d).select("sample_id", "response", FX.keywords_col().alias("expected_keywords"))
    return EV.keyword_match(r)


@register("keyword_match", FX.with_views("responses", extra=_KW) +
          "SELECT sample_id, keywords_found, keywords_missing, keyword_score FROM kms")
def keyword_match(spark, d):
    return _kw(spark, d).select("sample_id", "keywords_found", "keywords_missing", "keyword_score")


@register("case_status", EV_STATUS + "SELECT query_index, domain, complexity, status FROM st")
def case_status(spark, d):
    return _status(spark, d).select("query_index", "domain", "complexity", "status")


_DEPLOY_X = f"nullif({S.extract_sql('response')}, '')"


_RAISED = "CASE WHEN sample_id % 17 = 4 THEN 'connection refused' END"
_DEPLOY = FX.with_views("responses", extra=_KW) + f"""
SELECT sample_id, keyword_score,
 CASE WHEN raised IS NOT NULL THEN 'ERROR' WHEN u AND x IS NOT NULL AND coalesce({S.is_valid_sql('x')}, false) AND keyword_score > 0.5 THEN 'PASS' ELSE 'FAIL' END AS status,
 CASE WHEN raised IS NOT NULL THEN raised WHEN NOT u THEN {S.q(EV.NO_RESPONSE)} WHEN x IS NULL THEN {S.q(EV.NO_SQL)} END AS error
FROM (SELECT *, response IS NOT NULL AND response <> '' AND NOT {S.has_loop_marker('response')} AS u,
      {_DEPLOY_X} AS x, {_RAISED} AS raised FROM kms)"""


def _deployed(spark, d):
    r = _kw(spark, d).withColumn("raised", F.when(col("sample_id") % 17 == 4, F.lit("connection refused")))
    return EV.deploy_status(r, raised="raised")


@register("deploy_status", _DEPLOY)
def deploy_status(spark, d):
    return _deployed(spark, d).select("sample_id", "keyword_score", "status", "error")


@register("deploy_summary", f"""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS passed,
 count(*) FILTER (WHERE status <> 'PASS') AS failed, count(*) FILTER (WHERE status = 'ERROR') AS errors,
 round(count(*) FILTER (WHERE status = 'PASS') / nullif(count(*), 0), 6) AS success_rate FROM ({_DEPLOY})""")
def deploy_summary(spark, d):
    return EV.deploy_summary(_deployed(spark, d))


@register("suite_counts", EV_STATUS + """
SELECT count(*) AS total_tests, count(*) FILTER (WHERE status = 'PASS') AS passed,
 count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'PARTIAL') AS partial,
 count(*) FILTER (WHERE status = 'ERROR') AS errors,
 round(count(*) FILTER (WHERE status = 'PASS') / nullif(count(*), 0), 6) AS success_rate,
 round(count(*) FILTER (WHERE status = 'FAIL') / nullif(count(*), 0), 6) AS failure_rate,
 round(count(*) FILTER (WHERE status = 'ERROR') / nullif(count(*), 0), 6) AS error_rate,
 round(count(*) FILTER (WHERE status = 'PARTIAL') / nullif(count(*), 0), 6) AS partial_success_rate
FROM st""")
def suite_counts(spark, d):
    return EV.suite_counts(_status(spark, d))


def _by(g):
    return EV_STATUS + f"""SELECT {g}, count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS passed,
 round(count(*) FILTER (WHERE status = 'PASS') / count(*), 6) AS success_rate FROM st GROUP BY {g}"""


@register("summary_by_complexity", _by("complexity"))
def summary_by_complexity(spark, d):
    return EV.summary_by(_status(spark, d), "complexity")


@register("summary_by_domain", _by("domain"))
def summary_by_domain(spark, d):
    return EV.summary_by(_status(spark, d), "domain")


@register("eval_report_table", EV_STATUS + """
SELECT complexity, count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS passed,
 round(count(*) FILTER (WHERE status = 'PASS') / count(*), 6) AS success_rate FROM st GROUP BY complexity
UNION ALL SELECT 'ALL', count(*), count(*) FILTER (WHERE status = 'PASS'),
 round(count(*) FILTER (WHERE status = 'PASS') / count(*), 6) FROM st""")
def eval_report_table(spark, d):
    return EV.report_table(_status(spark, d), "complexity")


@register("latency_stats", FX.with_views("latency") + """
SELECT count(*) AS total_tests, round(avg(response_time), 6) AS average_response_time,
 min(response_time) AS min_response_time, max(response_time) AS max_response_time,
 count(*) FILTER (WHERE success) AS responses_received FROM latency""")
def latency_stats(spark, d):
    return EV.latency_stats(FX.latency(spark, d))


@register("latency_cases", FX.with_views("responses") + """
SELECT sample_id, coalesce(response, '') <> '' AS response_received, CAST(length(coalesce(response, '')) AS BIGINT) AS response_length
FROM responses""")
def latency_cases(spark, d):
    return EV.latency_cases(FX.responses(spark, d), "sample_id")


# S7 per-test rows: what the report lists under its cards
@register("eval_report_cases", EV_STATUS + """
SELECT query_index, name, complexity, domain, status, keyword_score, sql AS generated_sql,
 CASE WHEN NOT is_valid THEN validation_message END AS validation_error,
 CASE WHEN NOT is_executable THEN execution_message END AS execution_error, error FROM st""")
def eval_report_cases(spark, d):
    return _status(spark, d).select(
        "query_index", "name", "complexity", "domain", "status", "keyword_score", col("sql").alias("generated_sql"),
        F.when(~col("is_valid"), col("validation_message")).alias("validation_error"),
        F.when(~col("is_executable"), col("execution_message")).alias("execution_error"), "error")


@register("latency_by_complexity", FX.with_views("latency") + """
SELECT complexity, count(*) AS n_runs, round(avg(response_time), 6) AS avg_time,
 round(avg(CAST(success AS DOUBLE)), 6) AS success_rate, min(response_time) AS min_time,
 max(response_time) AS max_time FROM latency GROUP BY complexity""")
def latency_by_complexity(spark, d):
    return EV.latency_by_group(FX.latency(spark, d), "complexity")


_EXACT = """SELECT complexity, p, n, v AS value FROM (
 SELECT complexity, count(response_time) AS n, unnest([500, 950, 990]) AS p,
        unnest([quantile_disc(response_time, 0.5), quantile_disc(response_time, 0.95), quantile_disc(response_time, 0.99)]) AS v
 FROM latency GROUP BY complexity)"""


# The times as a distribution; p in thousandths
@register("latency_quantiles", FX.with_views("latency") + _EXACT)
def latency_quantiles(spark, d):
    return Q.exact(FX.latency(spark, d), ["complexity"], "response_time")


@register("latency_quantiles_sketch", FX.with_views("latency") + f"SELECT complexity, p, n, true AS within_error FROM ({_EXACT})")
def latency_quantiles_sketch(spark, d):
    # the sketches of two halves merged, held against the exact quantiles
    t = FX.latency(spark, d)
    halves = [Q.sketch(t.filter(F.col("event_id") % 2 == k), ["complexity"], "response_time") for k in (0, 1)]
    read = Q.from_sketch(Q.merge(*halves, ["complexity"]), ["complexity"]).withColumnRenamed("value", "estimate")
    both = read.join(Q.exact(t, ["complexity"], "response_time").select("complexity", "p", "value"), ["complexity", "p"])
    return both.select("complexity", "p", "n", (F.abs(col("estimate") - col("value")) <= Q.ERROR * F.abs("value")).alias("within_error"))


@register("compare_models", EV_STATUS + """
SELECT complexity, a AS model_a, b AS model_b, round(b - a, 6) AS delta FROM (
 SELECT complexity,
  round(avg(CASE WHEN status = 'PASS' THEN 1.0 ELSE 0.0 END), 6) AS a,
  round(avg(CASE WHEN query_index % 5 <> 0 AND status IN ('PASS', 'PARTIAL') THEN 1.0 ELSE 0.0 END), 6) AS b
 FROM st GROUP BY complexity)""")
def compare_models(spark, d):
    # the same suite on both: model_b also passes partial cases, but fails every fifth one
    b = F.when((col("query_index") % 5 != 0) & col("status").isin("PASS", "PARTIAL"), F.lit("PASS")).otherwise(F.lit("FAIL"))
    runs = F.array(F.struct(F.lit("model_a").alias("model"), col("status").alias("status")),
                   F.struct(F.lit("model_b").alias("model"), b.alias("status")))
    s = _status(spark, d).select("complexity", F.inline(runs))
    return EV.compare_models(s, "complexity", "model", ["model_a", "model_b"])


@register("ensemble_vote", FX.with_views("attempts", extra=f"""
k AS (SELECT prompt_id, attempt, {S.normalize_sql('x')} AS sql_key
      FROM (SELECT prompt_id, attempt, {S.extract_sql(S.scrub('response'))} AS x FROM attempts) WHERE x IS NOT NULL),
v AS (SELECT prompt_id, sql_key, count(*) AS votes, min(attempt) AS first_model FROM k GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY votes DESC, first_model, sql_key) AS rk FROM v)""") +
          "SELECT prompt_id, sql_key, votes, first_model FROM r WHERE rk = 1")
def ensemble_vote(spark, d):
    a = FX.attempts(spark, d).withColumn("x", TX.extract_sql(TX.scrub_control_chars(col("response"))))
    a = a.select("prompt_id", "attempt", F.explode(F.filter(F.array("x"), lambda x: x.isNotNull())).alias("x"))
    return EV.ensemble_vote(a, "prompt_id", "attempt", "x")


@register("quality_band", FX.with_views("eval_results") + """
SELECT complexity, round(avg(CAST(is_valid AS DOUBLE)), 6) AS valid_rate,
 CASE WHEN avg(CAST(is_valid AS DOUBLE)) > 0.9 THEN 'good' WHEN avg(CAST(is_valid AS DOUBLE)) > 0.8
      THEN 'acceptable' ELSE 'poor' END AS band FROM eval_results GROUP BY complexity""")
def quality_band(spark, d):
    e = FX.eval_results(spark, d).groupBy("complexity").agg(F.avg(col("is_valid").cast("double")).alias("r"))
    return e.select("complexity", F.round("r", 6).alias("valid_rate"), EV.quality_band(col("r")).alias("band"))


@register("expected_match", FX.with_views("responses") + f"""
SELECT sql_complexity, count(*) AS n_cases,
 count(*) FILTER (WHERE {S.normalize_sql('g')} = {S.normalize_sql('expected_sql')}) AS n_exact_match,
 round(count(*) FILTER (WHERE {S.normalize_sql('g')} = {S.normalize_sql('expected_sql')}) / count(*), 6) AS exact_match_rate
FROM (SELECT *, {S.extract_sql(S.scrub('response'))} AS g FROM responses) GROUP BY sql_complexity""")
def expected_match(spark, d):
    r = FX.responses(spark, d).withColumn("g", TX.extract_sql(TX.scrub_control_chars(col("response"))))
    return EV.expected_match(r, "g", "expected_sql", "sql_complexity")

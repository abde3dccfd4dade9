"""Bindings for response post-processing (R1-R14, F12) on the derived
``responses`` / ``attempts`` / ``samples`` views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import dialect as DL
from tessera.functions import text as TX
from tessera.operators import responses as R
from tessera.plans import register
from tessera.plans import fixtures as FX
from tessera.plans import sqltext as S

col = F.col
RESP = FX.with_views("responses")
EXTRACTED = f"{S.extract_sql(S.scrub('response'))}"


def _extracted(spark, d):
    r = FX.responses(spark, d)
    return r.select("sample_id", "sql_context", TX.extract_sql(TX.scrub_control_chars(col("response"))).alias("sql"))


def _with_sql(spark, d):
    """Responses that hold a statement. The null test is on a one-element array:
    a plain filter would be pushed under the projection and extract twice."""
    e = _extracted(spark, d).select("sample_id", "sql_context", F.array("sql").alias("one"))
    return e.select("sample_id", "sql_context", F.explode(F.filter("one", lambda x: x.isNotNull())).alias("sql"))


@register("scrub_control_chars", RESP + f"SELECT sample_id, {S.scrub('response')} AS scrubbed FROM responses")
def scrub_control_chars(spark, d):
    return FX.responses(spark, d).select("sample_id", TX.scrub_control_chars(col("response")).alias("scrubbed"))


@register("extract_sql", RESP + f"SELECT sample_id, {EXTRACTED} AS sql_query FROM responses")
def extract_sql(spark, d):
    return _extracted(spark, d).select("sample_id", col("sql").alias("sql_query"))


@register("validate_sql", RESP + f"""SELECT sample_id, {S.is_valid_sql('x')} AS is_valid,
 {S.validation_message('x')} AS validation_message FROM (SELECT sample_id, {EXTRACTED} AS x FROM responses)""")
def validate_sql(spark, d):
    e = _extracted(spark, d)
    return e.select("sample_id", TX.is_valid_sql(col("sql")).alias("is_valid"),
                    TX.validation_message(col("sql")).alias("validation_message"))


@register("classify_statement", RESP + f"""SELECT {S.statement_kind('x')} AS statement_kind, count(*) AS n
 FROM (SELECT {EXTRACTED} AS x FROM responses) WHERE x IS NOT NULL GROUP BY 1""")
def classify_statement(spark, d):
    e = _with_sql(spark, d)
    return e.groupBy(TX.statement_kind(col("sql")).alias("statement_kind")).agg(F.count(F.lit(1)).alias("n"))


@register("detect_token_loop", RESP + f"""SELECT sample_id, {S.count_occ('response', TX.IM_END)} AS im_end_count,
 {S.count_occ('response', TX.END)} AS end_count, {S.is_token_loop('response')} AS is_loop,
 {S.has_loop_marker('response')} AS has_marker, {S.response_health('response')} AS health FROM responses""")
def detect_token_loop(spark, d):
    r = col("response")
    return FX.responses(spark, d).select(
        "sample_id", TX.count_occurrences(r, TX.IM_END).alias("im_end_count"),
        TX.count_occurrences(r, TX.END).alias("end_count"), TX.is_token_loop(r).alias("is_loop"),
        TX.has_loop_marker(r).alias("has_marker"), TX.response_health(r).alias("health"))


_PROMPT_SQL = "concat(coalesce(sql_context, ''), chr(10), chr(10), 'Request: ', coalesce(sql_prompt, ''))"


def prompt_text():
    return F.concat(F.coalesce(col("sql_context"), F.lit("")), F.lit("\n\nRequest: "), F.coalesce(col("sql_prompt"), F.lit("")))


def _prompts(spark, d):
    return FX.samples(spark, d).select(col("sample_id").alias("prompt_id"), prompt_text().alias("prompt"))


RESOLVED = FX.with_views("attempts", extra=f"""
a AS (SELECT prompt_id, attempt, {S.strip("coalesce(response, '')")} AS r FROM attempts),
b AS (SELECT *, {S.is_token_loop('r')} AS lp, r <> '' AND NOT {S.is_token_loop('r')} AS good FROM a),
g AS (SELECT prompt_id, min(attempt) FILTER (WHERE good) AS good_attempt, max(attempt) AS last_attempt FROM b GROUP BY 1),
res AS (SELECT g.prompt_id, g.good_attempt, gr.r AS good_response, g.last_attempt, lb.lp AS last_loop
  FROM g LEFT JOIN b gr ON gr.prompt_id = g.prompt_id AND gr.attempt = g.good_attempt
  JOIN b lb ON lb.prompt_id = g.prompt_id AND lb.attempt = g.last_attempt),
p AS (SELECT sample_id AS prompt_id, {_PROMPT_SQL} AS prompt FROM samples)""") + f"""
SELECT res.prompt_id,
 CASE WHEN good_attempt IS NOT NULL THEN 'ok' WHEN last_loop THEN 'fallback' ELSE 'none' END AS outcome,
 coalesce(good_attempt, last_attempt) AS decided_by_attempt,
 CASE WHEN good_attempt IS NOT NULL THEN good_response WHEN last_loop THEN {S.fallback_response('p.prompt')} END AS response
FROM res LEFT JOIN p ON p.prompt_id = res.prompt_id"""


@register("resolve_attempts", RESOLVED)
def resolve_attempts(spark, d):
    return R.resolve_attempts(FX.attempts(spark, d), _prompts(spark, d))


@register("fallback_response", FX.with_views("samples") +
          f"SELECT sample_id, {S.fallback_response('sql_prompt')} AS fallback FROM samples")
def fallback_response(spark, d):
    return FX.samples(spark, d).select("sample_id", TX.fallback_response(col("sql_prompt")).alias("fallback"))


_GATE = f"""SELECT sample_id, NOT (f) AS success,
 CASE WHEN e THEN {S.q(R.NO_RESPONSE_ERROR)} WHEN m THEN {S.q(R.TOKEN_ISSUE_ERROR)} END AS error,
 CASE WHEN NOT f THEN x END AS sql_query, CASE WHEN NOT f THEN sc END AS full_response,
 CASE WHEN NOT f THEN coalesce({S.is_valid_sql('x')}, false) END AS is_valid,
 CASE WHEN NOT f THEN (CASE WHEN x IS NULL THEN {S.q(TX.NO_SQL_MSG)} ELSE {S.validation_message('x')} END) END
   AS validation_message
FROM (SELECT *, e OR m AS f FROM (SELECT sample_id, response IS NULL OR response = '' AS e,
  {S.has_loop_marker('response')} AS m, {S.scrub('response')} AS sc,
  nullif({EXTRACTED}, '') AS x FROM responses))"""


@register("gate_responses", RESP + _GATE)
def gate_responses(spark, d):
    return R.gate_responses(FX.responses(spark, d).select("sample_id", "response"))


@register("batch_validate", RESP + f"""SELECT sample_id, s <> '' AS success,
 CASE WHEN s = '' THEN {S.q(R.SQL_REQUIRED_ERROR)} END AS error,
 CASE WHEN s <> '' THEN {S.is_valid_sql('s')} END AS is_valid,
 CASE WHEN s <> '' THEN {S.validation_message('s')} END AS message
FROM (SELECT sample_id, {S.strip(f"coalesce({EXTRACTED}, '')")} AS s FROM responses)""")
def batch_validate(spark, d):
    return R.batch_validate(_extracted(spark, d).select("sample_id", "sql"), "sql")


@register("normalize_sql_case", RESP + f"""SELECT sample_id, {S.normalize_sql('x')} AS sql_key
FROM (SELECT sample_id, {EXTRACTED} AS x FROM responses) WHERE x IS NOT NULL""")
def normalize_sql_case(spark, d):
    e = _with_sql(spark, d)
    return e.select("sample_id", TX.normalize_sql(col("sql")).alias("sql_key"))


# Who is unknown where, by hand: the queries name tables of their own schema only,
# but for the ungrounded one, which joins a table that no schema has to one that
# only the first has.
@register("schema_grounding", RESP + f"""SELECT sample_id, t.table_name
FROM (SELECT sample_id, sql_context, {EXTRACTED} AS x FROM responses)
JOIN (VALUES ('outlets', ''), ('members', {S.q(FX.CONTEXTS[0])})) AS t(table_name, declared_in) ON sql_context <> declared_in
WHERE x = {S.q(FX.UNGROUNDED_SQL)}""")
def schema_grounding(spark, d):
    e = _with_sql(spark, d)
    return R.schema_grounding(e, "sql", "sql_context")


# One of the finite inputs is changed, in every schema (none declares the joined
# table), and the expected text is literal.
@register("drop_ungrounded_joins", RESP + f"""SELECT sample_id, x AS sql,
 CASE WHEN x = {S.q(FX.UNGROUNDED_SQL)} THEN {S.q(FX.GROUNDED_SQL)} ELSE x END AS grounded_sql
FROM (SELECT sample_id, {EXTRACTED} AS x FROM responses) WHERE x IS NOT NULL""")
def drop_ungrounded_joins(spark, d):
    e = _with_sql(spark, d)
    return R.drop_ungrounded_joins(e, "sql", "sql_context").select("sample_id", "sql", "grounded_sql")


@register("dialect_normalize", FX.with_views("samples", extra=FX.values_sql(
    "want", "gold, spark", [(FX.GOLD_SQL[c], s) for c, s in FX.SPARK_SQL.items()])) + """
SELECT sql, coalesce(spark, sql) AS spark_sql, spark IS NOT NULL AS rewritten
FROM (SELECT DISTINCT sql FROM samples) LEFT JOIN want ON sql = gold""")
def dialect_normalize(spark, d):
    # de-duplicate first: a corpus repeats the same query text many times
    q = FX.samples(spark, d).select("sql").distinct()
    return q.select("sql", DL.dialect_normalize(col("sql")).alias("spark_sql")) \
        .withColumn("rewritten", col("spark_sql") != col("sql"))


@register("dialect_usage", FX.with_views("samples", extra=FX.values_sql(
    "used", "c, idiom", [(c, n) for c, names in FX.IDIOMS.items() for n in names]) + ",\n" + FX.values_sql(
    "idioms", "idiom", [(n,) for n, _ in DL.IDIOMS])) + f"""
SELECT idioms.idiom, count(sample_id) AS n_queries FROM idioms LEFT JOIN used ON used.idiom = idioms.idiom
LEFT JOIN samples ON sample_id % {FX.N_CASES} = c GROUP BY idioms.idiom""")
def dialect_usage(spark, d):
    return R.dialect_usage(FX.samples(spark, d), "sql")


@register("ddl_cleanup", FX.with_views("samples", extra=FX.values_sql(
    "want", "ddl, clean", [(FX.CONTEXTS[c], s) for c, s in FX.CLEAN_DDL.items()])) + """
SELECT sql_context, coalesce(clean, sql_context) AS clean_ddl
FROM (SELECT DISTINCT sql_context FROM samples) LEFT JOIN want ON sql_context = ddl""")
def ddl_cleanup(spark, d):
    c = FX.samples(spark, d).select("sql_context").distinct()
    return c.select("sql_context", DL.ddl_cleanup(col("sql_context")).alias("clean_ddl"))

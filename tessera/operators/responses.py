"""Response post-processing over tables of model output (R6, R8, R9, R11,
R12, R14). Row-local column work except R6, which groups the (at most a few)
attempts of one prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import dialect as DL
from tessera.functions import sqlscan
from tessera.functions import text as TX

col = F.col
lit = F.lit

# ---------------------------------------------------------------- fixed values
NO_RESPONSE_ERROR = "Failed to get response from model"
TOKEN_ISSUE_ERROR = ("Model encountered a token generation issue. Please try again or check "
                     "model configuration.")
SQL_REQUIRED_ERROR = "SQL query is required"
MAX_ATTEMPTS = 3
# -----------------------------------------------------------------------------

# The last part of the created table's name, quoted or not.
CREATE_TABLE_RE = (r"(?i)CREATE\s+(?:(?:TEMP|TEMPORARY|EXTERNAL)\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?"
                   r"(?:[`\"]?\w+[`\"]?\s*\.\s*)*([`\"][^`\"]+[`\"]|\w+)")


def resolve_attempts(attempts: DataFrame, prompts: DataFrame | None = None,
                     key: str = "prompt_id") -> DataFrame:
    """Per prompt, the first attempt whose stripped response is
    non-empty and not a token loop wins; otherwise the last attempt decides —
    a loop gives the canned fallback (R7 on the prompt text), an empty
    response or an error gives NULL. ``prompts`` (key, prompt) is joined only
    when given. Groups hold at most MAX_ATTEMPTS rows."""
    a = attempts.withColumn("_r", TX.strip(F.coalesce(col("response"), lit(""))))
    if "error" in attempts.columns:
        a = a.withColumn("_err", col("error").isNotNull())
    else:
        a = a.withColumn("_err", lit(False))
    a = (a.withColumn("_loop", TX.is_token_loop(col("_r")))
          .withColumn("_good", ~col("_err") & (col("_r") != lit("")) & ~col("_loop")))
    # One number per prompt: attempts and flags packed, so this is a hash
    # aggregation and no response text is shuffled for it. Only the deciding
    # rows' texts are fetched afterwards.
    flags = col("_loop").cast("bigint") * 2 + col("_err").cast("bigint")
    g = a.groupBy(key).agg(
        F.min(F.when(col("_good"), col("attempt"))).alias("good_attempt"),
        F.max(col("attempt").cast("bigint") * 4 + flags).alias("_last"))
    g = g.withColumn("last_attempt", F.shiftright("_last", 2).cast(attempts.schema["attempt"].dataType)) \
        .withColumn("use_fallback", col("good_attempt").isNull() & (F.pmod("_last", lit(4)) == 2))
    text = a.filter("_good").select(col(key).alias("_p"), col("attempt").alias("_a"), col("_r").alias("good_response"))
    out = g.join(text, (col(key) == col("_p")) & (col("good_attempt") == col("_a")), "left") \
        .select(key, "good_attempt", "good_response", "last_attempt", "use_fallback")
    if prompts is not None:
        # Only the fallback choice (a flag) travels through the join, not the
        # prompt text itself.
        flags = prompts.select(key, (TX.fallback_response(col("prompt")) == lit(TX.FALLBACK_SQL_TEXT))
                               .alias("_sql_fallback"))
        out = out.join(flags, key, "left")
        fb = F.when(col("_sql_fallback"), lit(TX.FALLBACK_SQL_TEXT)).otherwise(lit(TX.FALLBACK_ERROR_TEXT))
    else:
        fb = lit(None).cast("string")
    outcome = (F.when(col("good_attempt").isNotNull(), lit("ok"))
                .when(col("use_fallback"), lit("fallback")).otherwise(lit("none")))
    return out.select(
        key, outcome.alias("outcome"),
        F.coalesce(col("good_attempt"), col("last_attempt")).alias("decided_by_attempt"),
        F.when(col("good_attempt").isNotNull(), col("good_response"))
         .when(col("use_fallback"), fb).alias("response"))


def gate_responses(df: DataFrame, response: str = "response") -> DataFrame:
    """The full per-response record of the generate endpoint:
    no response -> error; loop marker -> error; else scrub, extract, validate.
    ``sql_query`` is NULL (with a message) when no SQL is found."""
    r = col(response)
    keep = [c for c in df.columns if c != response]
    # Stage the expensive text work in its own projections (each regex runs
    # once per row; the optimizer does not re-inline non-trivial expressions
    # that are referenced several times).
    staged = (df.select(*keep, (r.isNull() | (r == lit(""))).alias("_empty"),
                        TX.has_loop_marker(r).alias("_marker"), TX.scrub_control_chars(r).alias("_scrubbed"))
                .withColumn("_sql", F.nullif(TX.extract_sql(col("_scrubbed")), lit(""))))
    empty, marker, scrubbed, sql = col("_empty"), col("_marker"), col("_scrubbed"), col("_sql")
    failed = empty | marker
    return staged.select(
        *keep,
        (~failed).alias("success"),
        F.when(empty, lit(NO_RESPONSE_ERROR)).when(marker, lit(TOKEN_ISSUE_ERROR)).alias("error"),
        F.when(~failed, sql).alias("sql_query"),
        F.when(~failed, scrubbed).alias("full_response"),
        F.when(~failed, F.coalesce(TX.is_valid_sql(sql), lit(False))).alias("is_valid"),
        F.when(~failed, F.when(sql.isNull(), lit(TX.NO_SQL_MSG)).otherwise(TX.validation_message(sql)))
         .alias("validation_message"))


def batch_validate(df: DataFrame, sql: str = "sql") -> DataFrame:
    """Validation endpoint over a table of SQL strings."""
    s = TX.strip(F.coalesce(col(sql), lit("")))
    empty = s == lit("")
    keep = [c for c in df.columns if c != sql]
    return df.select(*keep, (~empty).alias("success"),
                     F.when(empty, lit(SQL_REQUIRED_ERROR)).alias("error"),
                     F.when(~empty, TX.is_valid_sql(s)).alias("is_valid"),
                     F.when(~empty, TX.validation_message(s)).alias("message"))


def declared_tables(ddl) -> F.Column:
    """D2 as an array: lower-cased table names created by a DDL text."""
    return F.transform(F.regexp_extract_all(ddl, F.lit(CREATE_TABLE_RE), 1), lambda t: F.lower(F.btrim(t, lit("`\""))))


def schema_grounding(df: DataFrame, sql: str, ddl: str, key: str = "sample_id") -> DataFrame:
    """(key, table) for every table a query refers to that the sample's
    own DDL does not declare. Names are resolved in their scope: a CTE provides
    its name to the query it belongs to (and to later CTEs) only, comma lists,
    quoted and qualified names and every kind of JOIN count, ``FROM`` inside a
    call or after ``IS DISTINCT`` does not. One pass per text, then one explode:
    no join, no shuffle."""
    unknown = F.array_except(sqlscan.references_of(col(sql)), F.coalesce(declared_tables(col(ddl)), F.array().cast("array<string>")))
    return df.select(key, F.explode(unknown).alias("table_name"))


def drop_ungrounded_joins(df: DataFrame, sql: str, ddl: str, out: str = "grounded_sql") -> DataFrame:
    """Remove the JOIN clauses, of any kind, to tables that the DDL does
    not declare and no CTE in scope provides, and unqualify the columns of the
    removed tables inside that query. A first table of FROM is no join: R11
    reports it and it stays."""
    return df.withColumn(out, sqlscan.drop_joins_of(col(sql), declared_tables(col(ddl))))


def dialect_usage(df: DataFrame, sql: str = "sql") -> DataFrame:
    """Number of queries using each foreign idiom, one pass (a sum per
    idiom) then unpivoted; zero counts are kept."""
    flags = DL.idiom_flags(col(sql))
    wide = df.select(*flags).agg(*[F.sum(col(n).cast("bigint")).alias(n) for n, _ in DL.IDIOMS])
    stack = ", ".join(f"'{n}', {n}" for n, _ in DL.IDIOMS)
    return wide.selectExpr(f"stack({len(DL.IDIOMS)}, {stack}) AS (idiom, n_queries)") \
        .select("idiom", F.coalesce(col("n_queries"), lit(0).cast("bigint")).alias("n_queries"))

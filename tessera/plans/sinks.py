"""Bindings for the sinks (S3, S4): write, then read back what was written
(with the schema that was written: no inference pass)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import corpus as C
from tessera.operators import evaluate as EV
from tessera.plans import register
from tessera.plans import fixtures as FX
from tessera.plans.corpus import CX, FORMAT_SQL, SPLIT_CTE
from tessera.plans.evaluate import STATUS_SQL
from tessera.sources import published as PB
from tessera.sources import sinks as SK

col = F.col


@register("write_jsonl", SPLIT_CTE + f"""SELECT instruction, input, output, domain, f.complexity, split
FROM ({FORMAT_SQL}) f JOIN split USING (sample_id)""")
def write_jsonl(spark, d):
    f = C.format_samples(FX.samples(spark, d))
    split = C.quota_split(f, "sample_id", "complexity") \
        .select("instruction", "input", "output", "domain", "complexity", "split")
    out = SK.write_jsonl(split, SK.scratch_path(spark, "processed_data"))
    return spark.read.schema(split.schema).json(out)


@register("write_published", SPLIT_CTE + f"""SELECT instruction, input, output, domain, f.complexity, split
FROM ({FORMAT_SQL}) f JOIN split USING (sample_id)""")
def write_published(spark, d):
    # the same data through a staged commit; read back through its manifest, verified
    f = C.format_samples(FX.samples(spark, d))
    split = C.quota_split(f, "sample_id", "complexity") \
        .select("instruction", "input", "output", "domain", "complexity", "split")
    out = SK.scratch_path(spark, "published_data")
    PB.write(split, out, "json", ("split",))
    return PB.read(spark, out, verify=True)


def _flat(records):
    """One plain row per record read back."""
    return records.select(
        "test_case", "name", "domain", "complexity", "status", "generated_sql", "metrics.*",
        F.array_join("keywords_found", ",").alias("keywords_found"),
        F.array_join("keywords_missing", ",").alias("keywords_missing"), F.array_join("errors", "; ").alias("errors"))


@register("write_eval_results", FX.with_views("eval_results", extra=f"""
r AS (SELECT *, {STATUS_SQL} AS status, {FX.keywords_sql('query_index')} AS kw FROM eval_results)""") + """
SELECT query_index AS test_case, name, domain, complexity, status, sql AS generated_sql, is_valid AS is_syntactically_valid,
 is_executable, keyword_score AS keyword_match_score,
 array_to_string(list_filter(kw, lambda k: contains(upper(sql), upper(k))), ',') AS keywords_found,
 array_to_string(list_filter(kw, lambda k: NOT contains(upper(sql), upper(k))), ',') AS keywords_missing,
 concat_ws('; ', CASE WHEN NOT is_valid THEN validation_message END,
           CASE WHEN NOT is_executable THEN execution_message END, error) AS errors FROM r""")
def write_eval_results(spark, d):
    e = FX.eval_results(spark, d)
    e = e.withColumn("status", EV.case_status(col("has_response"), col("has_sql"), col("is_valid"),
                                              col("is_executable"), col("keyword_score"), col("error"))) \
         .withColumn("validation_error", F.when(~col("is_valid"), col("validation_message"))) \
         .withColumn("execution_error", F.when(~col("is_executable"), col("execution_message"))) \
         .withColumn("expected_keywords", FX.keywords_col("query_index"))
    scored = EV.keyword_match(e.withColumnRenamed("keyword_score", "score"), response="sql") \
        .drop("keyword_score").withColumnRenamed("score", "keyword_score")
    records = SK.eval_record(scored)
    out = SK.write_eval_results(records, SK.scratch_path(spark, "evaluation_results"))
    return _flat(spark.read.schema(records.schema).json(out))

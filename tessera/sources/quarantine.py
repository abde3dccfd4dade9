"""S1 / S6 for files that are not as they should be: every line of a JSON-lines
corpus is accounted for.

A line becomes a sample, or it is quarantined with a reason and its text; fields
that the schema does not know are kept beside the sample as JSON (``rescued``). All
of it is one projection over the lines: no inference pass, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.tables import SAMPLE_SCHEMA

BLANK_LINE, BAD_ENCODING, BAD_JSON, NOT_AN_OBJECT, WRONG_TYPE = \
    "blank line", "not utf-8", "not json", "not an object", "wrong type: "


def _fits(kind: T.DataType, found: Column) -> Column:
    """May a JSON value of the found type stand for a column of this type?"""
    allowed = ["BIGINT"] if isinstance(kind, T.IntegralType) else ["STRING"]
    return found.isin(*allowed, "VOID")


def classify(lines: DataFrame, schema: T.StructType = SAMPLE_SCHEMA, line: str = "value") -> DataFrame:
    """The columns of ``lines`` plus the fields of ``schema``, ``rescued`` (JSON of
    unknown fields, else NULL) and ``reason`` (NULL for a sample). Reasons: blank
    line, not utf-8 (bad bytes, or U+FFFD where they were replaced before), not json (also a key
    given twice, cut off or several values), not an object, wrong type with the
    fields concerned. A missing field or a JSON null is NULL, as the formatting
    operators expect. The fields of a quarantined line are NULL."""
    text = F.col(line)
    # one value and nothing after it: the parser itself stops at the first value's end
    body = F.regexp_replace(text, "^\ufeff", "")
    alone = F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1
    staged = lines.withColumn("_v", F.when(alone, F.try_parse_json(body))).withColumn("_kind", F.schema_of_variant("_v"))
    names = [f.name for f in schema.fields]
    wrong = F.array_compact(F.array(*[
        F.when(~_fits(f.dataType, F.coalesce(F.schema_of_variant(F.try_variant_get("_v", f"$.{f.name}", "variant")), F.lit("VOID"))), F.lit(f.name))
        for f in schema.fields]))
    is_object = F.col("_kind").startswith("OBJECT")
    reason = (F.when(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n")) == "", F.lit(BLANK_LINE))
              .when(~F.is_valid_utf8(text) | F.contains(text, F.lit("\ufffd")), F.lit(BAD_ENCODING))
              .when(F.col("_v").isNull(), F.lit(BAD_JSON)).when(~is_object, F.lit(NOT_AN_OBJECT))
              .when(F.size("_wrong") > 0, F.concat(F.lit(WRONG_TYPE), F.array_join("_wrong", ", "))))
    staged = staged.withColumn("_wrong", F.when(is_object, wrong)).withColumn("reason", reason)
    good = F.col("reason").isNull()
    fields = [F.when(good, F.try_variant_get("_v", f"$.{f.name}", f.dataType.simpleString())).alias(f.name) for f in schema.fields]
    # every unknown field with its value as JSON text
    others = F.array_except(F.json_object_keys(F.to_json("_v")), F.array(*[F.lit(n) for n in names]))
    everything = F.from_json(F.to_json("_v"), "map<string,string>")
    rescued = F.when(good & (F.size(others) > 0), F.to_json(F.map_filter(everything, lambda k, _: F.array_contains(others, k))))
    return staged.select(*[c for c in lines.columns if c not in names], *fields, rescued.alias("rescued"), "reason")


def load_lines(spark: SparkSession, path: str, schema: T.StructType = SAMPLE_SCHEMA) -> DataFrame:
    """``classify`` of all lines of the files at ``path``, with the line itself."""
    return classify(spark.read.text(path).withColumnRenamed("value", "line"), schema, "line")


def samples_of(classified: DataFrame, schema: T.StructType = SAMPLE_SCHEMA) -> DataFrame:
    """The samples, in the schema of the corpus loader."""
    return classified.filter("reason IS NULL").select(*[f.name for f in schema.fields])


def account(classified: DataFrame) -> DataFrame:
    """(reason, n, n_rescued): lines per reason; samples have the reason 'sample'.
    The counts add up to the number of lines."""
    return classified.groupBy(F.coalesce("reason", F.lit("sample")).alias("reason")) \
        .agg(F.count(F.lit(1)).alias("n"), F.count("rescued").alias("n_rescued"))

"""Corpus profiling (B1-B6) as partial-aggregating group-bys.

Nothing materialises the corpus: the upper median comes from a length
histogram (one row per distinct length) instead of a sort of all lengths,
and the full report is one GROUPING SETS scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import word_count

col = F.col
lit = F.lit
UNKNOWN = "unknown"


def distribution(df: DataFrame, column: str, out: str, count_col: str = "n_samples") -> DataFrame:
    """B1 / B2: count per value; missing -> 'unknown'."""
    return df.groupBy(F.coalesce(col(column), lit(UNKNOWN)).alias(out)).agg(
        F.count(lit(1)).alias(count_col))


def length_stats_from_hist(hist: DataFrame, length: str = "len", cnt: str = "c") -> DataFrame:
    """Mean / min / max / upper median (``sorted(xs)[n // 2]``) from a
    (length, count) histogram. The window runs over distinct lengths only."""
    w_all = Window.partitionBy()
    w_cum = Window.partitionBy().orderBy(length).rowsBetween(Window.unboundedPreceding, 0)
    h = (hist.withColumn("_tot", F.sum(cnt).over(w_all))
             .withColumn("_cum", F.sum(cnt).over(w_cum)))
    return (h.agg(F.round(F.sum(col(length) * col(cnt)) / F.sum(cnt), 6).alias("mean_length"),
                  F.min(length).alias("min_length"), F.max(length).alias("max_length"),
                  F.min(F.when(col("_cum") >= F.floor(col("_tot") / 2) + 1, col(length))).alias("median_length"),
                  F.sum(cnt).alias("_n"))
             .filter(col("_n") > 0).drop("_n"))


def query_length_stats(df: DataFrame, sql_col: str = "sql") -> DataFrame:
    """Whitespace word count of the SQL text; empty input -> no row."""
    hist = (df.select(word_count(F.coalesce(col(sql_col), lit(""))).alias("len"))
              .groupBy("len").agg(F.count(lit(1)).alias("c")))
    return length_stats_from_hist(hist)


def corpus_report(df: DataFrame, complexity: str = "sql_complexity", domain: str = "domain",
                  sql_col: str = "sql") -> DataFrame:
    """Total, per-complexity, per-domain counts and SQL length stats in
    long format (metric, key, value) from one scan and one aggregation: each
    row counts once per (metric, key), the length statistics come from the
    histogram rows folded in one final row per metric."""
    facts = F.array(
        F.struct(lit("complexity").alias("metric"), F.coalesce(col(complexity), lit(UNKNOWN)).alias("key"), lit(None).cast("int").alias("len")),
        F.struct(lit("domain").alias("metric"), F.coalesce(col(domain), lit(UNKNOWN)).alias("key"), lit(None).cast("int").alias("len")),
        F.struct(lit("length").alias("metric"), lit(None).cast("string").alias("key"),
                 word_count(F.coalesce(col(sql_col), lit(""))).cast("int").alias("len")))
    hist = df.select(F.explode(facts).alias("f")).select("f.*").groupBy("metric", "key", "len").agg(F.count(lit(1)).alias("c"))
    # counts stay as they are; the lengths (one row per distinct length) are folded per metric
    folded = hist.groupBy("metric", F.when(col("metric") != "length", col("key")).alias("key")).agg(
        F.sum("c").alias("n"), F.sum(col("len") * col("c")).alias("words"), F.min("len").alias("lo"), F.max("len").alias("hi"),
        F.array_sort(F.collect_list(F.when(col("metric") == "length", F.struct("len", "c")))).alias("h"))
    middle = F.floor(col("n") / 2) + 1
    walked = F.aggregate("h", F.struct(lit(0).cast("bigint").alias("cum"), lit(None).cast("int").alias("at")),
                         lambda a, x: F.struct((a["cum"] + x["c"]).alias("cum"),
                                               F.coalesce(a["at"], F.when(a["cum"] + x["c"] >= middle, x["len"])).alias("at")),
                         lambda a: a["at"])
    out = F.when(col("metric") != "length", F.array(
        F.struct(col("metric").alias("metric"), col("key").alias("key"), col("n").cast("double").alias("value")))).otherwise(F.array(*[
            F.struct(lit(m).alias("metric"), lit(None).cast("string").alias("key"), v.cast("double").alias("value"))
            for m, v in [("total_samples", col("n")), ("mean_length", F.round(col("words") / col("n"), 6)),
                         ("min_length", col("lo")), ("max_length", col("hi")), ("median_length", walked)]]))
    return folded.select(F.inline(out))


def min_class_count(df: DataFrame, label: str) -> DataFrame:
    """Smallest stratum, number of classes and total (split guard input)."""
    c = df.groupBy(label).agg(F.count(lit(1)).alias("n_c"))
    return c.agg(F.min("n_c").alias("min_class_count"), F.count(lit(1)).alias("n_classes"),
                 F.sum("n_c").alias("total"))


def cross_matrix(df: DataFrame, rows: str, cols_: str, values: Sequence[str]) -> DataFrame:
    """Rows x columns count matrix; pivot values given explicitly so no
    extra job computes them; absent combinations are 0."""
    p = df.groupBy(rows).pivot(cols_, list(values)).agg(F.count(lit(1)))
    return p.na.fill(0, subset=list(values))

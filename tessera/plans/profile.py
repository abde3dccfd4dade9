"""Bindings for corpus profiling (B1-B6) on the derived ``samples`` view."""

from __future__ import annotations

from tessera.operators import profile as P
from tessera.plans import register
from tessera.plans import fixtures as FX
from tessera.plans.sqltext import word_count as WC

LANGS = ["de", "en", "es", "fr"]


@register("complexity_distribution", FX.with_views("samples") + """
SELECT coalesce(sql_complexity, 'unknown') AS complexity, count(*) AS n_samples FROM samples GROUP BY 1""")
def complexity_distribution(spark, d):
    return P.distribution(FX.samples(spark, d), "sql_complexity", "complexity")


@register("domain_distribution", FX.with_views("samples") + """
SELECT coalesce(domain, 'unknown') AS domain, count(*) AS n_samples FROM samples GROUP BY 1""")
def domain_distribution(spark, d):
    return P.distribution(FX.samples(spark, d), "domain", "domain")


_LEN_CTE = f"""lens AS (SELECT {WC("coalesce(sql, '')")} AS len FROM samples),
hist AS (SELECT len, count(*) AS c FROM lens GROUP BY len),
cum AS (SELECT len, c, sum(c) OVER (ORDER BY len) AS cum, sum(c) OVER () AS tot FROM hist),
stats AS (SELECT round(sum(len * c) / sum(c), 6) AS mean_length, min(len) AS min_length,
  max(len) AS max_length, min(len) FILTER (WHERE cum >= tot // 2 + 1) AS median_length
  FROM cum HAVING sum(c) > 0)"""


@register("query_length_stats", FX.with_views("samples", extra=_LEN_CTE) + "SELECT * FROM stats")
def query_length_stats(spark, d):
    return P.query_length_stats(FX.samples(spark, d))


@register("corpus_report", FX.with_views("samples", extra=_LEN_CTE) + """
SELECT 'total_samples' AS metric, CAST(NULL AS VARCHAR) AS key, CAST(count(*) AS DOUBLE) AS value FROM samples
UNION ALL SELECT 'complexity', coalesce(sql_complexity, 'unknown'), count(*) FROM samples GROUP BY 2
UNION ALL SELECT 'domain', coalesce(domain, 'unknown'), count(*) FROM samples GROUP BY 2
UNION ALL SELECT 'mean_length', NULL, mean_length FROM stats
UNION ALL SELECT 'min_length', NULL, min_length FROM stats
UNION ALL SELECT 'max_length', NULL, max_length FROM stats
UNION ALL SELECT 'median_length', NULL, median_length FROM stats""")
def corpus_report(spark, d):
    return P.corpus_report(FX.samples(spark, d))


@register("min_class_count", FX.with_views("samples") + """
SELECT min(n_c) AS min_class_count, count(*) AS n_classes, CAST(sum(n_c) AS BIGINT) AS total
FROM (SELECT sql_complexity, count(*) AS n_c FROM samples GROUP BY 1)""")
def min_class_count(spark, d):
    return P.min_class_count(FX.samples(spark, d), "sql_complexity")


@register("domain_complexity_matrix", FX.with_views("samples") + "SELECT domain, " + ", ".join(
    f"count(*) FILTER (WHERE sql_complexity = '{v}') AS {v}" for v in LANGS) + " FROM samples GROUP BY domain")
def domain_complexity_matrix(spark, d):
    return P.cross_matrix(FX.samples(spark, d), "domain", "sql_complexity", LANGS)

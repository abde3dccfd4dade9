"""Quantiles per group: a mergeable sketch with a stated error, and exact ones.

The sketch counts values in bins whose bounds grow by the factor
(1 + a) / (1 - a): a bin's representative is within ``a`` (relative) of every value
in it, so a quantile read from the sketch is within ``a`` of the exact one. Two
sketches merge by adding counts, and building one is a hash aggregation over at
most about 76,000 bins a group at a = 1 % (all doubles), a few hundred in practice.

The exact way starts from the sketch, which names the bin that holds each rank and
the least and greatest value in it. Only rows of those ranges are read again, counted
in ``REFINE`` equal ranges each, until the range that holds the rank is one value: one
or two more scans as a rule, seven at most (each narrows 52 bits by 10). No
group's values are sorted, collected or shuffled; counts are.

The rank of quantile p in n values is ceil(p * n), at least 1, as in
``quantile_disc``. Quantiles are given as whole numbers of ``PARTS``-ths, so ranks
are exact. NULL and NaN values are left out; values are doubles.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.sinks import scratch_path

ERROR = 0.01
REFINE = 1024
PARTS = 1000                    # quantile 950 is p95
USUAL = (500, 950, 990)
_OFFSET = 1 << 30               # more than any bin number
_INFINITE = 1 << 29             # bin of an infinite value


def _factor(error: float) -> float:
    return (1 + error) / (1 - error)


def _bin(v: Column, error: float) -> Column:
    """Number of a value's bin, ascending with the value; 0 holds 0."""
    size = F.ceil(F.ln(F.least(F.abs(v), F.lit(sys.float_info.max))) / F.lit(math.log(_factor(error)))).cast("bigint")
    k = F.when(F.abs(v) > sys.float_info.max, _INFINITE).otherwise(size) + _OFFSET
    return F.when(v > 0, k).when(v < 0, -k).otherwise(F.lit(0).cast("bigint"))


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sketch(df: DataFrame, group: Sequence[str], value: str, error: float = ERROR) -> DataFrame:
    """(group, bin, n, low, high): counts per bin and the values it spans."""
    v = F.col(value).cast("double")
    rows = df.select(*group, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return rows.groupBy(*group, _bin(F.col("_v"), error).alias("bin")) \
        .agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))


def merge(a: DataFrame, b: DataFrame, group: Sequence[str]) -> DataFrame:
    """The sketch of the rows of both."""
    return a.unionByName(b).groupBy(*group, "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _targets(counts: DataFrame, group: Sequence[str], quantiles: Sequence[int]) -> DataFrame:
    """(group, p, n, bin, low, high, rank): the bin of each quantile and the rank
    inside it. Windows run over a group's bins, not its rows."""
    w = Window.partitionBy(*group)
    bins = counts.withColumn("total", F.sum("n").over(w)) \
        .withColumn("upto", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    wanted = bins.withColumn("p", F.explode(F.array(*[F.lit(q) for q in quantiles]))) \
        .withColumn("rank", F.greatest(F.lit(1).cast("bigint"), F.expr(f"(p * total + {PARTS - 1}) div {PARTS}")))
    held = wanted.filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
    return held.select(*group, "p", F.col("total").alias("n"), "bin", "low", "high",
                       (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))


def from_sketch(counts: DataFrame, group: Sequence[str], quantiles: Sequence[int] = USUAL, error: float = ERROR) -> DataFrame:
    """(group, p, n, value): quantiles within ``error`` of the exact ones."""
    g = _factor(error)
    size = F.pow(F.lit(g), F.abs("bin") - F.lit(_OFFSET)) * F.lit(2 / (g + 1))
    value = F.when(F.col("bin") == 0, F.lit(0.0)).otherwise(F.signum("bin") * size)
    # never outside the values that the bin holds
    inside = F.greatest(F.col("low"), F.least(F.col("high"), value))
    return _targets(counts, group, quantiles).select(*group, "p", "n", inside.alias("value"))


def exact(df: DataFrame, group: Sequence[str], value: str, quantiles: Sequence[int] = USUAL, error: float = ERROR) -> DataFrame:
    """(group, p, n, value): exact quantiles, by refining the sketch."""
    v = F.col(value).cast("double")
    rows = df.select(*group, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    at = _kept(_targets(sketch(df, group, value, error), group, quantiles), "quantile-targets")
    while at.filter("low < high").limit(1).count():
        # distinct ranges, so that quantiles that share one count it once
        spans = at.filter("low < high").select(*[F.col(g).alias(f"_{g}") for g in group], "low", "high").distinct()
        same = F.lit(True)
        for g in group:
            same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
        part = F.least(F.lit(REFINE - 1), F.floor((F.col("_v") - F.col("low")) / (F.col("high") - F.col("low")) * F.lit(REFINE)))
        counted = rows.join(spans, same & F.col("_v").between(F.col("low"), F.col("high"))) \
            .groupBy(*group, "low", "high", part.alias("part")) \
            .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        w = Window.partitionBy(*group, "low", "high").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        counted = counted.withColumn("_upto", F.sum("_n").over(w)) \
            .select(*[F.col(g).alias(f"_{g}") for g in group], F.col("low").alias("_a"), F.col("high").alias("_b"), "_n", "_low", "_high", "_upto")
        hit = same & (F.col("low") == F.col("_a")) & (F.col("high") == F.col("_b")) \
            & (F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("_n"))
        finer = at.filter("low < high").join(counted, hit).select(
            *group, "p", "n", "bin", F.col("_low").alias("low"), F.col("_high").alias("high"),
            (F.col("rank") - F.col("_upto") + F.col("_n")).alias("rank"))
        at = _kept(at.filter("low = high").unionByName(finer), "quantile-targets")
    return at.select(*group, "p", "n", F.col("low").alias("value"))

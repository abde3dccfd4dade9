"""Bounded lists of frequent things, and tables kept in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

STEPS = 16      # count classes per octave


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def frequent(counts: DataFrame, limit: int, n: str = "n") -> DataFrame:
    """The rows of the highest counts, at most ``limit`` of them, cut between
    count classes (a class is taken whole or not at all). Classes are counted
    first, so no task or driver sees more than ``limit`` rows; counts of 1 are
    never frequent."""
    stored = keep(counts.filter(F.col(n) > 1), "counts")
    step = F.floor(F.log2(F.col(n)) * STEPS)
    least, total = None, 0
    for r in sorted(stored.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):    # at most 64 * STEPS
        total += r["count"]
        if total > limit:
            break
        least = r["s"]
    return stored.filter(step >= F.lit(least)) if least is not None else stored.limit(0)

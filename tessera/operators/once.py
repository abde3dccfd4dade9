"""Work on each distinct text once.

Generated corpora repeat the same schema or query text in many rows. A costly
expression over such a column is computed on the distinct texts and joined back;
where most texts differ it is computed in place. One scan of the column decides,
and also whether the distinct texts are few and short enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPEATS = 2                 # rows per distinct text, at least, to be worth a join
BROADCAST_CHARS = 8 << 20   # of all distinct texts


def per_distinct_text(df: DataFrame, text: str, make: Callable[[Column], Column], out: str) -> DataFrame:
    """``df`` with column ``out`` = ``make(text)``; a NULL text gives NULL, so
    ``make`` must give NULL for it too."""
    n, kinds, longest = df.agg(F.count(text), F.approx_count_distinct(F.xxhash64(text)), F.max(F.length(text))).first()
    if n < REPEATS * kinds:
        return df.withColumn(out, make(F.col(text)))
    made = df.select(F.col(text).alias("_text")).filter(F.col("_text").isNotNull()).distinct() \
        .withColumn(out, make(F.col("_text")))
    if kinds * (longest or 0) <= BROADCAST_CHARS:
        made = F.broadcast(made)
    return df.join(made, F.col(text) == F.col("_text"), "left").drop("_text")

"""Generic analytic operators (Track B shapes) as DataFrame compositions.

Everything here is declarative: Catalyst places the partial aggregates,
pushes the filters into the scan and AQE picks the join strategy from
measured sizes. Only results with a size bound known at plan time (a top-k)
get an explicit broadcast hint.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(cs) -> list[Column]:
    if isinstance(cs, (str, Column)):
        cs = [cs]
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def since(date_col: str, start: _dt.date, end: _dt.date | None = None) -> Column:
    """Half-open date range predicate on a timestamp/date column, written as a
    plain comparison against literals so it is pushed into the Parquet scan
    (``PushedFilters``) rather than wrapped in a function."""
    c = F.col(date_col) >= F.lit(start)
    if end is not None:
        c = c & (F.col(date_col) < F.lit(end))
    return c


def month_key(col: str) -> Column:
    return F.date_format(F.col(col), "yyyy-MM")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top-k: ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject,
    i.e. a per-partition heap of k rows and a k×partitions merge — no global
    sort, no shuffle of the full input."""
    return df.orderBy(*order).limit(k)


def topk_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                   rank_col: str = "rank", salt_buckets: int = 16,
                   salt_on: Sequence[str] | None = None) -> DataFrame:
    """Exact top-k per group that survives a hot group.

    A single ``row_number`` over ``partitionBy(group)`` sorts the whole of the
    largest group in one task. Instead rank first inside (group, salt)
    sub-partitions, keep k per sub-partition, then rank the at most
    k × salt_buckets survivors per group. The overall top-k of a group is
    always inside the union of the sub-partition top-ks, so the result is
    exact; ties are broken by the full ``order`` list, which callers make total.
    """
    salt_src = [F.col(c) for c in (salt_on or df.columns)]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_src), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    local = (salted.withColumn("_r1", F.row_number().over(w1))
             .filter(F.col("_r1") <= k).drop("_r1", "_salt"))
    w2 = Window.partitionBy(*group).orderBy(*order)
    # Filter on the bare row_number so Catalyst can insert a WindowGroupLimit
    # (per-partition pre-limit) ahead of the window.
    return (local.withColumn("_r2", F.row_number().over(w2)).filter(F.col("_r2") <= k)
            .withColumn(rank_col, F.col("_r2").cast("bigint")).drop("_r2"))


def top1_per_group(df: DataFrame, group: Sequence[str], order: Sequence[tuple[str, bool]]) -> DataFrame:
    """Arg-max per group by hash aggregations on one flat numeric key at a time
    (the minimum of a struct, or of a text, would plan a sort aggregation):
    the best value of the first key per group, then of the next key among its
    ties, and so on. Partial aggregation keeps one number per group and task,
    so a hot group costs no sort and no window. ``order``: (column, ascending)
    pairs of numeric columns that make the order total."""
    for c, asc in order:
        best = df.groupBy(*group).agg((F.min if asc else F.max)(c).alias("_best"))
        same = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group]
        df = df.alias("l").join(best.alias("r"), [*same, F.col(f"l.{c}") == F.col("r._best")]).select("l.*")
    return df


def left_join_hot_right(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left outer join whose right side may hold a hot key: AQE cannot split
    the right side of an outer join, but it splits either side of an inner one.
    So the matches are an inner join, and the misses an anti join against the
    distinct right keys (one row per key and task before the exchange)."""
    hits = left.join(right, F.col(left_key) == F.col(right_key))
    keys = right.select(F.col(right_key).alias("_key")).distinct()
    misses = left.join(keys, F.col(left_key) == F.col("_key"), "left_anti")
    return hits.unionByName(misses, allowMissingColumns=True)


SMALL_ROWS = 1_000_000  # rows of a few numbers each that may be broadcast


def small_side(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows (counted, and
    no further than that), so that the other side is not shuffled to meet it."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def period_growth(df: DataFrame, part: Sequence[str], period: str, value: str,
                  out: str = "growth_pct") -> DataFrame:
    """Period-over-period growth: ``lag`` over (part ordered by period) on an
    already aggregated table (one row per part × period, so small), with the
    denominator guarded by ``nullif`` (ANSI mode raises on / 0)."""
    w = Window.partitionBy(*part).orderBy(period)
    prev = F.lag(F.col(value)).over(w)
    return (df.withColumn("prev_value", prev)
              .withColumn(out, F.round(F.lit(100.0) * (F.col(value) - F.col("prev_value"))
                                       / F.nullif(F.col("prev_value"), F.lit(0.0)), 2)))


def above_mean(df: DataFrame, value: str) -> DataFrame:
    """Rows whose ``value`` exceeds the mean of ``value`` over the whole input,
    as an uncorrelated scalar subquery (evaluated once, then a filter)."""
    mean = df.select(F.avg(value)).scalar()
    return df.filter(F.col(value) > mean)

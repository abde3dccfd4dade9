"""First rows and deep pages of an ordered table without merging them in a task.

``orderBy().offset(x).limit(n)`` keeps the best x + n rows of every task and
merges them in one. Beyond ``HEAP_ROWS`` rows the page is found by rank instead:
the key of the first and of the last row wanted are located by counting, and the
page is then a filter. A key is located by refinement: one aggregation counts the
rows of ``BINS`` equal ranges, the range that holds the rank is counted again in
finer ranges, and so on (two to six scans of the key column, of which the later
ones carry a range filter). Rows that tie on the first key are ranked by the next
one. Only bin counts reach the driver.

Keys are numbers without fraction, decimals of up to 18 digits, booleans, dates or
timestamps; with any other key Spark's own top-n is planned. NULLs come first in ascending order and last in descending order, as
Spark sorts them. Rows equal in all keys are taken in the order of a hash of the
whole row, so the same rows come back each time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAP_ROWS = 100_000      # offset + limit that each task may hold
BINS = 4096              # counted at once
TIE = "_tie"


def _number(df: DataFrame, name: str) -> Column | None:
    """The key as a whole number in the same order, None if its type has none."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.IntegralType):
        return c if isinstance(kind, T.LongType) else c.cast("bigint")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (c * F.lit(10 ** kind.scale)).cast("bigint")
    return None


def _keys(rows: DataFrame, order: Sequence[tuple[str, bool]]) -> tuple[list[Column], int]:
    """Whole numbers, never NULL, whose ascending order is the order asked for
    (a hash of the whole row comes last), and the number of rows."""
    counts = rows.agg(F.count(F.lit(1)), *[F.count(c) for c, _ in order]).first()
    out = []
    for (name, ascending), given in zip(order, counts[1:]):
        c = _number(rows, name)
        if given < counts[0]:
            there = F.col(name).isNotNull().cast("int").cast("bigint")
            out.append(there if ascending else -there)
            c = F.coalesce(c, F.lit(0).cast("bigint"))
        out.append(c if ascending else F.bitwise_not(c))
    return [*out, F.col(TIE)], counts[0]


def _located(rows: DataFrame, key: Column, ranks: Sequence[int]) -> list[tuple[int, int, int]]:
    """For each rank (from 1): the key value that has it, its rank among the rows
    of that value, and their number."""
    rows = rows.select(key.alias("_k"))
    edge = rows.agg(F.min("_k"), F.max("_k"), F.count("_k")).first()
    spans = [(edge[0], edge[1], r, edge[2]) for r in ranks]
    while any(a < b for a, b, _, _ in spans):
        todo = sorted({(a, b, n) for a, b, _, n in spans if a < b})     # equal or disjoint
        part = None
        for k, (a, b, n) in enumerate(todo):
            if n <= BINS:
                step = F.col("_k")                                      # few rows: their values
            else:
                width = -(-(b - a + 1) // BINS)
                far = F.col("_k").cast("decimal(20,0)") if b - a >= 2**62 else F.col("_k")
                step = F.floor((far - F.lit(a)) / F.lit(width)).cast("bigint") if b - a >= 2**52 else F.expr(f"(_k - {a}) div {width}")
            one = F.struct(F.lit(k).alias("span"), step.alias("part"))
            part = F.when(F.col("_k").between(a, b), one) if part is None else part.when(F.col("_k").between(a, b), one)
        inside = F.lit(False)
        for a, b, _ in todo:
            inside = inside | F.col("_k").between(a, b)
        counted = rows.filter(inside).groupBy(part.alias("at")).agg(F.min("_k").alias("a"), F.max("_k").alias("b"), F.count("_k").alias("n")) \
            .collect()                                                  # at most BINS rows a span
        counted.sort(key=lambda r: (r["at"]["span"], r["a"]))
        found = []
        for a, b, rank, n in spans:
            if a < b:
                for r in (r for r in counted if r["at"]["span"] == todo.index((a, b, n))):
                    if rank <= r["n"]:
                        found.append((r["a"], r["b"], rank, r["n"]))
                        break
                    rank -= r["n"]
            else:
                found.append((a, b, rank, n))
        spans = found
    return [(a, rank, n) for a, _, rank, n in spans]


def _after(keys: list[Column], cut: list[int], at: bool) -> Column:
    """Rows after a cut in the order of the keys, and those ``at`` it too. Keys
    past the cut's length do not count."""
    keys = keys[:len(cut)]
    last = keys[-1] >= F.lit(cut[-1]) if at else keys[-1] > F.lit(cut[-1])
    for k, c in zip(reversed(keys[:-1]), reversed(cut[:-1])):
        last = (k > F.lit(c)) | ((k == F.lit(c)) & last)
    return last


def _equal(keys: list[Column], cut: list[int]) -> Column:
    out = F.lit(True)
    for k, c in zip(keys, cut):
        out = out & (k == F.lit(c))
    return out


def _cuts(rows: DataFrame, keys: list[Column], ranks: list[int]) -> list[tuple[list[int], int, int]]:
    """For each rank: the leading key values of its row, as many as it takes to
    name it or all, its rank among the rows that have them, and their number."""
    out = []
    for value, rank, n in _located(rows, keys[0], ranks):
        if n == 1 or len(keys) == 1:
            out.append(([value], rank, n))
        else:
            (rest, rank, n), = _cuts(rows.filter(keys[0] == F.lit(value)), keys[1:], [rank])
            out.append(([value, *rest], rank, n))
    return out


def _some(equal: DataFrame, n: int) -> DataFrame:
    """``n`` of rows that are equal in all keys and in the hash of the whole row:
    copies of one row, unless hashes clash."""
    if equal.distinct().limit(2).count() == 1:
        return equal.limit(1).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(n)))).drop("_copy")
    return equal.limit(n)


def page(df: DataFrame, order: Sequence[tuple[str, bool]], offset: int, limit: int, heap_rows: int = HEAP_ROWS) -> DataFrame:
    """Rows ``offset`` + 1 to ``offset`` + ``limit`` in ``order`` ((column,
    ascending) pairs), sorted."""
    sort = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    if offset + limit <= heap_rows or any(_number(df, c) is None for c, _ in order):
        return df.orderBy(*sort).offset(offset).limit(limit)
    rows = df.withColumn(TIE, F.shiftrightunsigned(F.xxhash64(*df.columns), 1))
    keys, total = _keys(rows, order)
    if offset >= total or limit <= 0:
        return df.limit(0)
    ends = ([offset + 1] if offset else []) + ([offset + limit] if offset + limit < total else [])
    cuts = _cuts(rows, keys, ends) if ends else []
    taken, parts = F.lit(True), []          # rows taken by their keys; parts of groups of equal rows
    first, last = cuts[0] if offset else None, cuts[-1] if offset + limit < total else None
    if first and last and first[0] == last[0]:
        return (rows.filter(_equal(keys, first[0])) if limit == first[2] else _some(rows.filter(_equal(keys, first[0])), limit)).drop(TIE)
    if first:
        cut, rank, n = first
        taken = taken & _after(keys, cut, rank == 1)
        if rank > 1:
            parts.append(_some(rows.filter(_equal(keys, cut)), n - rank + 1))
    if last:
        cut, rank, n = last
        taken = taken & ~_after(keys, cut, rank < n)
        if rank < n:
            parts.append(_some(rows.filter(_equal(keys, cut)), rank))
    out = rows.filter(taken)
    for p in parts:
        out = out.unionByName(p)
    return out.drop(TIE).orderBy(*sort)

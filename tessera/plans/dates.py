"""Bindings for the date / time functions (F1-F11) on orders, lineitem and
events timestamps."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from tessera.functions import dates as DT
from tessera.plans import register
from tessera.plans.params import AS_OF, sql_date
from tessera.sources.tables import table as T

col = F.col
ASOF = sql_date(AS_OF)
ASOF_TS = f"CAST({ASOF} AS TIMESTAMP)"


@register("fn_now", f"""SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), {ASOF}) AS INTEGER) AS days_ago
FROM orders""")
def fn_now(spark, d):
    o = T(spark, d, "orders")
    return o.select("o_orderkey", F.datediff(DT.now_as_of(), col("o_orderdate").cast("date")).alias("days_ago"))


@register("fn_interval_arith", """SELECT o_orderkey, o_orderdate + INTERVAL 7 DAY AS plus_7d,
 o_orderdate - INTERVAL 1 MONTH AS minus_1m, o_orderdate + INTERVAL 1 YEAR AS plus_1y,
 o_orderdate - INTERVAL 2 HOUR AS minus_2h FROM orders""")
def fn_interval_arith(spark, d):
    o = col("o_orderdate")
    return T(spark, d, "orders").select(
        "o_orderkey", (o + F.expr("INTERVAL 7 DAYS")).alias("plus_7d"),
        (o - F.expr("INTERVAL 1 MONTH")).alias("minus_1m"), (o + F.expr("INTERVAL 1 YEAR")).alias("plus_1y"),
        (o - F.expr("INTERVAL 2 HOURS")).alias("minus_2h"))


# Date results are emitted as ISO text, as the reference's SQLite returns them.
# (The oracle avoids several "CAST(x AS DATE) - INTERVAL ..." terms in one
# SELECT: DuckDB 2.0 merges them as one common subexpression.)
@register("fn_date_sub_add", """SELECT l_orderkey, l_linenumber,
 strftime(CAST(l_shipdate AS DATE) - 30, '%Y-%m-%d') AS minus_30d,
 strftime(CAST(l_shipdate AS DATE) + 7, '%Y-%m-%d') AS plus_7d,
 strftime(CAST(l_shipdate - INTERVAL 1 MONTH AS DATE), '%Y-%m-%d') AS minus_1m FROM lineitem""")
def fn_date_sub_add(spark, d):
    s = col("l_shipdate").cast("date")
    return T(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", _iso(F.date_sub(s, 30)).alias("minus_30d"),
        _iso(F.date_add(s, 7)).alias("plus_7d"), _iso(F.add_months(s, -1)).alias("minus_1m"))


def _iso(c):
    return F.date_format(c, "yyyy-MM-dd")


@register("fn_to_date", "SELECT event_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS event_date FROM events")
def fn_to_date(spark, d):
    return T(spark, d, "events").select("event_id", _iso(F.to_date("ts")).alias("event_date"))


@register("fn_date_format", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym,
 strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS full_ts, strftime(o_orderdate, '%B %Y') AS month_year
FROM orders""")
def fn_date_format(spark, d):
    o = col("o_orderdate")
    return T(spark, d, "orders").select(
        "o_orderkey", DT.date_format_mysql(o, "%Y-%m").alias("ym"),
        DT.date_format_mysql(o, "%Y-%m-%d %H:%i:%s").alias("full_ts"),
        DT.date_format_mysql(o, "%M %Y").alias("month_year"))


def _approx_sql(unit, a, b):
    days = f"((epoch_us({b}) - epoch_us({a})) / 86400000000.0)"
    if unit in DT.APPROX_DAYS_PER:
        e = f"({days} / {DT.APPROX_DAYS_PER[unit]})"
    else:
        e = f"({days} * {float(DT.APPROX_MULT.get(unit, 1))})"
    return f"CAST(trunc({e}) AS BIGINT)"


_UNITS = ["YEAR", "MONTH", "DAY", "HOUR", "MINUTE"]


@register("fn_timestampdiff_approx", "SELECT o_orderkey, " + ", ".join(
    f"{_approx_sql(u, 'o_orderdate', ASOF_TS)} AS {u.lower()}s" for u in _UNITS) + " FROM orders")
def fn_timestampdiff_approx(spark, d):
    a = F.lit(AS_OF).cast("timestamp_ntz")
    return T(spark, d, "orders").select(
        "o_orderkey", *[DT.timestampdiff_approx(u, "o_orderdate", a).alias(f"{u.lower()}s") for u in _UNITS])


@register("fn_timestampdiff_exact", "SELECT o_orderkey, " + ", ".join(
    f"CAST(date_sub('{u.lower()}', o_orderdate, {ASOF_TS}) AS BIGINT) AS {u.lower()}s" for u in _UNITS) +
    " FROM orders")
def fn_timestampdiff_exact(spark, d):
    a = F.lit(AS_OF).cast("timestamp_ntz")
    return T(spark, d, "orders").select(
        "o_orderkey", *[DT.timestampdiff_exact(u, "o_orderdate", a).alias(f"{u.lower()}s") for u in _UNITS])


@register("fn_datediff", """SELECT l.l_orderkey, l.l_linenumber,
 CAST(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) AS INTEGER) AS ship_days,
 CAST(trunc((epoch_us(l.l_shipdate) - epoch_us(o.o_orderdate)) / 86400000000.0) AS BIGINT) AS ship_days_trunc
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""")
def fn_datediff(spark, d):
    li = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = T(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return li.join(o, col("o_orderkey") == col("l_orderkey")).select(
        "l_orderkey", "l_linenumber", DT.datediff_days("l_shipdate", "o_orderdate").alias("ship_days"),
        DT.datediff_truncated("l_shipdate", "o_orderdate").alias("ship_days_trunc"))


@register("fn_date_parts", """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y,
 CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d FROM orders""")
def fn_date_parts(spark, d):
    o = col("o_orderdate")
    return T(spark, d, "orders").select("o_orderkey", F.year(o).alias("y"), F.month(o).alias("m"),
                                        F.dayofmonth(o).alias("d"))


@register("fn_extract", """SELECT event_id, CAST(extract(year FROM ts) AS INTEGER) AS y,
 CAST(extract(month FROM ts) AS INTEGER) AS m, CAST(extract(day FROM ts) AS INTEGER) AS d,
 CAST(extract(hour FROM ts) AS INTEGER) AS h FROM events""")
def fn_extract(spark, d):
    t = col("ts")
    return T(spark, d, "events").select(
        "event_id", *[F.extract(F.lit(u), t).cast("int").alias(a) for u, a in
                      [("YEAR", "y"), ("MONTH", "m"), ("DAY", "d"), ("HOUR", "h")]])


@register("fn_strftime_compare", """SELECT o_orderstatus, count(*) AS n_orders FROM orders
WHERE strftime(o_orderdate, '%Y') = '2000' GROUP BY o_orderstatus""")
def fn_strftime_compare(spark, d):
    # strftime('%Y', x) = 2000 as a half-open date range: it reaches the Parquet reader
    o = T(spark, d, "orders")
    return (o.filter((col("o_orderdate") >= F.lit(_dt.date(2000, 1, 1))) & (col("o_orderdate") < F.lit(_dt.date(2001, 1, 1))))
            .groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders")))


@register("fn_age_years", f"""SELECT CAST(date_sub('year', o_orderdate, {ASOF_TS}) AS BIGINT) AS age_years,
 count(*) AS n_orders FROM orders GROUP BY 1""")
def fn_age_years(spark, d):
    o = T(spark, d, "orders")
    return o.groupBy(DT.age_years("o_orderdate").alias("age_years")).agg(F.count(F.lit(1)).alias("n_orders"))

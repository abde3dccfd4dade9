"""Track B: the analytic query shapes the reference asks for (Q1-Q37),
bound to the driver tables. Each has a DuckDB oracle."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from tessera.operators import analytics as A
from tessera.operators.paging import page
from tessera.plans import register
from tessera.plans.params import (D7, D30, DAY_AFTER, M3, M6, M12, M24,
                                  NEXT_YEAR_START, YEAR_START, month_start,
                                  next_month_start, sql_date)
from tessera.sources.tables import table as T

col = F.col


def _d(x: _dt.date) -> str:
    return sql_date(x)


# ---------------------------------------------------------------- scans / filters

@register("select_all", "SELECT * FROM customer")
def select_all(spark, d):
    return T(spark, d, "customer")


@register("filter_eq", "SELECT * FROM part WHERE p_type = 'ECONOMY'")
def filter_eq(spark, d):
    return T(spark, d, "part").filter(col("p_type") == "ECONOMY")


@register("filter_conj", """
SELECT c_custkey, c_name, c_acctbal FROM customer
WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000""")
def filter_conj(spark, d):
    return (T(spark, d, "customer")
            .filter((col("c_mktsegment") == "BUILDING") & (col("c_acctbal") > 5000))
            .select("c_custkey", "c_name", "c_acctbal"))


# SQLite's LIKE is case-insensitive, so the reference's LIKE means ILIKE.
@register("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%widget'")
def filter_like(spark, d):
    return T(spark, d, "part").filter(col("p_name").ilike("%widget")).select("p_partkey", "p_name")


@register("filter_order", """
SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_retailprice < 950
ORDER BY p_retailprice, p_partkey""")
def filter_order(spark, d):
    return (T(spark, d, "part").filter(col("p_retailprice") < 950)
            .select("p_partkey", "p_name", "p_retailprice")
            .orderBy("p_retailprice", "p_partkey"))


@register("last_n_days", f"""
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders
WHERE o_orderdate >= {_d(D30)} AND o_orderstatus = 'F'""")
def last_n_days(spark, d):
    return (T(spark, d, "orders")
            .filter(A.since("o_orderdate", D30) & (col("o_orderstatus") == "F"))
            .select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"))


@register("hired_last_year", f"""
SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate >= {_d(M12)}""")
def hired_last_year(spark, d):
    return (T(spark, d, "orders").filter(A.since("o_orderdate", M12))
            .select("o_orderkey", "o_custkey", "o_orderdate"))


@register("top_n_agg", """
WITH t AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey
           ORDER BY s DESC, o_custkey LIMIT 5)
SELECT c.c_custkey, c.c_name, c.c_nationkey, round(t.s, 2) AS total_value
FROM t JOIN customer c ON c.c_custkey = t.o_custkey""")
def top_n_agg(spark, d):
    # Aggregate the big side first, keep k rows (TakeOrdered), then attach
    # customer attributes to those k rows only: the broadcast side is k rows.
    per = T(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    top = A.top_k(per, [col("s").desc(), col("o_custkey")], 5)
    return (T(spark, d, "customer").join(F.broadcast(top), col("c_custkey") == col("o_custkey"))
            .select("c_custkey", "c_name", "c_nationkey", F.round("s", 2).alias("total_value")))


@register("limit_offset", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 10""")
def limit_offset(spark, d):
    return page(T(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), [("o_orderkey", True)], 10, 5)


# The middle third by date, newest first, as a page that no task merges.
@register("deep_page", """
SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey
LIMIT (SELECT count(*) // 3 FROM orders) OFFSET (SELECT count(*) // 3 FROM orders)""")
def deep_page(spark, d):
    o = T(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    third = o.count() // 3
    return page(o, [("o_orderdate", False), ("o_orderkey", True)], third, third, heap_rows=0)


@register("null_test", f"""
SELECT c.c_custkey, o.o_orderkey IS NULL AS no_recent_order,
       coalesce(o.o_totalprice, 0.0) AS recent_total
FROM customer c LEFT JOIN (SELECT o_orderkey, o_custkey, o_totalprice FROM orders
                           WHERE o_orderdate >= {_d(D30)}) o ON c.c_custkey = o.o_custkey""")
def null_test(spark, d):
    recent = T(spark, d, "orders").filter(A.since("o_orderdate", D30))
    return (A.left_join_hot_right(T(spark, d, "customer").select("c_custkey"),
                                  recent.select("o_custkey", "o_orderkey", "o_totalprice"), "c_custkey", "o_custkey")
            .select("c_custkey", col("o_orderkey").isNull().alias("no_recent_order"),
                    F.coalesce(col("o_totalprice"), F.lit(0.0)).alias("recent_total")))


# ---------------------------------------------------------------- aggregation

@register("count_all", "SELECT count(*) AS n_orders FROM orders")
def count_all(spark, d):
    return T(spark, d, "orders").agg(F.count(F.lit(1)).alias("n_orders"))


@register("sum_all", "SELECT round(sum(o_totalprice), 2) AS total_revenue FROM orders")
def sum_all(spark, d):
    return T(spark, d, "orders").agg(F.round(F.sum("o_totalprice"), 2).alias("total_revenue"))


@register("sum_by_key", """
SELECT l_partkey, round(sum(l_quantity), 2) AS total_quantity FROM lineitem GROUP BY l_partkey""")
def sum_by_key(spark, d):
    return (T(spark, d, "lineitem").groupBy("l_partkey")
            .agg(F.round(F.sum("l_quantity"), 2).alias("total_quantity")))


@register("headcount_by_group", """
SELECT c_mktsegment, count(*) AS headcount FROM customer GROUP BY c_mktsegment""")
def headcount_by_group(spark, d):
    return T(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("headcount"))


@register("avg_by_group", """
SELECT c_mktsegment, round(avg(c_acctbal), 2) AS avg_acctbal FROM customer GROUP BY c_mktsegment""")
def avg_by_group(spark, d):
    return (T(spark, d, "customer").groupBy("c_mktsegment")
            .agg(F.round(F.avg("c_acctbal"), 2).alias("avg_acctbal")))


@register("revenue_by_month_ytd", f"""
SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS revenue
FROM orders WHERE o_orderdate >= {_d(YEAR_START)} AND o_orderdate < {_d(NEXT_YEAR_START)}
GROUP BY 1 ORDER BY 1""")
def revenue_by_month_ytd(spark, d):
    # year(o_orderdate) = year(as_of) written as a range so it reaches the scan
    return (T(spark, d, "orders").filter(A.since("o_orderdate", YEAR_START, NEXT_YEAR_START))
            .groupBy(A.month_key("o_orderdate").alias("month"))
            .agg(F.round(F.sum("o_totalprice"), 2).alias("revenue")).orderBy("month"))


@register("revenue_by_month_trailing", f"""
SELECT strftime(l_shipdate, '%Y-%m') AS month,
       round(sum(l_quantity * l_extendedprice), 2) AS revenue
FROM lineitem WHERE l_shipdate >= {_d(M12)} GROUP BY 1 ORDER BY 1""")
def revenue_by_month_trailing(spark, d):
    return (T(spark, d, "lineitem").filter(A.since("l_shipdate", M12))
            .groupBy(A.month_key("l_shipdate").alias("month"))
            .agg(F.round(F.sum(col("l_quantity") * col("l_extendedprice")), 2).alias("revenue"))
            .orderBy("month"))


@register("revenue_by_month_fixed_year", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS revenue
FROM orders WHERE o_orderdate >= DATE '2000-01-01' AND o_orderdate < DATE '2001-01-01'
GROUP BY 1 ORDER BY 1""")
def revenue_by_month_fixed_year(spark, d):
    return (T(spark, d, "orders")
            .filter(A.since("o_orderdate", _dt.date(2000, 1, 1), _dt.date(2001, 1, 1)))
            .groupBy(A.month_key("o_orderdate").alias("month"))
            .agg(F.round(F.sum("o_totalprice"), 2).alias("revenue")).orderBy("month"))


@register("current_month_total", f"""
SELECT round(sum(o_totalprice), 2) AS total_sales, count(*) AS n_orders FROM orders
WHERE o_orderdate >= {_d(month_start())} AND o_orderdate < {_d(next_month_start())}""")
def current_month_total(spark, d):
    return (T(spark, d, "orders").filter(A.since("o_orderdate", month_start(), next_month_start()))
            .agg(F.round(F.sum("o_totalprice"), 2).alias("total_sales"),
                 F.count(F.lit(1)).alias("n_orders")))


@register("conditional_totals", f"""
SELECT o_orderpriority,
  round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END), 2) AS finished_total,
  round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0.0 END), 2) AS open_total
FROM orders WHERE o_orderdate >= {_d(month_start())} AND o_orderdate < {_d(next_month_start())}
GROUP BY o_orderpriority""")
def conditional_totals(spark, d):
    def part(s):
        return F.round(F.sum(F.when(col("o_orderstatus") == s, col("o_totalprice"))
                             .otherwise(F.lit(0.0))), 2)
    return (T(spark, d, "orders").filter(A.since("o_orderdate", month_start(), next_month_start()))
            .groupBy("o_orderpriority")
            .agg(part("F").alias("finished_total"), part("O").alias("open_total")))


@register("over_budget", """
WITH per AS (SELECT c.c_nationkey AS nationkey, sum(o.o_totalprice) AS total
             FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey),
     m AS (SELECT avg(total) AS mean_total FROM per)
SELECT n.n_name, round(per.total, 2) AS total, round(m.mean_total, 2) AS mean_total
FROM per JOIN nation n ON n.n_nationkey = per.nationkey, m
WHERE per.total > m.mean_total""")
def over_budget(spark, d):
    # Pre-aggregate orders per customer before the customer join, so the join
    # sees one row per customer instead of one per order.
    per_cust = T(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    per = (per_cust.join(T(spark, d, "customer"), col("o_custkey") == col("c_custkey"))
           .groupBy(col("c_nationkey").alias("nationkey")).agg(F.sum("t").alias("total")))
    mean = per.select(F.avg("total")).scalar()
    nation = F.broadcast(T(spark, d, "nation"))  # 25 rows by definition
    return (per.filter(col("total") > mean)
            .join(nation, col("n_nationkey") == col("nationkey"))
            .select("n_name", F.round("total", 2).alias("total"),
                    F.round(mean, 2).alias("mean_total")))


# ---------------------------------------------------------------- joins

@register("inner_join", """
SELECT c.c_name, o.o_orderkey, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey""")
def inner_join(spark, d):
    return (T(spark, d, "customer").join(T(spark, d, "orders"), col("c_custkey") == col("o_custkey"))
            .select("c_name", "o_orderkey", "o_totalprice"))


@register("left_join", f"""
SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice
FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_orderdate >= {_d(D30)}) o
ON c.c_custkey = o.o_custkey""")
def left_join(spark, d):
    recent = T(spark, d, "orders").filter(A.since("o_orderdate", D30))
    return (A.left_join_hot_right(T(spark, d, "customer").select("c_custkey", "c_name"),
                                  recent.select("o_custkey", "o_orderkey", "o_totalprice"), "c_custkey", "o_custkey")
            .select("c_custkey", "c_name", "o_orderkey", "o_totalprice"))


@register("left_join_agg", f"""
SELECT c.c_custkey, c.c_name, round(coalesce(sum(o.o_totalprice), 0.0), 2) AS recent_total
FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_orderdate >= {_d(D30)}) o
ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey, c.c_name""")
def left_join_agg(spark, d):
    recent = (T(spark, d, "orders").filter(A.since("o_orderdate", D30))
              .groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s")))
    return (T(spark, d, "customer").join(recent, col("c_custkey") == col("o_custkey"), "left")
            .select("c_custkey", "c_name",
                    F.round(F.coalesce(col("s"), F.lit(0.0)), 2).alias("recent_total")))


@register("multi_join", """
SELECT c.c_custkey, c.c_name, round(sum(l.l_quantity * p.p_retailprice), 2) AS total_value,
       count(*) AS n_items
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey
GROUP BY c.c_custkey, c.c_name""")
def multi_join(spark, d):
    li = T(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    valued = (li.join(T(spark, d, "part").select("p_partkey", "p_retailprice"),
                      col("l_partkey") == col("p_partkey"))
              .join(T(spark, d, "orders").select("o_orderkey", "o_custkey"),
                    col("l_orderkey") == col("o_orderkey")))
    per = valued.groupBy("o_custkey").agg(
        F.sum(col("l_quantity") * col("p_retailprice")).alias("v"), F.count(F.lit(1)).alias("n_items"))
    return (per.join(T(spark, d, "customer"), col("o_custkey") == col("c_custkey"))
            .select("c_custkey", "c_name", F.round("v", 2).alias("total_value"), "n_items"))


@register("join_avg", """
SELECT p.p_brand, round(avg(l.l_quantity), 4) AS avg_quantity
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY p.p_brand""")
def join_avg(spark, d):
    # avg is not decomposable by partkey, so carry (sum, count) per part first.
    per_part = T(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("s"), F.count(F.lit(1)).alias("n"))
    return (per_part.join(T(spark, d, "part"), col("l_partkey") == col("p_partkey"))
            .groupBy("p_brand").agg(F.round(F.sum("s") / F.sum("n"), 4).alias("avg_quantity")))


@register("join_two_filters", f"""
SELECT c.c_name, o.o_orderkey, o.o_totalprice, o.o_orderdate
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
WHERE o.o_totalprice > 300000 AND o.o_orderdate >= {_d(M24)}""")
def join_two_filters(spark, d):
    o = T(spark, d, "orders").filter((col("o_totalprice") > 300000) & A.since("o_orderdate", M24))
    return (o.join(T(spark, d, "customer"), col("c_custkey") == col("o_custkey"))
            .select("c_name", "o_orderkey", "o_totalprice", "o_orderdate"))


@register("semi_join_filtered", f"""
SELECT c_custkey, c_name, c_acctbal FROM customer c
WHERE c_acctbal > 5000 AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
  AND o.o_orderdate >= {_d(D7)} AND o.o_orderdate < {_d(DAY_AFTER)})""")
def semi_join_filtered(spark, d):
    # distinct keys first: a hot customer is one row per task before the exchange
    week = T(spark, d, "orders").filter(A.since("o_orderdate", D7, DAY_AFTER)).select("o_custkey").distinct()
    return (T(spark, d, "customer").filter(col("c_acctbal") > 5000)
            .join(week, col("c_custkey") == col("o_custkey"), "left_semi")
            .select("c_custkey", "c_name", "c_acctbal"))


@register("low_stock_suppliers", """
SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, s.s_suppkey, s.s_name
FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE l.l_quantity < 10""")
def low_stock_suppliers(spark, d):
    return (T(spark, d, "lineitem").filter(col("l_quantity") < 10)
            .join(T(spark, d, "supplier"), col("s_suppkey") == col("l_suppkey"))
            .select("l_orderkey", "l_linenumber", "l_quantity", "s_suppkey", "s_name"))


@register("anti_join", f"""
SELECT p_partkey, p_name FROM part p WHERE NOT EXISTS
 (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_shipdate >= {_d(D30)})""")
def anti_join(spark, d):
    recent = T(spark, d, "lineitem").filter(A.since("l_shipdate", D30)).select("l_partkey").distinct()
    return (T(spark, d, "part").join(recent, col("p_partkey") == col("l_partkey"), "left_anti")
            .select("p_partkey", "p_name"))


@register("revenue_by_customer", """
SELECT c.c_custkey, c.c_name, round(sum(o.o_totalprice), 2) AS revenue
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey, c.c_name""")
def revenue_by_customer(spark, d):
    per = T(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    return (per.join(T(spark, d, "customer"), col("o_custkey") == col("c_custkey"))
            .select("c_custkey", "c_name", F.round("s", 2).alias("revenue")))


@register("top_products_revenue", f"""
WITH t AS (SELECT l_partkey, sum(l_extendedprice * (1 - l_discount)) AS r FROM lineitem
           WHERE l_shipdate >= {_d(M3)} GROUP BY l_partkey ORDER BY r DESC, l_partkey LIMIT 5)
SELECT p.p_partkey, p.p_name, round(t.r, 2) AS revenue FROM t JOIN part p ON p.p_partkey = t.l_partkey""")
def top_products_revenue(spark, d):
    per = (T(spark, d, "lineitem").filter(A.since("l_shipdate", M3)).groupBy("l_partkey")
           .agg(F.sum(col("l_extendedprice") * (1 - col("l_discount"))).alias("r")))
    top = A.top_k(per, [col("r").desc(), col("l_partkey")], 5)
    return (T(spark, d, "part").join(F.broadcast(top), col("p_partkey") == col("l_partkey"))
            .select("p_partkey", "p_name", F.round("r", 2).alias("revenue")))


@register("topk_per_group", """
WITH q AS (SELECT l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_partkey),
r AS (SELECT p.p_brand, p.p_partkey, q.qty,
        row_number() OVER (PARTITION BY p.p_brand ORDER BY q.qty DESC, p.p_partkey) AS rank
      FROM q JOIN part p ON p.p_partkey = q.l_partkey)
SELECT p_brand, p_partkey, round(qty, 2) AS total_quantity, rank FROM r WHERE rank <= 10""")
def topk_per_group(spark, d):
    q = T(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty"))
    j = q.join(T(spark, d, "part"), col("p_partkey") == col("l_partkey")).select("p_brand", "p_partkey", "qty")
    r = A.topk_per_group(j, ["p_brand"], [col("qty").desc(), col("p_partkey")], 10,
                         salt_on=["p_partkey"])
    return r.select("p_brand", "p_partkey", F.round("qty", 2).alias("total_quantity"), "rank")


@register("argmax_per_group", """
WITH top AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey
             ORDER BY s DESC, o_custkey LIMIT 5),
bought AS (SELECT o.o_custkey, l.l_partkey, sum(l.l_quantity) AS qty
           FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
           WHERE o.o_custkey IN (SELECT o_custkey FROM top) GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY qty DESC, l_partkey) AS rn FROM bought)
SELECT c.c_custkey, c.c_name, round(top.s, 2) AS total_value, p.p_partkey, p.p_name,
       round(best.qty, 2) AS quantity
FROM top JOIN customer c ON c.c_custkey = top.o_custkey
JOIN best ON best.o_custkey = top.o_custkey AND best.rn = 1
JOIN part p ON p.p_partkey = best.l_partkey""")
def argmax_per_group(spark, d):
    orders = T(spark, d, "orders")
    per = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    top = A.top_k(per, [col("s").desc(), col("o_custkey")], 5)
    top_orders = orders.join(F.broadcast(top.select("o_custkey")), "o_custkey", "left_semi") \
        .select("o_orderkey", "o_custkey")
    # the orders of five customers: broadcast when they are few, as lineitem then stays where it is
    bought = (T(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
              .join(A.small_side(top_orders), col("l_orderkey") == col("o_orderkey"))
              .groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").alias("qty")))
    best = A.top1_per_group(bought, ["o_custkey"], [("qty", False), ("l_partkey", True)])
    return (F.broadcast(top).join(best, "o_custkey")
            .join(T(spark, d, "customer"), col("c_custkey") == col("o_custkey"))
            .join(T(spark, d, "part"), col("p_partkey") == col("l_partkey"))
            .select("c_custkey", "c_name", F.round("s", 2).alias("total_value"), "p_partkey",
                    "p_name", F.round("qty", 2).alias("quantity")))


@register("top_customers_filtered", f"""
WITH t AS (SELECT o.o_custkey, sum(o.o_totalprice) AS s FROM orders o
           JOIN customer c ON c.c_custkey = o.o_custkey
           WHERE c.c_nationkey = 7 AND o.o_orderdate >= {_d(M6)}
           GROUP BY o.o_custkey ORDER BY s DESC, o.o_custkey LIMIT 5)
SELECT c.c_custkey, c.c_name, round(t.s, 2) AS total_value FROM t JOIN customer c ON c.c_custkey = t.o_custkey""")
def top_customers_filtered(spark, d):
    cust = T(spark, d, "customer").filter(col("c_nationkey") == 7)
    o = (T(spark, d, "orders").filter(A.since("o_orderdate", M6))
         .join(cust.select("c_custkey"), col("o_custkey") == col("c_custkey"), "left_semi"))
    per = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    top = A.top_k(per, [col("s").desc(), col("o_custkey")], 5)
    return (cust.join(F.broadcast(top), col("c_custkey") == col("o_custkey"))
            .select("c_custkey", "c_name", F.round("s", 2).alias("total_value")))


@register("scalar_subquery", """
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)""")
def scalar_subquery(spark, d):
    return A.above_mean(T(spark, d, "customer"), "c_acctbal").select("c_custkey", "c_name", "c_acctbal")


@register("growth_lag", """
WITH m AS (SELECT c.c_mktsegment AS segment, strftime(o.o_orderdate, '%Y-%m') AS month,
                  sum(o.o_totalprice) AS total
           FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
           WHERE o.o_orderdate >= DATE '2001-01-01' AND o.o_orderdate < DATE '2002-01-01'
           GROUP BY 1, 2)
SELECT segment, month, round(total, 2) AS total, round(prev, 2) AS prev_total,
       round(100.0 * (total - prev) / nullif(prev, 0.0), 2) AS growth_pct
FROM (SELECT *, lag(total) OVER (PARTITION BY segment ORDER BY month) AS prev FROM m)""")
def growth_lag(spark, d):
    o = T(spark, d, "orders").filter(A.since("o_orderdate", _dt.date(2001, 1, 1), _dt.date(2002, 1, 1)))
    # one row per customer and month meets the customers, not one per order
    per = o.groupBy("o_custkey", A.month_key("o_orderdate").alias("month")).agg(F.sum("o_totalprice").alias("s"))
    m = (per.join(T(spark, d, "customer"), col("c_custkey") == col("o_custkey"))
         .groupBy(col("c_mktsegment").alias("segment"), "month").agg(F.sum("s").alias("total")))
    g = A.period_growth(m, ["segment"], "month", "total")
    return g.select("segment", "month", F.round("total", 2).alias("total"),
                    F.round("prev_value", 2).alias("prev_total"), "growth_pct")


_ALL = ("region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations").split()


@register("load_test_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _ALL))
def load_test_tables(spark, d):
    # Register every table as a temp view, then query them through SQL.
    from tessera.sources.tables import register_views
    # (under a prefix: a caller's own views of these names stay)
    register_views(spark, d, _ALL, prefix="tessera_")
    return spark.sql(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM tessera_{t}" for t in _ALL))

"""Sample-row generation for declared schemas.

Given the exploded column inventory of D3, every (table, row i, column)
cell gets a value from an ordered list of name / type rules (first match
wins). The rules are one CASE expression evaluated by Spark, so generation
is a distributed ``sequence``/``explode`` plus column arithmetic at any row
count. Randomness is replaced by an arithmetic hash of (key, column, row), so
values do not depend on partitioning; "now" is the ``as_of`` parameter.

The rule table is data, rendered both as a Spark Column and as DuckDB SQL
(for the oracle), through the small ``X`` pair type below.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import AS_OF, ensure_checkpoint_dir

col = F.col
lit = F.lit

# ---------------------------------------------------------------- fixed values
PERSON_NAMES = ["Alice Johnson", "Bob Smith", "Charlie Brown", "Diana Lee", "Eve Wilson",
                "Frank Garcia", "Grace Kim", "Hank Miller", "Ivy Chen", "Jack Davis"]
FIRST_NAMES = ["Alice", "Bob", "Charlie", "Diana", "Eve", "Frank", "Grace", "Hank", "Ivy", "Jack"]
LAST_NAMES = ["Johnson", "Smith", "Brown", "Lee", "Wilson", "Garcia", "Kim", "Miller", "Chen", "Davis"]
PRODUCT_NAMES = ["Laptop Pro", "Wireless Mouse", "USB-C Hub", 'Monitor 27"', "Keyboard MX",
                 "Webcam HD", "Headphones", "Desk Lamp", "Phone Stand", "Cable Kit"]
TITLES = ["Senior Engineer", "Product Manager", "Designer", "Analyst", "Director",
          "Intern", "Lead Dev", "QA Engineer", "DevOps", "CTO"]
EMAIL_NAMES = ["alice", "bob", "charlie", "diana", "eve", "frank", "grace", "hank", "ivy", "jack"]
EMAIL_DOMAINS = ["example.com", "test.org", "company.io"]
DEPARTMENTS = ["Engineering", "Marketing", "Sales", "HR", "Finance",
               "Operations", "Support", "Design", "Legal", "Product"]
REGIONS = ["North", "South", "East", "West", "Central"]
GENDERS = ["Male", "Female"]
CITIES = ["New York", "London", "Tokyo", "Singapore", "Sydney",
          "Berlin", "Paris", "Toronto", "Dubai", "Seoul"]
COUNTRIES = ["US", "UK", "JP", "SG", "AU", "DE", "FR", "CA", "AE", "KR"]
FUTURE_STATUSES = ["Upcoming", "Scheduled", "Upcoming", "Scheduled", "Upcoming",
                   "Scheduled", "Upcoming", "Scheduled", "Upcoming", "Scheduled"]
STATUSES = ["active", "completed", "active", "pending", "active",
            "completed", "active", "pending", "completed", "active"]
CATEGORIES = ["Electronics", "Clothing", "Books", "Food", "Toys",
              "Electronics", "Sports", "Home", "Garden", "Tools"]
TYPES = ["Type A", "Type B", "Type C", "Type A", "Type B"]
SALARIES = ["55000", "72000", "48000", "95000", "63000", "81000", "45000", "110000", "67000", "58000"]
PRICES = ["29.99", "149.99", "9.99", "599.99", "79.99", "39.99", "199.99", "14.99", "24.99", "49.99"]
QUANTITIES = ["3", "45", "7", "120", "2", "89", "15", "5", "200", "8"]
AGES = ["25", "34", "67", "45", "72", "28", "55", "70", "38", "80"]
BIRTH_YEARS = ["1990", "1985", "1955", "1978", "1950", "1995", "1968", "1952", "1982", "1945"]
NOTES = ["Follow-up needed", "Routine checkup", "Urgent review", "No issues found",
         "Pending approval", "Completed", "Requires attention", "Standard procedure",
         "Review next week", "All clear"]
RECENT_OFFSETS = [-2, -45, -5, -35, -10, -50, -1, -25, -15, -55,
                  -3, -40, -7, -30, -12, -48, -4, -20, -8, -42,
                  -6, -38, -9, -28, -14, -52, -3, -22, -11, -46]
DATES_2024 = ["2024-01-10", "2024-01-25", "2024-02-08", "2024-02-22", "2024-03-05",
              "2024-03-19", "2024-04-03", "2024-04-17", "2024-05-01", "2024-05-15",
              "2024-06-07", "2024-06-21", "2024-07-04", "2024-07-18", "2024-08-02",
              "2024-08-16", "2024-09-06", "2024-09-20", "2024-10-11", "2024-10-25",
              "2024-11-08", "2024-11-22", "2024-12-06", "2024-12-20"]
FUTURE_OFFSETS = [1, 2, 3, 5, 7, 10, 4, 6, 8, 14]
TIME_SUFFIX = " 10:30:00"
DEFAULT_ROWS, WEB_ROWS = 30, 10
# -----------------------------------------------------------------------------


class X:
    """An expression in both back ends: a Spark Column (built lazily, so the
    SQL text is available without a running SparkContext) and DuckDB SQL."""

    def __init__(self, cf, s: str):
        self._cf, self.s = cf, s

    @property
    def c(self) -> Column:
        return self._cf()

    def __and__(self, o):
        return X(lambda: self.c & o.c, f"({self.s} AND {o.s})")

    def __or__(self, o):
        return X(lambda: self.c | o.c, f"({self.s} OR {o.s})")


def _q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


# cell inputs: lower-cased name n, upper-cased type t, row i, row count, hash h
# (_n / _t are computed once per cell in a projection before the rules run)
N = X(lambda: col("_n"), "_n")
T = X(lambda: col("_t"), "_t")
NAME_NORM = X(lambda: F.lower(col("col_name")), "lower(col_name)")
TYPE_NORM = X(lambda: F.upper(F.coalesce(col("col_type"), lit(""))), "upper(coalesce(col_type, ''))")
I = X(lambda: col("row_i"), "row_i")
NROWS = X(lambda: col("n_rows"), "n_rows")
FIRST = X(lambda: col("first_col"), "first_col")
# reduced before it is multiplied: any 64-bit key is safe under ANSI arithmetic
H = X(lambda: F.pmod(F.pmod(col("sample_id"), lit(495001)) * 1000003 + col("col_pos") * 7919
                     + F.pmod(col("row_i").cast("bigint"), lit(495001)) * 104729, lit(495001)),
      "((sample_id % 495001 * 1000003 + col_pos * 7919 + row_i % 495001 * 104729) % 495001)")


def has(x: X, *subs: str) -> X:
    out = None
    for sub in subs:
        e = X(lambda sub=sub: F.contains(x.c, lit(sub)), f"contains({x.s}, {_q(sub)})")
        out = e if out is None else out | e
    return out


def is_in(x: X, *vals: str) -> X:
    return X(lambda: x.c.isin(list(vals)), f"{x.s} IN ({', '.join(_q(v) for v in vals)})")


def pool(vals, idx: X = I) -> X:
    """vals[idx % len(vals)]"""
    n = len(vals)
    return X(lambda: F.element_at(F.array(*[lit(v) for v in vals]), F.pmod(idx.c, lit(n)) + 1),
             f"[{', '.join(_q(v) for v in vals)}][({idx.s}) % {n} + 1]")


def istr(e: X) -> X:
    return X(lambda: e.c.cast("string"), f"CAST({e.s} AS VARCHAR)")


def fmt2(num: X) -> X:
    return X(lambda: F.format_string("%.2f", num.c), f"printf('%.2f', {num.s})")


def when(cond: X, a: X, b: X) -> X:
    return X(lambda: F.when(cond.c, a.c).otherwise(b.c), f"CASE WHEN {cond.s} THEN {a.s} ELSE {b.s} END")


def concat(*xs: X) -> X:
    return X(lambda: F.concat(*[x.c for x in xs]), "concat(" + ", ".join(x.s for x in xs) + ")")


def text(v: str) -> X:
    return X(lambda: lit(v), _q(v))


def arith(fn, s: str) -> X:
    return X(fn, s)


def date_str(offset: X, with_time: X, time_text: str) -> X:
    d = X(lambda: F.date_format(F.date_add(lit(AS_OF), offset.c), "yyyy-MM-dd"),
          f"strftime(DATE '{AS_OF.isoformat()}' + CAST({offset.s} AS INTEGER), '%Y-%m-%d')")
    return when(with_time, concat(d, text(time_text)), d)


def _mod_eq(x: X, m: int, v: int) -> X:
    return X(lambda: F.pmod(x.c, lit(m)) == v, f"({x.s} % {m} = {v})")


def _int_pool(vals) -> X:
    p = pool([str(o) for o in vals])
    return X(lambda: p.c.cast("int"), f"CAST({p.s} AS INTEGER)")


def _rules() -> list[tuple[str, X, X]]:
    has_time = has(T, "TIME", "STAMP")
    every3 = _mod_eq(I, 3, 0)
    email = concat(pool(EMAIL_NAMES), text("@"), pool(EMAIL_DOMAINS))
    phone = arith(lambda: F.format_string("+1-555-%03d-%04d", I.c + 100, I.c * 111 + 1000),
                  "printf('+1-555-%03d-%04d', row_i + 100, row_i * 111 + 1000)")
    address = concat(istr(arith(lambda: I.c + 100, "(row_i + 100)")), text(" Main Street"))
    status = when(every3, pool(FUTURE_STATUSES), pool(STATUSES))
    birth = arith(lambda: F.format_string("%s-%02d-%02d", pool(BIRTH_YEARS).c, F.pmod(I.c * 3, lit(12)) + 1,
                                          F.pmod(I.c * 7, lit(28)) + 1),
                  f"printf('%s-%02d-%02d', {pool(BIRTH_YEARS).s}, (row_i * 3) % 12 + 1, (row_i * 7) % 28 + 1)")
    recent = date_str(_int_pool(RECENT_OFFSETS), has_time, " 00:00:00")
    fut = date_str(_int_pool(FUTURE_OFFSETS), has_time, TIME_SUFFIX)
    d24 = pool(DATES_2024)
    dates = when(every3, fut, when(has_time, concat(d24, text(TIME_SUFFIX)), d24))
    money = fmt2(arith(lambda: H.c / 100.0 + 50, f"({H.s} / 100.0 + 50)"))
    randint = istr(arith(lambda: F.pmod(H.c, lit(1000)) + 1, f"({H.s} % 1000 + 1)"))
    unif = fmt2(arith(lambda: F.pmod(H.c, lit(99901)) / 100.0 + 1, f"(({H.s} % 99901) / 100.0 + 1)"))
    fk = istr(arith(lambda: F.pmod(I.c - 1, NROWS.c) + 1, "((row_i - 1) % n_rows + 1)"))
    ends_id = arith(lambda: F.endswith(N.c, lit("_id")), f"suffix({N.s}, '_id')")
    key_rule = is_in(N, "id", "pk") | (ends_id & FIRST)
    fk_rule = ends_id | arith(lambda: F.startswith(N.c, lit("id_")), f"prefix({N.s}, 'id_')")
    name = has(N, "name")
    return [
        ("key", key_rule, istr(I)),                                                    # G2
        ("foreign_key", fk_rule, fk),                                                  # G3
        ("person_name", name & has(N, "user", "customer", "patient", "employee", "doctor", "person"),
         pool(PERSON_NAMES)),
        ("first_name", is_in(N, "first_name", "firstname"), pool(FIRST_NAMES)),
        ("last_name", is_in(N, "last_name", "lastname"), pool(LAST_NAMES)),
        # (doctor + name is shadowed by person_name above, as in the reference)
        ("product_name", has(N, "product") & name, pool(PRODUCT_NAMES)),
        ("any_name", name, pool(PERSON_NAMES)),
        ("title", has(N, "title"), pool(TITLES)),
        ("email", has(N, "email"), email),
        ("phone", has(N, "phone"), phone),
        ("department", has(N, "department", "dept"), pool(DEPARTMENTS)),
        ("region", has(N, "region"), pool(REGIONS)),
        ("gender", has(N, "gender", "sex"), pool(GENDERS)),
        ("address", has(N, "address"), address),
        ("city", has(N, "city"), pool(CITIES)),
        ("country", has(N, "country"), pool(COUNTRIES)),
        ("status", has(N, "status"), status),
        ("category", has(N, "category"), pool(CATEGORIES)),
        ("type", has(N, "type"), pool(TYPES)),
        ("salary", has(N, "salary"), pool(SALARIES)),
        ("price", has(N, "price"), pool(PRICES)),
        ("amount", has(N, "amount", "total", "cost", "revenue", "budget"), money),   # G6
        ("quantity", has(N, "quantity", "stock", "count", "qty"), pool(QUANTITIES)),
        ("age", has(N, "age"), pool(AGES)),
        ("birth", has(N, "birth", "dob"), birth),
        ("notes", has(N, "notes", "description", "comment", "remark"), pool(NOTES)),
        ("flag", has(N, "is_", "has_", "enabled", "flag"), istr(arith(lambda: F.pmod(I.c, lit(2)), "(row_i % 2)"))),
        ("recent", has(N, "created", "updated", "registered", "signed_up", "joined"), recent),  # G5
        ("date", has(T, "DATE", "TIME", "STAMP") | has(N, "date", "created", "updated", "ordered", "hired"),
         dates),                                                                       # G5
        ("int", has(T, "INT", "NUM", "SERIAL"), randint),                              # G6
        ("float", has(T, "FLOAT", "REAL", "DOUBLE", "DECIMAL"), unif),                 # G6
        ("text", has(T, "CHAR", "TEXT", "STRING", "CLOB"), concat(text("item_"), istr(I))),
    ]


_FALLBACK = concat(text("val_"), istr(I))
_COLUMN_CACHE: dict = {}


def value_expr() -> tuple[X, X]:
    """The ordered rule list as one CASE over the conditions giving the
    name of the first rule that matches, and the value as a CASE on that
    name (so each condition is evaluated once per cell)."""
    rules = _rules()

    def rule_col():
        c = None
        for name, cond, _ in rules:
            c = F.when(cond.c, lit(name)) if c is None else c.when(cond.c, lit(name))
        return c.otherwise(lit("fallback"))

    def value_col():
        r = col("rule")
        c = None
        for name, _, val in rules:
            c = F.when(r == name, val.c) if c is None else c.when(r == name, val.c)
        return c.otherwise(_FALLBACK.c)

    def cached(key, fn):
        # Column trees are built through py4j once per SparkContext and reused.
        def get():
            from pyspark import SparkContext
            k = (key, id(SparkContext._active_spark_context))
            if k not in _COLUMN_CACHE:
                _COLUMN_CACHE[k] = fn()
            return _COLUMN_CACHE[k]
        return get

    rule_col, value_col = cached("rule", rule_col), cached("value", value_col)
    rule = X(rule_col, "CASE " + " ".join(f"WHEN {c.s} THEN '{n}'" for n, c, _ in rules) + " ELSE 'fallback' END")
    value = X(value_col, "CASE rule " + " ".join(f"WHEN '{n}' THEN {v.s}" for n, _, v in rules) +
              f" ELSE {_FALLBACK.s} END")
    return value, rule


def row_count(requested: int | None) -> int:
    """G1: requested rows, 30 by default; any number."""
    return requested or DEFAULT_ROWS


def generate_rows(columns: DataFrame, n_rows: int = WEB_ROWS, key: str = "sample_id") -> DataFrame:
    """Long-format cells (key, table, row_i, col_pos, col_name, rule,
    value) for ``n_rows`` rows of every table in the column inventory."""
    n = row_count(n_rows)
    value, rule = value_expr()
    # Rules depend on the column only except for i, so pick the rule per
    # declared column (once), then explode the rows and compute values.
    per_col = (columns.withColumn("first_col", col("col_pos") == 1)
               .withColumn("n_rows", lit(n))
               .withColumn("_n", NAME_NORM.c).withColumn("_t", TYPE_NORM.c))
    per_col = per_col.withColumn("rule", rule.c)
    cells = per_col.withColumn("row_i", F.explode(F.sequence(lit(1), lit(n))))
    return cells.select(key, "table_name", "row_i", "col_pos", "col_name", "col_type", "is_unique",
                        "rule", value.c.alias("value"))


def skipped_rows(cells: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, table_name, row_i) of the rows that in-order insertion skips: a row
    is skipped if an inserted earlier row of its table has one of its values in
    the same unique column; skipped rows take no values, NULLs never collide.

    Decided in rounds for all tables at once. Among the undecided rows, values
    that only one of them holds cannot collide and drop out; a row that is the
    earliest holder of each of its remaining values is inserted, and the later
    holders of these values are skipped. So each round decides the earliest row
    of every table and, of independent values, most rows; the number of rounds is
    that of the longest chain of rows that wait for each other. Every round works
    by hash aggregation and joins on a value, and is written to the shared folder
    (lineage stays short); no table is ever gathered in a task."""
    spark = cells.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/unique-{uuid.uuid4().hex}"
    row, value = [key, "table_name", "row_i"], [key, "table_name", "col_pos", "value"]
    open_cells = cells.filter(col("is_unique") & col("value").isNotNull()).select(*row, "col_pos", "value")
    schema, n = open_cells.schema, 0
    while True:
        holders = open_cells.groupBy(*value).agg(F.min("row_i").alias("_first"), F.count(lit(1)).alias("_n"))
        open_cells.join(holders.filter("_n > 1").drop("_n"), value) \
            .withColumn("_earliest", col("row_i") == col("_first")).drop("_first").write.parquet(f"{folder}/open/{n}")
        judged = spark.read.parquet(f"{folder}/open/{n}")
        if not judged.limit(1).count():
            break
        inserted = judged.groupBy(*row).agg(F.min("_earliest").alias("_in"))
        judged = judged.join(inserted, row)
        taken = judged.filter("_in").select(*value, lit(True).alias("_taken"))     # a value has one earliest holder
        waiting = judged.filter("NOT _in").select(*schema.names).join(taken, value, "left")
        waiting.withColumn("_skip", F.coalesce("_taken", lit(False))).drop("_taken").write.parquet(f"{folder}/waiting/round={n}")
        waiting = spark.read.parquet(f"{folder}/waiting/round={n}")
        skipped = waiting.filter("_skip").select(*row).distinct()
        open_cells = waiting.drop("_skip").join(skipped, row, "left_anti")
        n += 1
    if not n:
        return spark.createDataFrame([], open_cells.select(*row).schema)
    return spark.read.parquet(f"{folder}/waiting").filter("_skip").select(*row).distinct()


def unique_insert(cells: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows surviving UNIQUE / PRIMARY KEY constraints, per table, when rows
    are inserted in order. With one unique column the survivors are its distinct
    values and its NULLs; tables with several are decided by ``skipped_rows``."""
    table = [key, "table_name"]
    per_table = cells.filter(col("col_pos") == 1).groupBy(*table).agg(F.count(lit(1)).alias("n_rows"))
    by_col = (cells.filter("is_unique").groupBy(*table, "col_pos")
              .agg((F.countDistinct("value") + F.count(F.when(col("value").isNull(), 1))).alias("_kept"))
              .groupBy(*table).agg(F.count(lit(1)).alias("_cols"), F.max("_kept").alias("_kept")))
    several = cells.join(by_col.filter("_cols > 1").select(*table), table, "left_semi")
    skipped = skipped_rows(several, key).groupBy(*table).agg(F.count(lit(1)).alias("_skipped"))
    out = per_table.join(by_col, table, "left").join(skipped, table, "left")
    in_order = F.when(col("_cols") > 1, col("n_rows") - F.coalesce("_skipped", lit(0)))
    return out.select(*table, F.coalesce(in_order, "_kept", "n_rows").alias("rows_inserted"))

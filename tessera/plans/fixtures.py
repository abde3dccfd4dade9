"""Derived inputs for Track A on the driver tables.

The driver tables hold no SQL text, so the corpus / response / evaluation
operators run on views derived by deterministic expressions. Each view exists
twice: as a Spark DataFrame (what the bindings use) and as SQL text (the CTE
prefix that the DuckDB oracle runs). Both were written to give identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import BAD_START_MSG, EMPTY_MSG
from tessera.sources.tables import table

col = F.col
NL = "\n"
ESC = "\x1b"

# Fixed values of the fixture: one schema and one gold query per doc_id % N_CASES.
# Between them the schemas reach every value rule and the queries every
# statement kind and idiom; the expected results below are written by hand.
CONTEXTS = [
    "CREATE TABLE members (id INT PRIMARY KEY, first_name VARCHAR(40), last_name VARCHAR(40), email VARCHAR(80) UNIQUE, phone VARCHAR(20), joined TIMESTAMP);",
    "CREATE TABLE vessels (id INT PRIMARY KEY, vessel_name VARCHAR(60), city VARCHAR(40)); CREATE TABLE voyages (id INT PRIMARY KEY, vessel_id INT, cost DECIMAL(10,2), sail_date DATE, FOREIGN KEY (vessel_id) REFERENCES vessels(id));",
    "CREATE TABLE staff (staff_id INT, employee_name VARCHAR(60), dept VARCHAR(30), salary DECIMAL(10,2), gender CHAR(1), address TEXT); CREATE TABLE shifts (id INT PRIMARY KEY, staff_id INT, region VARCHAR(20), shift_date DATE);",
    "CREATE TABLE animals (id INT PRIMARY KEY, label TEXT, dob DATE, weight DOUBLE, legs INT, shape GEOMETRY);",
    "CREATE TABLE goods (id INT PRIMARY KEY, product_name VARCHAR(50), price DECIMAL(8,2), qty INT, category VARCHAR(20), kind_type VARCHAR(10), remark TEXT, made_on DATE);",
    "CREATE TABLE IF NOT EXISTS `jobs` (`id` INT UNSIGNED AUTO_INCREMENT, title VARCHAR(40), status ENUM('a','b','c','d','e','f','g','h','i','j','k','l'), note VARCHAR(20) DEFAULT 'x;y', score INT DEFAULT (coalesce(abs(-1),0)), enabled TINYINT, created_at TIMESTAMP, CHECK (score IN (1,2,3)), PRIMARY KEY (id)) ENGINE=InnoDB DEFAULT CHARSET=utf8;",
    "CREATE TABLE codes (region VARCHAR(10) UNIQUE, status VARCHAR(10) UNIQUE, country CHAR(2));",
    "CREATE TABLE visits (visit_id INT, person_name TEXT, visit_date DATETIME, total FLOAT, age INT);",
    "CREATE TABLE parks (id INT PRIMARY KEY, park_name TEXT, country TEXT, is_open INT, updated TIMESTAMP, budget DECIMAL(12,2));",
    "CREATE TABLE regions_log (id INT PRIMARY KEY, region TEXT UNIQUE, description TEXT);",
    "CREATE TABLE suppliers (id INT PRIMARY KEY, supplier_name TEXT, sex CHAR(1), revenue DOUBLE);",
    "CREATE TABLE loans (id INT PRIMARY KEY, book_id INT, due DATE, stock INT); CREATE TABLE books (id INT PRIMARY KEY, title TEXT, code CHAR(13) UNIQUE);",
    "CREATE TABLE pens (id INT PRIMARY KEY, name TEXT, ink_id INT, stamp TEXT); CREATE TABLE inks (id INT PRIMARY KEY, name TEXT);",
]
N_CASES = len(CONTEXTS)
GOLD_SQL = [
    "SELECT first_name, email FROM members WHERE joined >= DATE_SUB(DATE(NOW()), INTERVAL \"30\" DAY);",
    "SELECT v.vessel_name, SUM(y.cost) AS spent FROM vessels v JOIN voyages y ON v.id = y.vessel_id GROUP BY v.vessel_name ORDER BY spent DESC LIMIT 5, 10;",
    "SELECT DATE_FORMAT(shift_date, '%Y-%m-%dT%H:%i') AS minute, COUNT(*) FROM shifts GROUP BY minute;",
    "SELECT label FROM animals WHERE TIMESTAMPDIFF(YEAR, dob, CURDATE()) > 3 AND DATEDIFF(NOW(), dob) > 900;",
    "SELECT strftime('%Y-%m', made_on) AS m, AVG(price) FROM goods WHERE IFNULL(qty, 0) < 10 GROUP BY m;",
    "UPDATE jobs SET status = 'b' WHERE EXTRACT(YEAR FROM created_at) = 2020;",
    "INSERT INTO codes (region, country) VALUES ('North', 'US');",
    "DELETE FROM visits WHERE visit_date < DATE_ADD(COALESCE(MAX(visit_date), GETDATE()), INTERVAL 1 MONTH);",
    "CREATE TABLE archive (id INT UNSIGNED AUTO_INCREMENT, label TEXT) ENGINE=InnoDB;",
    "DROP TABLE regions_log;",
    "ALTER TABLE suppliers ADD rating INT;",
    "WITH recent AS (SELECT * FROM loans WHERE due >= CURRENT_DATE - INTERVAL 7 DAY) SELECT COUNT(*) FROM recent WHERE YEAR(due) = 2001;",
    "SELECT p.name, s.name FROM pens p JOIN inks s ON p.ink_id = s.id WHERE DATE_FORMAT(DATE(NOW()), '%Y %Y %Y') = p.stamp;",
]
UNGROUNDED_SQL = "SELECT x.id, r.region FROM members x JOIN outlets r ON x.id = r.id WHERE x.id > 1;"

# ---- expected results, by hand (the oracle's side of D1-D5, F12, R12, R13, R14)
# statements of each schema
STATEMENTS = [[p + ")" for p in c[:-2].split("); ")] for c in CONTEXTS]
STATEMENTS[5] = [CONTEXTS[5][:-1]]
# (case, table, position, column, type, unique)
COLUMNS = [
    (0, "members", 1, "id", "INT", True), (0, "members", 2, "first_name", "VARCHAR(40)", False),
    (0, "members", 3, "last_name", "VARCHAR(40)", False), (0, "members", 4, "email", "VARCHAR(80)", True),
    (0, "members", 5, "phone", "VARCHAR(20)", False), (0, "members", 6, "joined", "TIMESTAMP", False),
    (1, "vessels", 1, "id", "INT", True), (1, "vessels", 2, "vessel_name", "VARCHAR(60)", False),
    (1, "vessels", 3, "city", "VARCHAR(40)", False), (1, "voyages", 1, "id", "INT", True),
    (1, "voyages", 2, "vessel_id", "INT", False), (1, "voyages", 3, "cost", "DECIMAL(10,2)", False),
    (1, "voyages", 4, "sail_date", "DATE", False),
    (2, "staff", 1, "staff_id", "INT", False), (2, "staff", 2, "employee_name", "VARCHAR(60)", False),
    (2, "staff", 3, "dept", "VARCHAR(30)", False), (2, "staff", 4, "salary", "DECIMAL(10,2)", False),
    (2, "staff", 5, "gender", "CHAR(1)", False), (2, "staff", 6, "address", "TEXT", False),
    (2, "shifts", 1, "id", "INT", True), (2, "shifts", 2, "staff_id", "INT", False),
    (2, "shifts", 3, "region", "VARCHAR(20)", False), (2, "shifts", 4, "shift_date", "DATE", False),
    (3, "animals", 1, "id", "INT", True), (3, "animals", 2, "label", "TEXT", False), (3, "animals", 3, "dob", "DATE", False),
    (3, "animals", 4, "weight", "DOUBLE", False), (3, "animals", 5, "legs", "INT", False),
    (3, "animals", 6, "shape", "GEOMETRY", False),
    (4, "goods", 1, "id", "INT", True), (4, "goods", 2, "product_name", "VARCHAR(50)", False),
    (4, "goods", 3, "price", "DECIMAL(8,2)", False), (4, "goods", 4, "qty", "INT", False),
    (4, "goods", 5, "category", "VARCHAR(20)", False), (4, "goods", 6, "kind_type", "VARCHAR(10)", False),
    (4, "goods", 7, "remark", "TEXT", False), (4, "goods", 8, "made_on", "DATE", False),
    (5, "jobs", 1, "id", "INT", False), (5, "jobs", 2, "title", "VARCHAR(40)", False),
    (5, "jobs", 3, "status", "ENUM('a','b','c','d','e','f','g','h','i','j','k','l')", False),
    (5, "jobs", 4, "note", "VARCHAR(20)", False), (5, "jobs", 5, "score", "INT", False),
    (5, "jobs", 6, "enabled", "TINYINT", False), (5, "jobs", 7, "created_at", "TIMESTAMP", False),
    (6, "codes", 1, "region", "VARCHAR(10)", True), (6, "codes", 2, "status", "VARCHAR(10)", True),
    (6, "codes", 3, "country", "CHAR(2)", False),
    (7, "visits", 1, "visit_id", "INT", False), (7, "visits", 2, "person_name", "TEXT", False),
    (7, "visits", 3, "visit_date", "DATETIME", False), (7, "visits", 4, "total", "FLOAT", False),
    (7, "visits", 5, "age", "INT", False),
    (8, "parks", 1, "id", "INT", True), (8, "parks", 2, "park_name", "TEXT", False), (8, "parks", 3, "country", "TEXT", False),
    (8, "parks", 4, "is_open", "INT", False), (8, "parks", 5, "updated", "TIMESTAMP", False),
    (8, "parks", 6, "budget", "DECIMAL(12,2)", False),
    (9, "regions_log", 1, "id", "INT", True), (9, "regions_log", 2, "region", "TEXT", True),
    (9, "regions_log", 3, "description", "TEXT", False),
    (10, "suppliers", 1, "id", "INT", True), (10, "suppliers", 2, "supplier_name", "TEXT", False),
    (10, "suppliers", 3, "sex", "CHAR(1)", False), (10, "suppliers", 4, "revenue", "DOUBLE", False),
    (11, "loans", 1, "id", "INT", True), (11, "loans", 2, "book_id", "INT", False), (11, "loans", 3, "due", "DATE", False),
    (11, "loans", 4, "stock", "INT", False), (11, "books", 1, "id", "INT", True), (11, "books", 2, "title", "TEXT", False),
    (11, "books", 3, "code", "CHAR(13)", True),
    (12, "pens", 1, "id", "INT", True), (12, "pens", 2, "name", "TEXT", False), (12, "pens", 3, "ink_id", "INT", False),
    (12, "pens", 4, "stamp", "TEXT", False), (12, "inks", 1, "id", "INT", True), (12, "inks", 2, "name", "TEXT", False),
]
# gold queries that the dialect rewrite changes
SPARK_SQL = {
    0: "SELECT first_name, email FROM members WHERE joined >= (DATE(NOW()) - INTERVAL 30 DAY);",
    1: "SELECT v.vessel_name, SUM(y.cost) AS spent FROM vessels v JOIN voyages y ON v.id = y.vessel_id GROUP BY v.vessel_name ORDER BY spent DESC LIMIT 10 OFFSET 5;",
    2: "SELECT DATE_FORMAT(shift_date, \"yyyy-MM-dd'T'HH:mm\") AS minute, COUNT(*) FROM shifts GROUP BY minute;",
    4: "SELECT date_format(made_on, 'yyyy-MM') AS m, AVG(price) FROM goods WHERE IFNULL(qty, 0) < 10 GROUP BY m;",
    7: "DELETE FROM visits WHERE visit_date < (COALESCE(MAX(visit_date), current_timestamp()) + INTERVAL 1 MONTH);",
    8: "CREATE TABLE archive (id INT, label TEXT);",
    12: "SELECT p.name, s.name FROM pens p JOIN inks s ON p.ink_id = s.id WHERE DATE_FORMAT(DATE(NOW()), 'yyyy yyyy yyyy') = p.stamp;",
}
# schemas that the DDL clean-up changes
CLEAN_DDL = {
    5: "CREATE TABLE IF NOT EXISTS `jobs` (`id` INT, title VARCHAR(40), status ENUM('a','b','c','d','e','f','g','h','i','j','k','l'), note VARCHAR(20) DEFAULT 'x;y', score INT DEFAULT (coalesce(abs(-1),0)), enabled TINYINT, created_at TIMESTAMP, CHECK (score IN (1,2,3)), PRIMARY KEY (id));",
}
# idioms found in each gold query
IDIOMS = {
    0: ["now_function", "date_sub_add", "date_fn"], 1: ["limit_comma"], 2: ["date_format"],
    3: ["now_function", "timestampdiff", "datediff"], 4: ["strftime", "isnull_ifnull"], 5: ["extract"],
    7: ["now_function", "date_sub_add"], 8: ["ddl_mysql"], 11: ["now_function", "interval_arith", "date_parts"],
    12: ["now_function", "date_fn", "date_format"],
}
# the ungrounded query without its join to a table that no schema has
GROUNDED_SQL = "SELECT x.id, region FROM members x WHERE x.id > 1;"


def _pick(key, values):
    """``CASE key WHEN 0 THEN v0 ... END`` for a small fixed list."""
    e = None
    for i, v in enumerate(values):
        e = F.when(key == i, F.lit(v)) if e is None else e.when(key == i, F.lit(v))
    return e


def samples(spark: SparkSession, d: str) -> DataFrame:
    return samples_from(table(spark, d, "documents"))


def samples_from(docs: DataFrame) -> DataFrame:
    """The samples projection of a documents DataFrame (batch or stream)."""
    k = col("doc_id") % N_CASES
    return docs.select(
        col("doc_id").alias("sample_id"), col("source").alias("domain"),
        col("lang").alias("sql_complexity"),
        _pick(k, CONTEXTS).alias("sql_context"),
        col("text").alias("sql_prompt"),  # the whole document text is the request
        _pick(k, GOLD_SQL).alias("sql"),
        F.when(col("doc_id") % 10 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Example from "), col("source"))).alias("sql_explanation"))


def raw_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples as they may arrive: keys, requests, queries and domains missing."""
    k = col("sample_id")
    return samples(spark, d).select(
        F.when(k % 19 != 0, k).alias("sample_id"), F.when(k % 4 != 1, col("domain")).alias("domain"),
        F.when(k % 11 != 3, col("sql_prompt")).alias("sql_prompt"), F.when(k % 7 != 2, col("sql")).alias("sql"))


def responses(spark: SparkSession, d: str) -> DataFrame:
    return responses_from(samples(spark, d))


def responses_from(s: DataFrame, *also: str) -> DataFrame:
    sql = col("sql")
    v = col("sample_id") % 8
    resp = (F.when(v == 0, F.concat(F.lit("```sql" + NL), sql, F.lit(NL + "```" + NL + NL + "Explanation: ok")))
            .when(v == 1, F.concat(F.lit("Use "), sql, F.lit(" to get it.")))
            .when(v == 2, col("sql_prompt"))  # prose without SQL: the whole document text
            .when(v == 3, F.lit(""))
            .when(v == 4, F.concat(F.lit(ESC + "[32m```sql" + NL), sql, F.lit(NL + "```" + ESC + "[0m")))
            .when(v == 5, F.lit("<|end|>" * 6))
            .when(v == 6, F.concat(F.lit("{ end }<|end|>"), sql))
            .otherwise(F.lit("```sql" + NL + UNGROUNDED_SQL + NL + "```")))
    return s.select("sample_id", "domain", "sql_complexity", "sql_context",
                    sql.alias("expected_sql"), resp.alias("response"), *also)


def attempts(spark: SparkSession, d: str) -> DataFrame:
    return attempts_from(responses(spark, d))


def attempts_from(r: DataFrame, *also: str) -> DataFrame:
    """Three attempts per response (batch or stream)."""
    r = r.select("sample_id", "response", *also)
    r = r.withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    a = col("sample_id") + col("attempt")
    resp = (F.when(a % 4 == 0, F.lit(""))
            .when(a % 7 == 0, F.lit("<|im_end|>" * 6))
            .otherwise(col("response")))
    return r.select(col("sample_id").alias("prompt_id"), col("attempt").cast("int").alias("attempt"),
                    resp.alias("response"), *also)


def eval_results(spark: SparkSession, d: str) -> DataFrame:
    """One row per judged case: every branch of the status rules occurs."""
    lab = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    k = col("doc_id")
    return lab.join(docs, "doc_id").select(
        k.alias("query_index"), F.concat(F.lit("case "), k.cast("string")).alias("name"), col("source").alias("domain"),
        col("lang").alias("complexity"), _pick(k % N_CASES, GOLD_SQL).alias("sql"), (col("quality") == 1).alias("is_valid"),
        (col("toxic") == 0).alias("is_executable"),
        ((k % 11).cast("double") / F.lit(10.0)).alias("keyword_score"),
        (k % 23 != 5).alias("has_response"), (k % 29 != 3).alias("has_sql"),
        F.when(k % 31 == 7, F.lit("request timed out")).alias("error"),
        F.when(k % 2 == 0, F.lit(EMPTY_MSG)).otherwise(F.lit(BAD_START_MSG)).alias("validation_message"),
        F.concat(F.lit("Query execution failed: no such table: t"), (k % 3).cast("string")).alias("execution_message"))


def latency(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", col("event_type").alias("complexity"), col("value").alias("response_time"),
        (col("event_type") != "error").alias("success"))


def chat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text")


# ----------------------------------------------------------------- DuckDB text

def _quoted(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def values_sql(name: str, columns: str, rows) -> str:
    """A CTE of literal rows."""
    def cell(v):
        return _quoted(v) if isinstance(v, str) else str(v)
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


def _case_sql(key: str, values) -> str:
    arms = " ".join(f"WHEN {i} THEN {_quoted(v)}" for i, v in enumerate(values))
    return f"CASE {key} {arms} END"


SQL = {
    "samples": f"""samples AS (SELECT doc_id AS sample_id, source AS domain, lang AS sql_complexity,
 {_case_sql(f'doc_id % {N_CASES}', CONTEXTS)} AS sql_context,
 text AS sql_prompt,
 {_case_sql(f'doc_id % {N_CASES}', GOLD_SQL)} AS sql,
 CASE WHEN doc_id % 10 = 0 THEN NULL ELSE concat('Example from ', source) END AS sql_explanation
FROM documents)""",
    "raw_samples": """raw_samples AS (SELECT CASE WHEN sample_id % 19 <> 0 THEN sample_id END AS sample_id,
 CASE WHEN sample_id % 4 <> 1 THEN domain END AS domain, CASE WHEN sample_id % 11 <> 3 THEN sql_prompt END AS sql_prompt,
 CASE WHEN sample_id % 7 <> 2 THEN sql END AS sql FROM samples)""",
    "responses": f"""responses AS (SELECT sample_id, domain, sql_complexity, sql_context, sql AS expected_sql,
 CASE sample_id % 8
  WHEN 0 THEN concat('```sql', chr(10), sql, chr(10), '```', chr(10), chr(10), 'Explanation: ok')
  WHEN 1 THEN concat('Use ', sql, ' to get it.')
  WHEN 2 THEN sql_prompt
  WHEN 3 THEN ''
  WHEN 4 THEN concat(chr(27), '[32m```sql', chr(10), sql, chr(10), '```', chr(27), '[0m')
  WHEN 5 THEN repeat('<|end|>', 6)
  WHEN 6 THEN concat('{{ end }}<|end|>', sql)
  ELSE concat('```sql', chr(10), '{UNGROUNDED_SQL}', chr(10), '```') END AS response
FROM samples)""",
    "attempts": """attempts AS (SELECT sample_id AS prompt_id, CAST(attempt AS INTEGER) AS attempt,
 CASE WHEN (sample_id + attempt) % 4 = 0 THEN '' WHEN (sample_id + attempt) % 7 = 0
 THEN repeat('<|im_end|>', 6) ELSE response END AS response
FROM responses CROSS JOIN (SELECT 1 AS attempt UNION ALL SELECT 2 UNION ALL SELECT 3) t)""",
    "eval_results": f"""eval_results AS (SELECT l.doc_id AS query_index, concat('case ', l.doc_id) AS name, d.source AS domain,
 d.lang AS complexity, {_case_sql(f'l.doc_id % {N_CASES}', GOLD_SQL)} AS sql, l.quality = 1 AS is_valid, l.toxic = 0 AS is_executable,
 CAST(l.doc_id % 11 AS DOUBLE) / 10.0 AS keyword_score, l.doc_id % 23 <> 5 AS has_response, l.doc_id % 29 <> 3 AS has_sql,
 CASE WHEN l.doc_id % 31 = 7 THEN 'request timed out' END AS error,
 CASE WHEN l.doc_id % 2 = 0 THEN '{EMPTY_MSG}' ELSE '{BAD_START_MSG}' END AS validation_message,
 concat('Query execution failed: no such table: t', l.doc_id % 3) AS execution_message
FROM labels l JOIN documents d ON l.doc_id = d.doc_id)""",
    "latency": """latency AS (SELECT event_id, event_type AS complexity, value AS response_time,
 event_type <> 'error' AS success FROM events)""",
    "chat": "chat AS (SELECT conv_id, turn, role, text FROM conversations)",
}
_DEPS = {"samples": [], "raw_samples": ["samples"], "responses": ["samples"], "attempts": ["samples", "responses"],
         "eval_results": [], "latency": [], "chat": []}


def with_views(*names: str, extra: str | None = None) -> str:
    """``WITH`` prefix defining the named fixture views (and their inputs)
    in dependency order, optionally followed by further CTEs."""
    order = []
    for n in names:
        for m in _DEPS[n] + [n]:
            if m not in order:
                order.append(m)
    parts = [SQL[m] for m in order]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n"


# Expected keywords per gold query, fixed values of the fixture.
KEYWORDS = [
    ["SELECT", "FROM", "members", "WHERE", "joined"],
    ["SELECT", "JOIN", "SUM", "GROUP BY", "ORDER BY", "LIMIT"],
    ["SELECT", "COUNT", "GROUP BY", "shifts"],
    ["SELECT", "animals", "dob", "900"],
    ["SELECT", "AVG", "goods", "< 10"],
    ["UPDATE", "jobs", "SET"],
    ["INSERT", "codes", "VALUES"],
    ["DELETE", "visits", "WHERE"],
    ["CREATE", "archive"],
    ["DROP", "regions_log"],
    ["ALTER", "suppliers", "rating"],
    ["WITH", "recent", "COUNT", "loans"],
    ["SELECT", "JOIN", "pens", "inks", "stamp"],
]


def keywords_col(key="sample_id"):
    k = F.col(key) % N_CASES
    e = None
    for i, kws in enumerate(KEYWORDS):
        arr = F.array(*[F.lit(x) for x in kws])
        e = F.when(k == i, arr) if e is None else e.when(k == i, arr)
    return e


def keywords_sql(key="sample_id") -> str:
    arms = " ".join(f"WHEN {i} THEN [" + ", ".join(f"'{x}'" for x in kws) + "]"
                    for i, kws in enumerate(KEYWORDS))
    return f"CASE {key} % {N_CASES} {arms} END"

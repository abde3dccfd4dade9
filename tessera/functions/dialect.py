"""SQL dialect normalisation (R13, R14, F12) over a column of SQL text.
Target dialect: Spark SQL. Fixed-text idioms are an ordered chain of
``regexp_replace`` rules; calls with arguments are rewritten by a depth-aware
scan. The oracle holds the results as literal texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.nesting import EDIT, edit, rewrite_calls
from tessera.functions.text import ANSI_ESCAPE, CONTROL_CHARS

# ---------------------------------------------------------------- fixed values
# MySQL DATE_FORMAT specifiers -> Spark datetime pattern letters.
MYSQL_FORMAT_TOKENS = [
    ("%Y", "yyyy"), ("%y", "yy"), ("%m", "MM"), ("%c", "M"), ("%d", "dd"), ("%e", "d"),
    ("%H", "HH"), ("%k", "H"), ("%h", "hh"), ("%I", "hh"), ("%l", "h"), ("%i", "mm"),
    ("%s", "ss"), ("%S", "ss"), ("%M", "MMMM"), ("%b", "MMM"), ("%W", "EEEE"), ("%a", "EEE"),
    ("%p", "a"), ("%j", "DDD"), ("%T", "HH:mm:ss"), ("%f", "SSSSSS"),
]
# (name, pattern, replacement) applied in order; $n = capture group n. The calls
# with arguments (CALLS) are rewritten between the two halves.
CALLS = ["DATE_SUB", "DATE_ADD", "DATE_FORMAT", "STRFTIME"]
RULES_BEFORE_CALLS = [
    ("ansi_escape", ANSI_ESCAPE, ""),
    ("control_chars", CONTROL_CHARS, ""),
    ("getdate", r"(?i)\bGETDATE\s*\(\s*\)", "current_timestamp()"),
    ("sysdate", r"(?i)\bSYSDATE\b(?:\s*\(\s*\))?", "current_timestamp()"),
]
RULES_AFTER_CALLS = [
    ("year_literal_compare", r"((?i:date_format)\s*\([^)]*\))\s*(=|!=|<>|>=|<=|>|<)\s*(\d+)\b", "$1 $2 '$3'"),
    ("limit_comma", r"(?i)\bLIMIT\s+(\d+)\s*,\s*(\d+)", "LIMIT $2 OFFSET $1"),
    ("auto_increment", r"(?i)\s+AUTO_INCREMENT\b", ""),
    ("unsigned", r"(?i)\s+UNSIGNED\b", ""),
    ("engine", r"(?i)\)\s*ENGINE\s*=\s*\w+[^;]*;", ");"),
]
DDL_RULES = ["auto_increment", "unsigned", "engine"]
# Foreign idioms counted by R14: (name, detection pattern).
IDIOMS = [
    ("now_function", r"(?i)\b(NOW|CURDATE|GETDATE)\s*\(|\bSYSDATE\b|\bCURRENT_(DATE|TIMESTAMP)\b"),
    ("interval_arith", r"(?i)[+-]\s*INTERVAL\s"),
    ("date_sub_add", r"(?i)\bDATE_(SUB|ADD)\s*\("),
    ("date_fn", r"(?i)\bDATE\s*\("),
    ("date_format", r"(?i)\bDATE_FORMAT\s*\("),
    ("timestampdiff", r"(?i)\bTIMESTAMPDIFF\s*\("),
    ("datediff", r"(?i)\bDATEDIFF\s*\("),
    ("date_parts", r"(?i)\b(YEAR|MONTH|DAY)\s*\("),
    ("extract", r"(?i)\bEXTRACT\s*\("),
    ("isnull_ifnull", r"(?i)\b(ISNULL|IFNULL)\s*\("),
    ("limit_comma", r"(?i)\bLIMIT\s+\d+\s*,\s*\d+"),
    ("strftime", r"(?i)\bstrftime\s*\("),
    ("ddl_mysql", r"(?i)\b(AUTO_INCREMENT|UNSIGNED|ENGINE\s*=)"),
]
# -----------------------------------------------------------------------------


CALL_GUARD = r"(?i)\b(" + "|".join(CALLS) + r")\s*\("
INTERVAL_RE = "(?i)^\\s*INTERVAL\\s+['\"]?(\\d+)['\"]?\\s+(\\w+)\\s*$"
LITERAL_RE = "^\\s*(?:'([^']*)'|\"([^\"]*)\")\\s*$"


def spark_format(fmt: Column, minutes_as: str = "%i") -> Column:
    """A MySQL / SQLite format string as a Spark datetime pattern: every
    specifier is translated, letters between specifiers are quoted. SQLite's
    minutes are ``%M``."""
    table = dict(MYSQL_FORMAT_TOKENS) | {"%%": "%"}
    if minutes_as == "%M":
        table["%M"] = "mm"
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    tokens = F.regexp_extract_all(fmt, F.lit("(%.|[^%]+|%)"), F.lit(1))
    return F.array_join(F.transform(tokens, lambda t: F.when(
        t.startswith("%") & F.map_contains_key(names, t), F.element_at(names, t)).otherwise(
        F.regexp_replace(t, "([A-Za-z]+)", "'$1'"))), "")


def _call(name: Column, call: Column, comma: Column, close: Column, first: Column, second: Column) -> Column:
    """Edits of one two-argument call (see ``rewrite_calls``)."""
    def literal(x: Column) -> Column:
        return F.concat(F.regexp_extract(x, LITERAL_RE, 1), F.regexp_extract(x, LITERAL_RE, 2))

    def pattern(x: Column) -> Column:
        # a pattern with quoted letters stands in double quotes
        return F.when(x.contains("'"), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), x, F.lit("'")))

    sign = F.when(name == "DATE_SUB", " - ").otherwise(" + ")
    interval = F.concat(sign, F.lit("INTERVAL "), F.regexp_extract(second, INTERVAL_RE, 1), F.lit(" "),
                        F.regexp_extract(second, INTERVAL_RE, 2), F.lit(")"))
    shifted = F.array(edit(call, call + F.length(name), F.lit("")), edit(comma, close + 1, interval))
    formatted = F.array(edit(comma, close + 1, F.concat(F.lit(", "), pattern(spark_format(literal(second))), F.lit(")"))))
    swapped = F.array(edit(call, comma + 1 + F.length(second) - F.length(F.ltrim(second)), F.lit("date_format(")),
                      edit(close, close + 1, F.concat(F.lit(", "), pattern(spark_format(literal(first), "%M")), F.lit(")"))))
    return F.when(name.isin("DATE_SUB", "DATE_ADD") & second.rlike(INTERVAL_RE), shifted) \
        .when((name == "DATE_FORMAT") & second.rlike(LITERAL_RE), formatted) \
        .when((name == "STRFTIME") & first.rlike(LITERAL_RE), swapped) \
        .otherwise(F.array().cast(f"array<{EDIT}>"))


def dialect_normalize(x, names=None) -> Column:
    """Rewrite MySQL / T-SQL / SQLite idioms in a SQL text column into
    Spark SQL. Functions Spark already has (NOW, CURDATE, TIMESTAMPDIFF,
    DATEDIFF, YEAR/MONTH/DAY, EXTRACT, IFNULL, ISNULL) are left alone. Calls
    are found at any nesting depth; only texts that hold one are scanned."""
    c = F.col(x) if isinstance(x, str) else x
    for name, pat, rep in RULES_BEFORE_CALLS:
        if names is None or name in names:
            c = F.regexp_replace(c, pat, rep)
    if names is None:
        c = F.when(c.rlike(CALL_GUARD), rewrite_calls(c, CALLS, _call)).otherwise(c)
    for name, pat, rep in RULES_AFTER_CALLS:
        if names is None or name in names:
            c = F.regexp_replace(c, pat, rep)
    return c


def ddl_cleanup(x) -> Column:
    """MySQL DDL decorations Spark does not accept."""
    return dialect_normalize(x, DDL_RULES)


def idiom_flags(x) -> list[Column]:
    """One boolean column per idiom."""
    c = F.col(x) if isinstance(x, str) else x
    return [F.coalesce(c.rlike(p), F.lit(False)).alias(n) for n, p in IDIOMS]


def mysql_to_spark_format(fmt: str) -> str:
    """F5 helper for literal formats known on the driver."""
    out, i = [], 0
    table = dict(MYSQL_FORMAT_TOKENS)
    while i < len(fmt):
        two = fmt[i:i + 2]
        if two in table:
            out.append(table[two])
            i += 2
        elif two == "%%":
            out.append("%")
            i += 2
        else:
            ch = fmt[i]
            out.append(f"'{ch}'" if ch.isalpha() else ch)
            i += 1
    return "".join(out)

"""DuckDB SQL renderings of the column functions in ``tessera.functions``.

Only the oracle uses these; they take an SQL expression and return an SQL
expression with the same meaning as the Spark Column function of the same
name.
"""

from __future__ import annotations

from tessera.functions import text as TX


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def lit_text(s: str) -> str:
    """String literal that may contain newlines (built with chr(10))."""
    parts = s.split("\n")
    return "concat(" + ", chr(10), ".join(q(p) for p in parts) + ")" if len(parts) > 1 else q(s)


def strip(x: str) -> str:
    return f"trim({x}, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))"


def word_count(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '\\S+')) AS INTEGER)"


def scrub(x: str) -> str:
    return (f"regexp_replace(regexp_replace({x}, {q(TX.ANSI_ESCAPE)}, '', 'g'), "
            f"{q(TX.CONTROL_CHARS)}, '', 'g')")


def extract_sql(x: str) -> str:
    f, b = q(TX.FENCE_RE), q(TX.BARE_RE)
    return (f"CASE WHEN regexp_matches({x}, {f}) THEN {strip(f'regexp_extract({x}, {f}, 1)')} "
            f"WHEN regexp_matches({x}, {b}) THEN {strip(f'regexp_extract({x}, {b}, 0)')} "
            f"ELSE NULL END")


def is_valid_sql(x: str) -> str:
    body = f"upper({strip(x)})"
    return (f"coalesce(regexp_matches({body}, {q('^' + TX.STARTERS_RE)}) AND {body} <> '', false)")


def validation_message(x: str) -> str:
    body = strip(x)
    return (f"CASE WHEN {x} IS NULL OR {body} = '' THEN {q(TX.EMPTY_MSG)} "
            f"WHEN regexp_matches(upper({body}), {q('^' + TX.STARTERS_RE)}) THEN {q(TX.VALID_MSG)} "
            f"ELSE {q(TX.BAD_START_MSG)} END")


def statement_kind(x: str) -> str:
    k = f"regexp_extract(upper({strip(x)}), {q('^' + TX.STARTERS_RE)}, 1)"
    return f"nullif({k}, '')"


def count_occ(x: str, token: str) -> str:
    return f"CAST((length({x}) - length(replace({x}, {q(token)}, ''))) / {len(token)} AS INTEGER)"


def is_token_loop(x: str) -> str:
    return f"({count_occ(x, TX.IM_END)} > 5 OR {count_occ(x, TX.END)} > 5)"


def has_loop_marker(x: str) -> str:
    return f"contains({x}, {q(TX.LOOP_MARKER)})"


def response_health(x: str) -> str:
    s = strip(x)
    return (f"CASE WHEN {s} IS NULL OR {s} = '' THEN 'empty' "
            f"WHEN contains({s}, {q(TX.LOOP_MARKER)}) THEN 'loop_marker' "
            f"WHEN length({s}) > 1000 THEN 'too_long' "
            f"WHEN {count_occ(s, TX.END)} > 3 THEN 'end_loop' ELSE 'ok' END")


def fallback_response(p: str) -> str:
    return (f"CASE WHEN contains(upper({p}), 'SELECT') OR contains(lower({p}), 'find') "
            f"OR contains(lower({p}), 'get') THEN {lit_text(TX.FALLBACK_SQL_TEXT)} "
            f"ELSE {q(TX.FALLBACK_ERROR_TEXT)} END")


def normalize_sql(x: str) -> str:
    pieces = (f"list_transform(regexp_extract_all({x}, {q(TX.SQL_PIECES)}, 1), lambda p: CASE "
              f"WHEN regexp_matches(p, '^(--|/[*]|\\s)') THEN chr(1) WHEN regexp_matches(p, '^[''\"`](?s:.)') THEN p ELSE lower(p) END)")
    return f"regexp_replace(regexp_replace(array_to_string({pieces}, ''), chr(1) || '+', ' ', 'g'), '^ +|[ ;]+$', '', 'g')"

"""Depth-aware scanning of SQL text inside a row (JVM expressions only).

The text is cut into tokens by one regular expression whose loops are over
single characters (no recursion on long texts), and an ``aggregate`` over the
tokens keeps the nesting depth. Parentheses and separators inside quoted
literals do not count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUOTED = "'[^']*'|\"[^\"]*\"|`[^`]*`"
_TOKENS = QUOTED + "|[(),;]|[^(),;'\"`]+|['\"`]"


def split_top_level(text: Column, sep: str) -> Column:
    """Array of the pieces of ``text`` between the separators (',' or ';') that
    stand outside all parentheses and quotes; any depth, any number."""
    tokens = F.regexp_extract_all(text, F.lit(f"({_TOKENS})"), F.lit(1))
    start = F.struct(F.lit(1).alias("pos"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("cuts"))

    def step(a: Column, t: Column) -> Column:
        return F.struct(
            (a["pos"] + F.length(t)).alias("pos"),
            (a["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)).alias("depth"),
            F.when((t == sep) & (a["depth"] == 0), F.array_append(a["cuts"], a["pos"])).otherwise(a["cuts"]).alias("cuts"))

    def pieces(a: Column) -> Column:
        edges = F.concat(F.array(F.lit(0)), a["cuts"], F.array(F.length(text) + 1))
        return F.transform(F.slice(edges, F.lit(2), F.size(edges) - 1),
                           lambda e, i: F.substring(text, F.get(edges, i) + 1, e - F.get(edges, i) - 1))

    return F.aggregate(tokens, start, step, pieces)


EDIT = "struct<at:int,until:int,text:string>"


def edit(at: Column, until: Column, text: Column) -> Column:
    """Replace the characters from ``at`` up to before ``until`` (from 1)."""
    return F.struct(at.cast("int").alias("at"), until.cast("int").alias("until"), text.alias("text"))


def rewrite_calls(text: Column, names: list[str], edits_of) -> Column:
    """Rewrite the two-argument calls of ``names`` (any case, any nesting).
    ``edits_of(name, call, comma, close, first, second)`` gives the edits of one
    call as an array: its upper-cased name, the positions of the name, of the
    comma and of the closing parenthesis, and its two arguments as written. Only
    positions travel with the scan, so a long argument costs no copies; calls
    that are never closed stay as they are."""
    call = r"(?i)(?:^|.*\W)(" + "|".join(names) + r")\s*\($"
    tokens = F.regexp_extract_all(text, F.lit(f"((?s){QUOTED}|[^(),'\"`]*\\(|[,)]|[^(),'\"`]+|['\"`])"), F.lit(1))
    frame = "struct<name:string,call:int,open:int,comma:int,commas:int>"
    start = F.struct(F.lit(1).alias("pos"), F.array().cast(f"array<{frame}>").alias("stack"),
                     F.array().cast(f"array<{EDIT}>").alias("edits"))

    def top_of(name, at, opened, comma, commas) -> Column:
        return F.struct(name.alias("name"), at.cast("int").alias("call"), opened.cast("int").alias("open"),
                        comma.cast("int").alias("comma"), commas.cast("int").alias("commas"))

    def step(a: Column, t: Column) -> Column:
        pos, stack = a["pos"], a["stack"]
        after = pos + F.length(t)
        top = F.element_at(stack, -1)
        under = F.slice(stack, F.lit(1), F.size(stack) - 1)
        name = F.upper(F.regexp_extract(t, f"(?s){call}", 1))
        rest = F.length(F.regexp_extract(t, r"(?s)(\w+\s*\()$", 1))
        opens = t.endswith("(") & ~t.rlike("^['\"`]")
        pushed = F.array_append(stack, top_of(name, after - rest, after, F.lit(0), F.lit(0)))
        counted = F.concat(under, F.array(top_of(top["name"], top["call"], top["open"],
                                                 F.when(top["commas"] == 0, pos).otherwise(top["comma"]), top["commas"] + 1)))
        new = edits_of(top["name"], top["call"], top["comma"], pos,
                       F.substring(text, top["open"], top["comma"] - top["open"]),
                       F.substring(text, top["comma"] + 1, pos - top["comma"] - 1))
        inside = F.size(stack) > 0
        closes = (t == ")") & inside
        return F.struct(
            after.alias("pos"),
            F.when(opens, pushed).when(closes, under).when((t == ",") & inside, counted).otherwise(stack).alias("stack"),
            F.when(closes & (top["name"] != "") & (top["commas"] == 1), F.concat(a["edits"], new))
            .otherwise(a["edits"]).alias("edits"))

    def apply(a: Column) -> Column:
        begin = F.struct(F.lit(1).alias("pos"), F.lit("").alias("out"))
        return F.aggregate(F.array_sort(a["edits"]), begin, lambda o, e: F.struct(
            e["until"].alias("pos"), F.concat(o["out"], F.substring(text, o["pos"], e["at"] - o["pos"]), e["text"]).alias("out")),
            lambda o: F.concat(o["out"], F.substring(text, o["pos"], F.length(text))))

    return F.aggregate(tokens, start, step, apply)

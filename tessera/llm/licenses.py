"""Operator 4, license scans by an exact set-similarity join (SQL functions only).

Text blocks are the lines of a document as sets of words; a block matches a
license template when it holds at least ``THRESHOLD`` of the template's distinct
words. Tokens are ordered by their document frequency over the whole corpus,
rarest first, and three filters leave few comparisons, losing no match:

* prefix: with ``needed`` common words, one of the template's
  ``size - needed + 1`` rarest words is in the block;
* length: the block has at least ``needed`` distinct words;
* positional: the rarest common word bounds the overlap by what follows it in
  both orders.

The templates are a bounded parameter and stand in the plan as literals, so the
join is local to each row: no shuffle of documents, no hot key. Only the
frequency table (a row per template word) is gathered. Base labels are phrases
whose words stand consecutively; they stay whatever the templates say.

Defined cases: a null text is empty (0 words, no labels, score 0); repeated rows
and rows with null ids each get their own result; empty tables give no rows;
texts and lines of any length are taken whole; only ``doc_id`` and the text are
read, so extra columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Template notices (their first sentences, lower case, words only).
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-or-later", "you can redistribute it and or modify it under the terms of the gnu general public license "
                     "as published by the free software foundation"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software "
                   "and associated documentation files"),
    ("mit-released", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
            "is hereby granted"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-short-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def ascii_lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(low: Column) -> Column:
    return F.array_remove(F.split(low, SEPARATOR), "")


def token_order(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> list[str]:
    """Template words by document frequency, rarest first (ties: by word)."""
    vocab = sorted({w for _, t in templates for w in t.split()})
    rows = docs.select(F.explode(F.array_intersect(F.array(*map(F.lit, vocab)), words(ascii_lower(F.col(text))))).alias("w")) \
        .groupBy("w").count().collect()              # a row per template word at most
    seen = {r["w"]: r["count"] for r in rows}
    return sorted(vocab, key=lambda w: (seen.get(w, 0), w))


def _templates(order: list[str], templates, threshold: float) -> tuple[Column, list[str]]:
    """The templates as an array of structs, and all their prefix words."""
    rank = {w: i for i, w in enumerate(order)}
    out, first = [], set()
    for label, text in templates:
        tokens = sorted(set(text.split()), key=rank.__getitem__)
        needed = math.ceil(threshold * len(tokens) - 1e-9)
        prefix = tokens[:len(tokens) - needed + 1]
        first |= set(prefix)
        out.append(F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, tokens)).alias("tokens"),
                            F.array(*map(F.lit, prefix)).alias("prefix"), F.lit(needed).alias("needed")))
    return F.array(*out), sorted(first)


def _block_matches(block: Column, order: Column, templates: Column) -> Column:
    """Templates that a block (array of words) meets: array of (label, score)."""
    distinct = F.size(F.array_distinct(block))

    def meets(t: Column, mine: Column) -> Column:
        common = F.element_at(F.array_intersect(t["prefix"], mine), 1)        # rarest common word of the prefix
        bound = 1 + F.least(F.size(t["tokens"]) - F.array_position(t["tokens"], common),
                            F.size(mine) - F.array_position(mine, common))
        return (distinct >= t["needed"]) & F.arrays_overlap(t["prefix"], mine) & (bound >= t["needed"]) \
            & (F.size(F.array_intersect(t["tokens"], mine)) >= t["needed"])

    # the block's template words in global order, bound once as a one-element array
    one = F.array(F.array_intersect(order, block))
    return F.flatten(F.transform(one, lambda mine: F.transform(
        F.filter(templates, lambda t: meets(t, mine)),
        lambda t: F.struct(t["label"].alias("label"),
                           (F.size(F.array_intersect(t["tokens"], mine)) / F.size(t["tokens"])).alias("score")))))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES,
         threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    order = token_order(docs, text, templates)
    table, prefix = _templates(order, templates, threshold)
    vocab = F.array(*map(F.lit, order))
    first_words = F.array(*map(F.lit, prefix))
    rows = docs.select(F.col(key).alias("doc_id"), ascii_lower(F.col(text)).alias("low"))
    rows = rows.withColumn("words", words(F.col("low")))
    # templates, only in documents that hold a prefix word at all
    blocks = F.filter(F.transform(F.split("low", "\n"), words), lambda b: F.arrays_overlap(b, first_words))
    found = F.flatten(F.transform(blocks, lambda b: _block_matches(b, vocab, table)))
    none = F.array().cast("array<struct<label:string,score:double>>")
    rows = rows.withColumn("found", F.when(F.arrays_overlap("words", first_words), found).otherwise(none))
    # phrases, only in documents that hold the last word of one
    last_words = F.array(*[F.lit(w) for w in sorted({p.split()[-1] for p, _ in phrases})])
    line = F.when(F.arrays_overlap("words", last_words),
                  F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).otherwise(F.lit(""))
    rows = rows.select("doc_id", F.size("words").cast("bigint").alias("n_words"), "found", line.alias("line"))
    counts, starts, ends, labels = [], [], [], []

    def spaces(c: Column) -> Column:
        return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))

    for phrase, label in phrases:
        spaced = f" {phrase} "
        has = F.col("line").contains(spaced)
        counts.append(F.when(has, F.regexp_count("line", F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0))
        starts.append(F.when(has, spaces(F.substring_index("line", spaced, 1))))
        ends.append(F.when(has, F.col("n_words") - spaces(F.substring_index("line", spaced, -1)) - len(phrase.split())))
        labels.append(F.when(has, F.lit(label)))
    base = F.filter(F.array(*labels), lambda x: x.isNotNull())
    rows = rows.withColumn("base", base)
    return rows.select(
        "doc_id", "n_words", sum(counts[1:], counts[0]).cast("bigint").alias("n_base"),
        F.least(*starts).cast("bigint").alias("first_word"), F.greatest(*ends).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("found", lambda m: m["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda m: m["score"])), F.lit(0.0)).alias("score"))


def _oracle() -> str:
    w = (rf"regexp_extract_all({{}}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES)
    templates = ", ".join(f"('{label}', list_distinct(string_split('{t}', ' ')), "
                          f"{math.ceil(THRESHOLD * len(set(t.split())) - 1e-9)})" for label, t in TEMPLATES)
    return rf"""
WITH d AS (SELECT doc_id, {low} AS low, {w.format(low)} AS w FROM documents),
p(phrase, label, n) AS (VALUES {phrases}),
t(label, tokens, needed) AS (VALUES {templates}),
places AS (SELECT doc_id, label, i - 1 AS place FROM (
    SELECT doc_id, label, phrase, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, p WHERE len(w) >= n)
  WHERE array_to_string(list_slice(w, i, i + n - 1), ' ') = phrase),
b AS (SELECT doc_id, count(*) AS n, min(place) AS f, max(place) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS s
      FROM places GROUP BY doc_id),
blocks AS (SELECT doc_id, list_distinct({w.format('line')}) AS ws
           FROM (SELECT doc_id, unnest(string_split(low, chr(10))) AS line FROM d)),
m AS (SELECT doc_id, label, len(list_intersect(tokens, ws))::DOUBLE / len(tokens) AS score
      FROM blocks, t WHERE len(list_intersect(tokens, ws)) >= needed),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS s
          FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM m) GROUP BY doc_id),
best AS (SELECT doc_id, max(score) AS score FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.f::BIGINT AS first_word, b.l::BIGINT AS last_word,
       coalesce(b.s, '') AS base_labels, coalesce(every.s, '') AS labels, coalesce(best.score, 0)::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)
"""


ORACLE = _oracle()

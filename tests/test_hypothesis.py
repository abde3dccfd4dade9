"""Randomised checks of text functions against hand-written scanners (run in
batches: one Spark job per example list)."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.functions import nesting as N
from tessera.functions import text as TX

ALPHABET = st.sampled_from(list("ab ;[m0123\x1b\x01\x07\t\n\r\x7fSELECTwith`") + ["```sql", "```", "\x1b[32m"])
TEXTS = st.lists(st.lists(ALPHABET, max_size=30).map("".join), min_size=1, max_size=40)
NESTED = st.lists(st.lists(st.sampled_from(list("ab,;()'\"` ")), max_size=25).map("".join), min_size=1, max_size=40)
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def without_controls(s):
    """Drop escape sequences while scanning, then control characters."""
    kept, i = [], 0
    while i < len(s):
        j = i + 2
        if s.startswith("\x1b[", i):
            while j < len(s) and s[j] in "0123456789;":
                j += 1
            if j < len(s) and s[j] in LETTERS:
                i = j + 1
                continue
        if s[i] in "\t\n\r" or " " <= s[i] != "\x7f":
            kept.append(s[i])
        i += 1
    return "".join(kept)


def statement_in(text):
    """The first closed ```sql block, else from the earliest starter word that
    a ';' follows up to that ';'."""
    low, at = text.lower(), -1
    while (at := low.find("```sql", at + 1)) >= 0:
        end = low.find("```", at + 6)
        if end >= 0:
            return text[at + 6:end].strip()
    starts = sorted((p, w) for w in TX.SQL_STARTERS for p in range(len(text)) if low.startswith(w.lower(), p))
    for p, w in starts:
        end = text.find(";", p + len(w))
        if end >= 0:
            return text[p:end + 1].strip()
    return None


def top_level(text, sep):
    out, cur, depth, i = [], "", 0, 0
    while i < len(text):
        ch = text[i]
        end = text.find(ch, i + 1) if ch in "'\"`" else -1
        piece = text[i:end + 1] if end > 0 else ch
        depth += (ch == "(") - (ch == ")")
        if ch == sep and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += piece
        i += len(piece)
    return [*out, cur]


def _run(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


@settings(max_examples=25, deadline=None)
@given(TEXTS)
def test_scrub_matches_scanner(spark, texts):
    assert _run(spark, texts, TX.scrub_control_chars) == [without_controls(t) for t in texts]


@settings(max_examples=25, deadline=None)
@given(TEXTS)
def test_extract_matches_scanner(spark, texts):
    assert _run(spark, texts, TX.extract_sql) == [statement_in(t) for t in texts]


@settings(max_examples=25, deadline=None)
@given(TEXTS)
def test_word_count_matches_split(spark, texts):
    assert _run(spark, texts, TX.word_count) == [len(t.split()) for t in texts]


@settings(max_examples=25, deadline=None)
@given(NESTED)
def test_top_level_split_matches_scanner(spark, texts):
    for sep in ",;":
        assert _run(spark, texts, lambda x, s=sep: N.split_top_level(x, s)) == [top_level(t, sep) for t in texts]

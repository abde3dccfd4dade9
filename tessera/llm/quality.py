"""Operator 1, quality rules: line-first cleaning.

Every line of a text is judged on its own by punctuation, navigation and
boilerplate rules; failing lines are removed; the document is rejected when the
removed lines held more than ``max_lost_pct`` percent of its words, or when it
fails the base rules (fewer than ``min_words`` words, or more than
``max_repeat_pct`` percent of its words in 5-word windows repeated inside it).

One pass, no shuffle: each task works on slices of its Arrow batches.

Defined cases: a null text has no words, one (empty) line, and fails the base
rules; the text column of the result is null for it. Empty tables give no rows.
Repeated rows are judged each on its own. Columns of the input with the name of
an added column are replaced. Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textcols as tc
from tessera.llm.shipping import ship

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
MAX_LOST_PCT = 30

SYMBOLS = b"#*$%&|<>"              # the base symbol count
LINE_SYMBOLS = b"#*$%&|<>~^{}\\=_"  # punctuation rule: over a tenth of a line's characters
LINE_MARKS = b"!?"                 # punctuation rule: three or more, over a twelfth
SEPARATORS = ("|", "/", ">", "»", "›", "·", "•")  # navigation rule: words that only separate links
# Boilerplate rule: phrases (ASCII case ignored) in lines of up to MAX_BOILERPLATE_WORDS words.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "use of cookies", "uses cookies", "accept cookies", "enable javascript", "javascript is disabled",
    "click here to", "subscribe to our newsletter", "sign up for our newsletter", "share this article",
    "follow us on", "skip to content", "skip to main content", "back to top",
)
MAX_BOILERPLATE_WORDS = 40
# Navigation rule: a line that is one of these menu entries and nothing else.
MENU = (
    "home", "menu", "search", "login", "log in", "sign in", "sign up", "register", "contact", "contact us",
    "about", "about us", "next", "previous", "read more", "share", "print", "sitemap", "faq",
)
BOILERPLATE_RE = "(?i)" + "|".join(BOILERPLATE)
MENU_RE = "(?i)^[ \t]*(" + "|".join(MENU) + ")[ \t]*$"

REPORT = pa.schema([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("n_lines", pa.int64()),
    ("n_lines_removed", pa.int64()), ("n_words_kept", pa.int64()), ("kept", pa.bool_()),
])


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYM, _LSYM, _MARK = _table(SYMBOLS), _table(LINE_SYMBOLS), _table(LINE_MARKS)


def _hash_of(words: tuple[str, ...]) -> np.ndarray:
    raw = [w.encode() for w in words]
    e = np.cumsum([len(w) for w in raw])
    return tc.hash_spans(np.frombuffer(b"".join(raw), np.uint8), e - [len(w) for w in raw], e)


def _judge(data: np.ndarray, offs: np.ndarray, want_text: bool) -> tuple[list[np.ndarray], list[str] | None]:
    n_docs = len(offs) - 1
    ws, we, wo = tc.split_words(data, offs)
    n_words = np.diff(wo)
    point = ((data & 0xC0) != 0x80) & ~tc.SPACE[data]     # first bytes of non-space characters
    word_chars = tc.span_sums(point, offs)
    n_symbols = tc.span_sums(_SYM[data], offs)
    wh = tc.hash_spans(data, ws, we)
    doc_salt = tc.mix64(np.arange(1, n_docs + 1).astype(tc.U64))
    # words in 5-word windows that occur twice or more in the document
    win = tc.windows(wh, WINDOW)
    ok = np.flatnonzero(tc.window_ok(wo, len(wh), WINDOW)) if len(win) else np.zeros(0, np.int64)
    twice = np.zeros(len(win), bool)
    twice[ok] = tc.repeated(win[ok] ^ doc_salt[tc.owner(wo)[ok]])
    n_repeat = tc.span_sums(tc.cover(twice, WINDOW, len(wh)), wo) if len(wh) else np.zeros(n_docs, np.int64)
    # lines
    ls, le, lo = tc.split_lines(data, offs)
    line_w = np.searchsorted(ws, np.append(ls, len(data) + 1))
    line_words = np.searchsorted(ws, le) - line_w[:-1]
    line_doc = tc.owner(lo)
    with_word = np.flatnonzero(line_words > 0)
    lh = tc.hash_spans(data, ls, le)[with_word] ^ doc_salt[line_doc[with_word]]
    order = np.argsort(lh, kind="stable")
    later = np.zeros(len(lh), bool)
    later[order[1:]] = lh[order[1:]] == lh[order[:-1]]
    n_dup = np.bincount(line_doc[with_word][later], minlength=n_docs)

    def per_line(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[le] - c[ls]

    chars, syms, marks = per_line(point), per_line(_LSYM[data]), per_line(_MARK[data])
    c = np.zeros(len(wh) + 1, np.int64)
    np.cumsum(np.isin(wh, _SEP_HASH), out=c[1:])
    w0 = np.searchsorted(ws, ls)
    seps = c[w0 + line_words] - c[w0]
    raw = pa.LargeStringArray.from_buffers(
        len(ls), pa.py_buffer(np.append(ls, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    raw = pc.utf8_rtrim(raw, characters="\n")
    phrase = np.asarray(pc.match_substring_regex(raw, BOILERPLATE_RE))
    menu = np.asarray(pc.match_substring_regex(raw, MENU_RE))
    bad = (10 * syms > chars) | ((marks >= 3) & (12 * marks > chars)) | ((seps >= 2) & (5 * seps >= line_words)) \
        | menu | (phrase & (line_words <= MAX_BOILERPLATE_WORDS))
    bad &= line_words > 0
    lost = tc.span_sums(np.where(bad, line_words, 0), lo)
    base = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PCT * n_words)
    kept = ~base & (100 * lost <= MAX_LOST_PCT * n_words)
    cols = [n_words, word_chars, n_symbols, n_dup, n_repeat, base, np.diff(lo), tc.span_sums(bad, lo),
            n_words - lost, kept]
    texts = None
    if want_text:
        keep = np.flatnonzero(~bad)
        texts = tc.gather_text(data, ls[keep], le[keep], np.searchsorted(keep, lo), b"\n")
    return cols, texts


_SEP_HASH = _hash_of(SEPARATORS)


def _report(text: pa.Array, want_text: bool) -> tuple[list[pa.Array], pa.Array | None]:
    cols: list[list[np.ndarray]] = [[] for _ in REPORT]
    texts: list[str] = []
    for _, _, data, offs in tc.utf8_slices(text):
        got, t = _judge(data, offs, want_text)
        for c, g in zip(cols, got):
            c.append(g)
        texts += t or []
    out = [pa.array(np.concatenate(c) if c else np.zeros(0), f.type) for c, f in zip(cols, REPORT)]
    cleaned = None
    if want_text:
        cleaned = pa.array(texts, pa.string())
        if text.null_count:
            cleaned = pc.if_else(pc.is_valid(text), cleaned, pa.scalar(None, pa.string()))
    return out, cleaned


def assess(docs: DataFrame, text: str = "text", clean: bool = False) -> DataFrame:
    """``docs`` with the report columns appended; with ``clean`` the text
    column holds the lines that passed, joined by newlines."""
    added = set(REPORT.names)
    base = docs.select(*[c for c in docs.columns if c not in added or c == text])
    schema = base.limit(0)
    for f in REPORT:
        schema = schema.withColumn(f.name, F.lit(None).cast("boolean" if f.type == pa.bool_() else "bigint"))
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            report, cleaned = _report(b.column(names.index(text)), clean)
            cols = [cleaned if clean and n == text else b.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(cols + report, names=names + REPORT.names)

    ship(docs.sparkSession)
    return base.mapInArrow(run, schema.schema)


def filter_quality(docs: DataFrame) -> DataFrame:
    """Pipeline form: documents that are kept, with their cleaned text and its
    length, in the columns of ``docs``."""
    kept = assess(docs, clean=True).filter("kept")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast("bigint"))
    return kept.select(*docs.columns)


def _sql_list(items: tuple[str, ...]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


# DuckDB twin of assess(): words and windows as lists, one list entry per line.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  string_split(coalesce(text, ''), chr(10)) AS lines
           FROM documents),
win AS (SELECT doc_id, w, i, list_slice(w, i, i + {WINDOW - 1}) AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
          SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p
          FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw,
              length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars
       FROM (SELECT doc_id, unnest(lines) AS line FROM d)),
dup AS (SELECT doc_id, sum(c - 1)::BIGINT AS n FROM (
          SELECT doc_id, line, count(*) AS c FROM ln WHERE nw > 0 GROUP BY ALL) GROUP BY doc_id),
judged AS (SELECT doc_id, nw, nw > 0 AND (
       10 * length(regexp_replace(line, '[^#*$%&|<>~^{{}}\\=_]', '', 'g')) > chars
    OR (length(regexp_replace(line, '[^!?]', '', 'g')) >= 3
        AND 12 * length(regexp_replace(line, '[^!?]', '', 'g')) > chars)
    OR (len(list_filter(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: x IN ({_sql_list(SEPARATORS)}))) >= 2
        AND 5 * len(list_filter(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: x IN ({_sql_list(SEPARATORS)}))) >= nw)
    OR regexp_matches(line, '{MENU_RE}')
    OR (nw <= {MAX_BOILERPLATE_WORDS} AND regexp_matches(line, '{BOILERPLATE_RE}'))) AS bad FROM ln),
lost AS (SELECT doc_id, count(*) AS n_lines, sum(bad::INT)::BIGINT AS removed,
                sum(CASE WHEN bad THEN nw ELSE 0 END)::BIGINT AS lost FROM judged GROUP BY doc_id),
b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             n_lines::BIGINT AS n_lines, removed AS n_lines_removed, len(w) - lost AS n_words_kept, lost
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
       n_lines, n_lines_removed, n_words_kept,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words)
         AND 100 * lost <= {MAX_LOST_PCT} * n_words AS kept
FROM b
"""

"""Operator 11, spelling variants grouped by reduced-alphabet generation.

Letters are hashed to ``symbols`` symbols (code point modulo ``symbols``), so a
word becomes a reduced word of the same length, and two words within one edit
have reduced words within one edit. The one-edit neighbourhood of every reduced
word is generated and joined with the reduced vocabulary; what meets is verified
on the original strings. Being neighbours is mutual, so each pair of reduced
words is generated from one end: a longer word generates its deletions (the other
word's insertions), of two words of one length that with the smaller symbol
generates the replacement, and words with the same reduced word meet by it. So a
pair of words is met once and no pair is missed.

A reduced word is known by a 64-bit polynomial hash, which gives the hash of a
neighbour without building it; a clash of hashes only adds a pair to verify.
Shuffled are word counts (summed per slice and task before), about 40 rows of two
numbers per vocabulary word, and the pairs that meet. A frequent reduced word
meets many neighbours; AQE splits such a join key. Words, not occurrences, are
joined, so a hot word of the corpus is one row.

A word's form is its near word of largest count if that is at least
``dominance`` times its own; forms are followed to the root by pointer doubling.
Counts at least double on the way, so a chain has less than 64 steps and at most
six rounds of doubling end it. Tables between the steps are written to the shared
folder (``counts.keep``; whoever owns that folder clears it, since results are
read from it lazily), so a lost executor costs tasks only.

Defined cases: a null text has no words; a null id counts as the empty string in
the crc rule; repeated rows count each; ties between near words go to the first
in code-point order; empty tables give no rows; other columns are not read. Texts
and words are taken whole, whatever their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textcols as tc
from tessera.llm.counts import keep
from tessera.llm.shipping import ship

SYMBOLS = 8            # size of the reduced alphabet
LEAST_POINTS = 5       # code points of a vocabulary word, at least
LEAST_COUNT = 3        # occurrences of a vocabulary word, at least
DOMINANCE = 2          # a form is at least this many times as frequent
DROP_EVERY = 97        # occurrences whose crc this divides lose one code point
TABLE_BYTES = 64       # longer runs take the crc one by one
GENERATED_ROWS = 1 << 20

_LETTER = np.zeros(256, bool)     # after lower-casing; 0xC3 leads U+00C0 to U+00FF
_LETTER[97:123] = _LETTER[0xC3] = True
_NOT_RUN = np.array([True, False])
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


# -- words -------------------------------------------------------------------

def _runs(data: np.ndarray, offs: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The lower-cased letter runs of a slice, and the document of each."""
    low = tc.LOWER[data]
    inside = _LETTER[low]
    inside[1:] |= data[:-1] == 0xC3
    starts, ends, first = tc.split_words(inside.view(np.uint8), offs, _NOT_RUN)
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [
        None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(low[inside]))])
    return runs, tc.owner(first)


def _crc_of_runs(idents: list[str], doc: np.ndarray, words: list[bytes], lens: np.ndarray, use: np.ndarray) -> np.ndarray:
    """crc32 of ``<ident>:<word>`` per occurrence: the identifier's crc moved
    over as many zero bytes as the word has, xor the word's own crc."""
    prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in idents], np.uint32)
    moved = np.empty((min(int(lens.max()), TABLE_BYTES) + 1, len(prefix)), np.uint32)
    moved[0] = prefix
    for k in range(1, len(moved)):
        moved[k] = _CRC[moved[k - 1] & 255] ^ (moved[k - 1] >> 8)
    own = np.array([zlib.crc32(w) for w in words], np.uint32)
    size = lens[use]
    out = moved[np.minimum(size, len(moved) - 1), doc] ^ own[use]
    for k in np.flatnonzero(size > TABLE_BYTES):
        out[k] = zlib.crc32(words[use[k]], int(prefix[doc[k]]))
    return out


def _count_slice(idents: list[str], data: np.ndarray, offs: np.ndarray, drop_every: int | None,
                 least_points: int) -> tuple[list[str], list[int]]:
    """Words of a slice and their counts."""
    runs, doc = _runs(data, offs)
    if not len(runs):
        return [], []
    coded = runs.dictionary_encode()
    use = coded.indices.to_numpy()
    kinds = coded.dictionary
    points = pc.utf8_length(kinds.cast(pa.large_string())).to_numpy()
    words = kinds.to_pylist()
    if drop_every:
        crc = _crc_of_runs(idents, doc, words, pc.binary_length(kinds).to_numpy(), use)
        hit = crc % np.uint32(drop_every) == 0
    else:
        crc, hit = None, np.zeros(len(use), bool)
    n = np.bincount(use[~hit], minlength=len(words))
    whole = np.flatnonzero((n > 0) & (points >= least_points))
    out, counts = [words[k].decode() for k in whole.tolist()], n[whole].tolist()
    k = np.flatnonzero(hit & (points[use] > least_points))
    if len(k):
        pos = crc[k].astype(np.int64) % points[use[k]]
        pairs, n = np.unique(np.stack([use[k], pos]), axis=1, return_counts=True)
        for (w, p), c in zip(pairs.T.tolist(), n.tolist()):
            t = words[w].decode()
            out.append(t[:p] + t[p + 1:])
            counts.append(c)
    return out, counts


def word_counts(docs: DataFrame, ident: str = "doc_id", text: str = "text", drop_every: int | None = DROP_EVERY,
                least_points: int = LEAST_POINTS) -> DataFrame:
    """(word, n) over all texts: runs of letters, A-Z lower-cased, those of at
    least ``least_points`` code points. With ``drop_every``, occurrences whose
    crc it divides lose the code point that the crc names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            idents = [i or "" for i in b.column(0).to_pylist()]
            for lo, hi, data, offs in tc.utf8_slices(b.column(1)):
                words, n = _count_slice(idents[lo:hi], data, offs, drop_every, least_points)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    ship(docs.sparkSession)
    source = docs.select(F.col(ident).cast("string").alias("i"), F.col(text).alias("t"))
    return source.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# -- neighbours --------------------------------------------------------------

def _symbols(col: pa.Array, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Reduced letters of all words, flat, and their offsets."""
    points = np.frombuffer("".join(col.to_pylist()).encode("utf-32-le"), np.uint32)
    offs = np.concatenate([[0], np.cumsum(pc.utf8_length(col).to_numpy())]).astype(np.int64)
    return (points % np.uint32(symbols)).astype(np.int64), offs


def _terms(sym: np.ndarray, offs: np.ndarray, symbols: int):
    """Code of each symbol, weight of each place, prefix hash before each place
    (from the word's start) and the whole hash of each word."""
    code = tc.mix64(np.arange(1, symbols + 1, dtype=np.uint64) * _BASE)
    place = np.arange(len(sym)) - np.repeat(offs[:-1], np.diff(offs))
    longest = int(np.diff(offs).max()) if len(offs) > 1 else 0
    power = np.full(longest + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    weight = power[place]
    total = np.zeros(len(sym) + 1, np.uint64)
    np.cumsum(code[sym] * weight, out=total[1:])
    before = total[:-1] - np.repeat(total[offs[:-1]], np.diff(offs))
    return code, weight, before, total[offs[1:]] - total[offs[:-1]]


def _key(raw: np.ndarray) -> np.ndarray:
    return tc.mix64(raw).view(np.int64)


def reduced_keys(col: pa.Array, symbols: int = SYMBOLS) -> np.ndarray:
    """Key of the reduced word of each word."""
    sym, offs = _symbols(col, symbols)
    return _key(_terms(sym, offs, symbols)[3])


def neighbourhood(col: pa.Array, symbols: int = SYMBOLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield (word number, key) of the reduced neighbours that each word
    generates: itself, its distinct deletions, and its replacements by larger
    symbols."""
    sym, offs = _symbols(col, symbols)
    if not len(sym):
        return
    code, weight, before, whole = _terms(sym, offs, symbols)
    word = np.repeat(np.arange(len(col)), np.diff(offs))
    yield np.arange(len(col)), _key(whole)
    after = whole[word] - before - code[sym] * weight            # what follows a place
    first = np.ones(len(sym), bool)                               # of a run of one symbol
    first[1:] = (sym[1:] != sym[:-1]) | (word[1:] != word[:-1])
    yield word[first], _key(before[first] + after[first] * _BASE_INV)
    for s in range(1, symbols):
        k = np.flatnonzero(sym < s)
        yield word[k], _key(whole[word[k]] + (code[s] - code[sym[k]]) * weight[k])


def vocabulary(counts: DataFrame, least_count: int = LEAST_COUNT, symbols: int = SYMBOLS) -> DataFrame:
    """(id, word, n, key) of the words with at least ``least_count``
    occurrences, written once so that the ids stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(reduced_keys(b.column(1), symbols))],
                                             ["id", "word", "n", "key"])

    some = counts.filter(F.col("n") >= least_count).select(F.monotonically_increasing_id().alias("id"), "word", "n")
    return keep(some.mapInArrow(run, "id bigint, word string, n bigint, key bigint"), "variant-words")


def near_pairs(vocab: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """Each unordered pair of near words once: (a_word, a_n, b_word, b_n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            idents = b.column(0).to_numpy()
            for word, key in neighbourhood(b.column(1), symbols):
                for lo in range(0, len(word), GENERATED_ROWS):
                    part = slice(lo, lo + GENERATED_ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(idents[word[part]]), pa.array(key[part])], ["a_id", "key"])

    ship(vocab.sparkSession)
    made = vocab.select("id", "word").mapInArrow(run, "a_id bigint, key bigint")
    b = vocab.select("key", *[F.col(c).alias(f"b_{c}") for c in ("id", "word", "n")])
    a = vocab.select(*[F.col(c).alias(f"a_{c}") for c in ("id", "word", "n", "key")])
    met = made.join(b, "key").filter(F.col("a_id") != F.col("b_id"))
    # words with one reduced word meet from both ends: the smaller id counts
    once = (F.col("a_key") != F.col("key")) | (F.col("a_id") < F.col("b_id"))
    return met.join(a, "a_id").filter(once & (F.levenshtein("a_word", "b_word", 1) == 1)) \
        .select("a_word", "a_n", "b_word", "b_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words that have a form, by pointer doubling."""
    at = keep(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "variant-roots")
    while at.filter("moved").limit(1).count():
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = keep(at.drop("moved").join(step, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
    return at.select("word", "root")


def group(vocab: DataFrame, symbols: int = SYMBOLS, dominance: int = DOMINANCE) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary."""
    ends = near_pairs(vocab, symbols).select(F.explode(F.array(
        F.struct(F.col("a_word").alias("word"), F.col("b_word").alias("other"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b_word").alias("word"), F.col("a_word").alias("other"), F.col("a_n").alias("other_n")))).alias("e"))
    best = ends.groupBy("e.word").agg(F.count(F.lit(1)).alias("n_near"),
                                      F.min(F.struct((-F.col("e.other_n")).alias("n"), F.col("e.other").alias("form"))).alias("top"))
    top_n = -F.col("top.n")
    wins = top_n >= dominance * F.col("n")
    words = keep(vocab.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(wins, F.col("top.form")).alias("form"), F.when(wins, top_n).alias("form_n")), "variant-forms")
    roots = _roots(words.filter("form IS NOT NULL"))
    return words.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(docs: DataFrame) -> DataFrame:
    return group(vocabulary(word_counts(docs)))


# DuckDB twin: crc32 byte by byte, near words by equal deletions.
ORACLE = rf"""
WITH RECURSIVE
steps AS (SELECT range AS n, list_reduce(range(8)::BIGINT[], lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), range) AS t FROM range(256)),
crc AS (SELECT list(t ORDER BY n) AS tab FROM steps),
runs AS (SELECT doc_id, run, count(*) AS c FROM (
           SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
coded AS (SELECT run, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
hashed AS (SELECT run, c, xor(4294967295, list_reduce(
               list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT),
               lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295)) AS h FROM coded, crc),
done AS (SELECT CASE WHEN h % {DROP_EVERY} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
                     ELSE run END AS word, c FROM hashed),
v AS (SELECT word, sum(c)::BIGINT AS n FROM done WHERE length(word) >= {LEAST_POINTS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
del AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT DISTINCT * FROM (
           SELECT a.word AS word, a.n AS n, b.word AS other, b.n AS other_n FROM del a JOIN del b USING (i, d) WHERE a.word <> b.word
           UNION ALL SELECT del.word, del.n, v.word, v.n FROM del JOIN v ON v.word = del.d
           UNION ALL SELECT v.word, v.n, del.word, del.n FROM del JOIN v ON v.word = del.d)),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(k := -other_n, form := other)) AS top FROM near GROUP BY word),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near,
                 CASE WHEN -top.k >= {DOMINANCE} * v.n THEN top.form END AS form,
                 CASE WHEN -top.k >= {DOMINANCE} * v.n THEN (-top.k)::BIGINT END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at_word, form AS next_word FROM forms
         UNION ALL SELECT walk.word, forms.word, forms.form FROM walk JOIN forms ON forms.word = walk.next_word)
SELECT forms.word, form, at_word AS root, n, n_near, form_n FROM forms JOIN walk USING (word) WHERE next_word IS NULL
"""

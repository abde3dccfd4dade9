"""Operator 13, ranked lexical search by an Aho-Corasick scan of the documents.

The terms of all items are compiled into one automaton whose patterns carry a
guard (one space) on both sides; a document is scanned as its lower-cased bytes
with every separator turned into that guard, so a match is a whole term and its
number in the document is tf. There is no document index: a first scan gives the
statistics (documents, terms, document frequencies), a second one scores. The
outputs of the automaton map to the items that hold the term, so a document's
matches become item scores by one sparse product.

Items are packed into blocks of at most ``BLOCK_ROWS`` (item, term) rows, cut
between 2^14 hash buckets of item ids that Spark has counted; what is gathered,
broadcast and held by a worker at once is one block (a hash bucket or an item
that alone is larger is a block of its own). Usually there is one block. Each
task keeps the best ``TOP`` documents of every item, exactly, and only those are
shuffled; they are ranked within (item, salt) and then within the item, so that
no task sees more than ``TOP`` rows of a salt.

Texts are scanned in pieces of ``PIECE_BYTES`` cut at separators, so memory does
not follow the length of a text beyond its own bytes.

Defined cases: a null text has no terms; null ids rank last among equal scores;
rows of ``items`` with the same id are one item with the terms of all of them; an
item without terms, and empty tables, give no rows; repeated documents rank each.
Document ids must be whole numbers. Extra columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textcols as tc
from tessera.llm.counts import keep
from tessera.llm.shipping import ship

TOP = 10
BLOCK_ROWS = 1 << 18     # (item, term) rows of a block
BUCKETS = 1 << 14        # hash buckets of items, the unit of packing
PIECE_BYTES = 4 << 20
CELLS = 1 << 21          # (document, item) cells and products at once
SALTS = 64
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GUARDED = tc.LOWER.copy()        # separators become the guard
_GUARDED[tc.NOT_ALNUM[tc.LOWER]] = 32


def item_terms(items: DataFrame, ident: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term, times, bucket) of every item."""
    term = F.explode(F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(TERM), F.lit(0)))
    return items.select(F.col(ident).alias("item"), term.alias("term")).groupBy("item", "term") \
        .agg(F.count(F.lit(1)).alias("times")) \
        .withColumn("bucket", F.pmod(F.xxhash64(F.col("item").cast("string")), F.lit(BUCKETS)).cast("int"))


def pack(sizes: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """(first, last) buckets of the blocks: neighbours together up to ``limit`` rows."""
    out: list[list[int]] = []
    held = 0
    for bucket, n in sorted(sizes):
        if out and held + n <= limit:
            out[-1][1] = bucket
            held += n
        else:
            out.append([bucket, bucket])
            held = n
    return [(a, b) for a, b in out]


class Block:
    """Terms of a block of items, and the items of each term."""

    def __init__(self, rows: list) -> None:
        order = sorted({r["item"] for r in rows}, key=lambda i: (i is None, i))
        number = {i: k for k, i in enumerate(order)}
        self.items = order
        self.terms = sorted({r["term"] for r in rows})
        at = {t: k for k, t in enumerate(self.terms)}
        pairs = sorted((at[r["term"]], number[r["item"]], r["times"]) for r in rows)
        of = np.array([p[0] for p in pairs], np.int64)
        self.item = np.array([p[1] for p in pairs], np.int64)
        self.times = np.array([p[2] for p in pairs], np.int64)
        self.first = np.searchsorted(of, np.arange(len(self.terms) + 1))
        self.weight = np.zeros(len(self.terms), np.int64)
        self.n_docs = self.n_terms = 0
        self.token = uuid.uuid4().hex

    def weigh(self, n_docs: int, n_terms: int, df: dict[int, int]) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(k, 0) + 1)))
                                for k in range(len(self.terms))], np.int64)
        self.token = uuid.uuid4().hex


_BUILT: dict[str, ahocorasick.Automaton] = {}


def automaton(block: Block) -> ahocorasick.Automaton:
    """The guarded automaton of a block, built once per worker."""
    if block.token not in _BUILT:
        _BUILT.clear()
        built = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, term in enumerate(block.terms):
            built.add_word(f" {term.encode().decode('latin-1')} ", k)     # one character a byte
        built.make_automaton()
        _BUILT[block.token] = built
    return _BUILT[block.token]


_MATCH = np.dtype([("end", np.int64), ("term", np.int64)])


def _matches(built: ahocorasick.Automaton, text: np.ndarray, piece: int) -> Iterator[np.ndarray]:
    """Ends and terms of all matches in guarded bytes, piece by piece; a piece
    ends with a guard and the next one starts with the same."""
    lo, n = 0, len(text)
    while lo < n - 1:
        hi = min(n, lo + max(2, piece))
        while hi < n and text[hi - 1] != 32:
            stop = np.flatnonzero(text[hi:hi + piece] == 32)
            hi = hi + int(stop[0]) + 1 if len(stop) else min(n, hi + piece)
        got = np.fromiter(built.iter(text[lo:hi].tobytes().decode("latin-1")), _MATCH)
        got["end"] += lo
        yield got
        lo = hi - 1


def scan(block: Block, data: np.ndarray, offs: np.ndarray, piece: int = PIECE_BYTES):
    """Terms in each document, and (document, term, tf) of the block's terms,
    sorted by document and term."""
    n_docs = len(offs) - 1
    text = np.full(len(data) + n_docs + 1, 32, np.uint8)       # a guard before, between and after
    at = offs + np.arange(n_docs + 1)
    body = np.ones(len(text), bool)
    body[at] = False
    text[body] = _GUARDED[data]
    begins = np.flatnonzero((text[1:] != 32) & (text[:-1] == 32)) + 1
    size = np.diff(np.searchsorted(begins, at))
    keys, counts = [], []
    n_terms = max(1, len(block.terms))
    for got in _matches(automaton(block), text, piece) if block.terms else ():
        doc = np.searchsorted(at, got["end"]) - 1               # the guard after the last term is the next one's
        k, c = np.unique(doc * n_terms + got["term"], return_counts=True)
        keys.append(k)
        counts.append(c)
    if not keys:
        none = np.zeros(0, np.int64)
        return size, none, none, none
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    tf = np.bincount(back, np.concatenate(counts)).astype(np.int64)
    return size, key // n_terms, key % n_terms, tf


def _statistics(docs: DataFrame, shared) -> tuple[int, int, dict[int, int]]:
    """Documents with terms, all terms, and the document frequencies of the
    block's terms: one row per term leaves each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        df = np.zeros(len(block.terms), np.int64)
        n_docs = n_terms = 0
        for b in batches:
            for _, _, data, offs in tc.utf8_slices(b.column(1)):
                size, _, term, _ = scan(block, data, offs)
                n_docs += int((size > 0).sum())
                n_terms += int(size.sum())
                df += np.bincount(term, minlength=len(df))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-1, -2], seen])), pa.array(np.concatenate([[n_docs, n_terms], df[seen]]))], ["term", "n"])

    rows = docs.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()   # the block's terms
    df = {r["term"]: r["n"] for r in rows}
    return df.pop(-1, 0), df.pop(-2, 0), df


def _scores(block: Block, size: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray
            ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, item, score) of all scores above 0, some documents at a time."""
    if not len(doc):
        return
    m = 100 - 75 + 75 * size.astype(np.int64) * block.n_docs // block.n_terms
    part = block.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
    fan = block.first[term + 1] - block.first[term]
    n_items = len(block.items)
    reach = np.concatenate([[0], np.cumsum(fan)])
    first = np.searchsorted(doc, np.arange(len(size) + 1))      # of each document's postings
    lo = 0
    while lo < len(size):
        hi = min(len(size), lo + max(1, CELLS // n_items))
        while hi > lo + 1 and reach[first[hi]] - reach[first[lo]] > CELLS:
            hi = lo + (hi - lo) // 2
        p = np.arange(first[lo], first[hi])
        j = tc.ragged(block.first[term[p]], fan[p])
        cells = np.zeros((hi - lo) * n_items, np.int64)
        np.add.at(cells, np.repeat(doc[p] - lo, fan[p]) * n_items + block.item[j], np.repeat(part[p], fan[p]) * block.times[j])
        got = np.flatnonzero(cells)
        yield got // n_items + lo, got % n_items, cells[got]
        lo = hi


class _Best:
    """The best ``top`` documents of every item so far."""

    def __init__(self, n_items: int, top: int) -> None:
        self.top = top
        self.item = self.doc = self.score = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)                # documents without an id
        self.least = np.ones(n_items, np.int64)      # a score below cannot enter

    def add(self, item: np.ndarray, doc: np.ndarray, null: np.ndarray, score: np.ndarray) -> None:
        k = score >= self.least[item]
        item, doc, null, score = (np.concatenate([old, new[k]]) for old, new in
                                  ((self.item, item), (self.doc, doc), (self.null, null), (self.score, score)))
        order = np.lexsort((doc, null, -score, item))
        place = np.arange(len(item)) - np.searchsorted(item[order], item[order])
        self.least[item[order[place == self.top - 1]]] = score[order[place == self.top - 1]]
        order = order[place < self.top]
        self.item, self.doc, self.null, self.score = item[order], doc[order], null[order], score[order]


def _rank_block(docs: DataFrame, shared, top: int) -> DataFrame:
    """The best documents of the block's items of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = _Best(len(block.items), top)
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy()
            null = b.column(0).is_null().to_numpy(zero_copy_only=False)
            for lo, _, data, offs in tc.utf8_slices(b.column(1)):
                for doc, item, score in _scores(block, *scan(block, data, offs)):
                    best.add(item, ids[lo + doc], null[lo + doc], score)
        items = [block.items[k] for k in best.item.tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([None if i is None else str(i) for i in items], pa.string()),
             pa.array(best.doc, mask=best.null), pa.array(best.score)], ["item", "doc_id", "score"])

    return docs.mapInArrow(run, "item string, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", top: int = TOP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` documents."""
    spark = docs.sparkSession
    ship(spark)
    kind = items.schema[item].dataType
    terms = keep(item_terms(items, item, item_text), "item-terms")
    sizes = [(r["bucket"], r["count"]) for r in terms.groupBy("bucket").count().collect()]      # at most BUCKETS rows
    source = docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = spark.createDataFrame([], "item string, doc_id bigint, score bigint")
    for a, b in pack(sizes, block_rows):
        block = Block(terms.filter(F.col("bucket").between(a, b)).collect())                    # a block
        block.weigh(*_statistics(source, spark.sparkContext.broadcast(block)))
        if block.n_terms:
            found = found.unionByName(_rank_block(source, spark.sparkContext.broadcast(block), top))
    found = found.select(F.col("item").cast(kind).alias("item_id"), "doc_id", "score")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    some = found.withColumn("salt", salt).withColumn("place", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))) \
        .filter(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


_TERMS = (f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')")
# DuckDB twin: all terms of all documents as rows.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
it AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d)
       WHERE term IN (SELECT term FROM it) GROUP BY ALL),
wt AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
       FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
part AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS p
         FROM tf JOIN wt USING (term), s),
total AS (SELECT item_id, r, doc_id, sum(p * times)::BIGINT AS score FROM part JOIN it USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
           FROM total WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {TOP}
"""

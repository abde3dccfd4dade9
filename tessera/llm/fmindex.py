"""Operator 3, benchmark decontamination with an FM-index per training shard.

A shard is a slice of a task's documents. Its words become symbols of the
benchmark vocabulary; words outside it, and runs too short to hold any test
phrase, can be in no match and collapse to one separator, which loses nothing.
The shard's suffix array gives the Burrows-Wheeler transform, held as a wavelet
matrix. All test phrases are searched backward at once through its ranks;
occurrences are located by walking back to sampled suffix positions, and their
word ranges are merged into removal spans.

Test phrases are the windows of ``WINDOW`` words of each item (a shorter item is
one phrase). They are read in blocks of at most ``BLOCK_WORDS`` words, so what
is broadcast at once is bounded; every block is searched in every shard.

Defined cases: null texts and items have no words; items without a word match
nothing; an item without an id is listed as ``null``; items sharing an id count
once; repeated rows are judged each on its own; empty tables give no rows;
texts of any length are taken whole; clashing extra columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import textcols as tc
from tessera.llm.shipping import ship

WINDOW = 10
SAMPLE_EVERY = 8
BLOCK_WORDS = 1 << 20
SLICE_BYTES = 8 << 20


def suffix_array(sym: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; suffixes still tied are sorted again."""
    n = len(sym)
    _, rank = np.unique(sym, return_inverse=True)
    rank = rank.astype(np.int64)
    sa = np.argsort(rank, kind="stable")
    k = 1
    while n > 1:
        r = rank[sa]
        tied = np.zeros(n, bool)
        same = r[1:] == r[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        pos = sa[at]
        ahead = np.where(pos + k < n, rank[np.minimum(pos + k, n - 1)] + 1, 0)
        order = np.lexsort((ahead, r[at]))
        pos, group, ahead = pos[order], r[at][order], ahead[order]
        sa[at] = pos
        # a new rank is the group's rank plus the place where its subgroup begins
        new_group = np.ones(len(pos), bool)
        new_group[1:] = group[1:] != group[:-1]
        new_sub = new_group.copy()
        new_sub[1:] |= ahead[1:] != ahead[:-1]
        i = np.arange(len(pos))
        group_at = np.maximum.accumulate(np.where(new_group, i, 0))
        sub_at = np.maximum.accumulate(np.where(new_sub, i, 0))
        first = np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1])       # rows where ranks begin
        if k == 1:
            dense = np.empty(int(r[-1]) + 1, np.int64)
            dense[r[first]] = first
            rank = dense[rank]                                                   # rank = first row of the group
            group = dense[group]
        rank[pos] = group + sub_at - group_at
        k *= 2
    return sa


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit plane a level."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            c = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=c[1:])
            self.ones.append(c)
            self.zeros.append(len(seq) - int(c[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        lo, hi = np.zeros_like(at), at
        for j, c in enumerate(self.ones):
            one = ((symbol >> (self.levels - 1 - j)) & 1).astype(bool)
            lo = np.where(one, self.zeros[j] + c[lo], lo - c[lo])
            hi = np.where(one, self.zeros[j] + c[hi], hi - c[hi])
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """Symbol at each position."""
        out = np.zeros(len(at), np.int64)
        for j, c in enumerate(self.ones):
            one = c[at + 1] > c[at]
            out = out * 2 + one
            at = np.where(one, self.zeros[j] + c[at], at - c[at])
        return out


class FmIndex:
    """Index of a sequence over 1..n_words with 0 as a separator; the last
    symbol must be a separator. Each separator is a symbol of its own in the
    suffix order, so equal runs differ at their ends."""

    def __init__(self, seq: np.ndarray, n_words: int):
        n = len(seq)
        sep = np.flatnonzero(seq == 0)
        wide = seq.astype(np.int64) + len(sep)
        wide[sep] = np.arange(len(sep))
        self.sa = suffix_array(wide)
        bwt = seq[self.sa - 1]                   # row of position 0 takes the last separator
        self.tree = WaveletMatrix(bwt, n_words + 1)
        self.before = np.concatenate([[0, len(sep)], len(sep) + np.cumsum(np.bincount(seq, minlength=n_words + 1)[1:])])
        start = np.ones(n, bool)                 # runs begin after separators: sampled, so no walk crosses one
        start[1:] = seq[:-1] == 0
        sampled = start | (np.arange(n) % SAMPLE_EVERY == 0)
        self.mark = sampled[self.sa]
        self.sample = self.sa[self.mark]         # positions of the marked rows, in row order
        self.marks = np.concatenate([[0], np.cumsum(self.mark)])
        self.n = n
        del self.sa

    def search(self, phrases: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the phrases (rows of ``phrases``, left aligned)."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            go = np.flatnonzero((lens >= back) & (hi > lo))
            if not len(go):
                break
            c = phrases[go, lens[go] - back].astype(np.int64)
            both = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo[go], hi[go]]))
            lo[go], hi[go] = self.before[c] + both[:len(go)], self.before[c] + both[len(go):]
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: walk back to a sampled one."""
        out = np.zeros(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            hit = self.mark[at]
            out[todo[hit]] = self.sample[self.marks[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                c = self.tree.access(at)
                at = self.before[c] + self.tree.rank(c, at)
                steps += 1
        return out


class Phrases:
    """A block of benchmark items: vocabulary, distinct phrases and the items of each."""

    def __init__(self, items: list[tuple[str, str]]):
        """``items``: (id as string, text)."""
        raw = [tc.LOWER[np.frombuffer(t.encode("utf-8"), np.uint8)] for _, t in items]
        offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        data = np.concatenate(raw) if raw else np.zeros(0, np.uint8)
        ws, we, wo = tc.split_words(data, offs, tc.NOT_ALNUM)
        self.vocab, word = np.unique(tc.hash_spans(data, ws, we), return_inverse=True)
        self.names = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.names)}
        seen: dict[tuple[int, ...], set[int]] = {}
        for k, (ident, _) in enumerate(items):
            w = (word[wo[k]:wo[k + 1]] + 1).tolist()
            for j in range(max(1, len(w) - WINDOW + 1) if w else 0):
                seen.setdefault(tuple(w[j:j + WINDOW]), set()).add(number[ident])
        keys = list(seen)
        self.lens = np.array([len(k) for k in keys], np.int64)
        self.words = np.zeros((len(keys), WINDOW), np.int32)
        for r, k in enumerate(keys):
            self.words[r, :len(k)] = k
        owners = [sorted(seen[k]) for k in keys]
        self.owner_offs = np.concatenate([[0], np.cumsum([len(o) for o in owners])]).astype(np.int64)
        self.owners = np.array([x for o in owners for x in o], np.int64)
        self.shortest = int(self.lens.min()) if len(keys) else 0


def search_slice(data: np.ndarray, offs: np.ndarray, block: Phrases
                 ) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Words of the slice, True for each hit word, and the distinct (document,
    item number) pairs found."""
    low = tc.LOWER[data]
    ws, we, wo = tc.split_words(low, offs, tc.NOT_ALNUM)
    hit = np.zeros(len(ws), bool)
    none = np.zeros(0, np.int64)
    if not block.shortest or not len(ws):
        return (ws, we, wo), hit, none, none
    h = tc.hash_spans(low, ws, we)
    sym = np.searchsorted(block.vocab, h)
    sym[sym == len(block.vocab)] = 0
    sym = np.where(block.vocab[sym] == h, sym + 1, 0)
    # runs of vocabulary words inside a document, long enough for a phrase
    known = sym > 0
    first = known.copy()
    first[1:] &= ~known[:-1]
    cut = wo[1:-1][wo[1:-1] < len(ws)]
    first[cut] |= known[cut]
    begin = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    length = np.bincount(run[known], minlength=len(begin))
    keep = length >= block.shortest
    begin, length = begin[keep], length[keep]
    if not len(begin):
        return (ws, we, wo), hit, none, none
    word = tc.ragged(begin, length)                       # slice word of each symbol
    seq = np.insert(sym[word], np.cumsum(length), 0)      # a separator ends each run
    place = np.insert(word, np.cumsum(length), -1)
    index = FmIndex(seq, len(block.vocab))
    lo, hi = index.search(block.words, block.lens)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return (ws, we, wo), hit, none, none
    n = hi[found] - lo[found]
    at = place[index.locate(tc.ragged(lo[found], n))]
    phrase = np.repeat(found, n)
    edge = np.zeros(len(ws) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.subtract.at(edge, at + block.lens[phrase], 1)
    hit = np.cumsum(edge[:-1]) > 0
    doc = np.searchsorted(wo, at, "right") - 1
    n_own = np.diff(block.owner_offs)[phrase]
    item = block.owners[tc.ragged(block.owner_offs[phrase], n_own)]
    pair = np.unique(np.repeat(doc, n_own) * len(block.names) + item)
    return (ws, we, wo), hit, pair // len(block.names), pair % len(block.names)


def phrase_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text",
                  block_words: int = BLOCK_WORDS) -> list:
    """Broadcast blocks of the benchmark, read one block at a time."""
    sc = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")), F.coalesce(text, F.lit("")))
    out, items, size = [], [], 0
    for ident, t in rows.toLocalIterator():
        items.append((ident, t))
        size += 1 + len(t) // 2
        if size >= block_words:
            out.append(sc.broadcast(Phrases(items)))
            items, size = [], 0
    if items or not out:
        out.append(sc.broadcast(Phrases(items)))
    return out


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
RESULT = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", SPANS), ("items", pa.list_(pa.string()))])
_DDL = ("bigint", "bigint", "array<struct<first:bigint,last:bigint>>", "array<string>")


def _scan(text: pa.Array, blocks: list) -> list[pa.Array]:
    """The RESULT columns of a text column."""
    n_words, n_hit, span_n, first, last, items = [], [], [], [], [], []
    for _, _, data, offs in tc.utf8_slices(text, SLICE_BYTES):
        docs = len(offs) - 1
        hit, names = None, [set() for _ in range(docs)]
        for b in blocks:
            (ws, _, wo), h, doc, item = search_slice(data, offs, b.value)
            hit = h if hit is None else hit | h
            for d, i in zip(doc.tolist(), item.tolist()):
                names[d].add(b.value.names[i])
        n_words.append(np.diff(wo))
        n_hit.append(tc.span_sums(hit, wo))
        base = np.repeat(wo[:-1], np.diff(wo))
        start, stop = hit.copy(), hit.copy()
        if len(ws):
            start[1:] &= ~hit[:-1]
            stop[:-1] &= ~hit[1:]
            cut = wo[1:-1][(wo[1:-1] > 0) & (wo[1:-1] < len(ws))]
            start[cut] |= hit[cut]
            stop[cut - 1] |= hit[cut - 1]
        s, e = np.flatnonzero(start), np.flatnonzero(stop)
        first.append(s - base[s])
        last.append(e - base[e])
        span_n.append(np.diff(np.searchsorted(s, wo)))
        items += [sorted(x) for x in names]
    cat = (lambda x: np.concatenate(x) if x else np.zeros(0, np.int64))
    spans = pa.StructArray.from_arrays([pa.array(cat(first), pa.int64()), pa.array(cat(last), pa.int64())],
                                       fields=list(SPANS.value_type))
    offs = np.concatenate([[0], np.cumsum(cat(span_n))]).astype(np.int32)
    return [pa.array(cat(n_words), pa.int64()), pa.array(cat(n_hit), pa.int64()),
            pa.ListArray.from_arrays(pa.array(offs), spans).cast(SPANS), pa.array(items, pa.list_(pa.string()))]


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, the merged hit spans (word numbers from 0,
    both ends included) and the sorted ids of the items found."""
    ship(docs.sparkSession)
    blocks = phrase_blocks(benchmark)
    base = docs.select(*[c for c in docs.columns if c not in RESULT.names or c == text])
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *_scan(b.column(names.index(text)), blocks)],
                                             [*names, *RESULT.names])

    schema = base.select(*names, *[F.lit(None).cast(d).alias(n) for n, d in zip(RESULT.names, _DDL)]).schema
    return base.mapInArrow(run, schema)


def _cut(texts: list[str], blocks: list) -> tuple[list[str], list[bool]]:
    """Texts without their hit spans (a newline stands for each), again until
    none is left, and whether words remain."""
    texts, todo, words = list(texts), list(range(len(texts))), [True] * len(texts)
    while todo:
        more = []
        for lo, _, data, offs in tc.utf8_slices(pa.array([texts[i] for i in todo], pa.string()), SLICE_BYTES):
            hit = None
            for b in blocks:
                (ws, we, wo), h, _, _ = search_slice(data, offs, b.value)
                hit = h if hit is None else hit | h
            for d in np.flatnonzero(tc.span_sums(hit, wo)):
                w = np.arange(wo[d], wo[d + 1])[hit[wo[d]:wo[d + 1]]]
                at, out = int(offs[d]), []
                for run in np.split(w, np.flatnonzero(np.diff(w) > 1) + 1):
                    out.append(data[at:ws[run[0]]].tobytes())
                    at = int(we[run[-1]])
                out.append(data[at:offs[d + 1]].tobytes())
                texts[todo[lo + d]] = b"\n".join(out).decode("utf-8")
                words[todo[lo + d]] = len(w) < wo[d + 1] - wo[d]
                more.append(todo[lo + d])
        todo = [i for i in more if words[i]]
    return texts, words


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Pipeline form: ``docs`` without the spans; a document that was nothing
    but benchmark text goes, one that was never hit stays as it is."""
    ship(docs.sparkSession)
    blocks = phrase_blocks(benchmark)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(names.index(text))
            texts, words = _cut([t or "" for t in col.to_pylist()], blocks)
            new = pc.if_else(pc.is_valid(col), pa.array(texts, pa.string()), pa.scalar(None, pa.string()))
            out = pa.RecordBatch.from_arrays([new if n == text else b.column(i) for i, n in enumerate(names)], names)
            yield out.filter(pa.array(words))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return out


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find(docs.select("doc_id", "text"), benchmark).drop("text")
    joined: Column = F.array_join("items", ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
it AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_WORDS} AS w FROM benchmark),
ph AS (SELECT DISTINCT item, list_slice(w, i, i + least({WINDOW}, len(w)) - 1) AS g
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM it WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS k FROM ph),
dw AS (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS g FROM (
         SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
occ AS (SELECT doc_id, i, k, item FROM dw JOIN ph USING (g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM occ GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

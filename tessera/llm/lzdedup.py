"""Operator 8, substring dedup by relative Lempel-Ziv parsing.

Documents are parsed against reference blocks. A block is one shuffle partition
of an index over the whole corpus: every 20-word window is filed under its
anchor (the smallest hash among its 10-word runs, leftmost on ties), so equal
windows meet in the block that holds their anchor and a document needs to be
parsed only against the blocks that can match it. Inside a block the pieces of
each anchor are read in corpus order (document, start) and factored greedily
against the pieces indexed before them: a factor is a maximal run of windows
known already, 20 words or longer; where it ends, the windows across the
boundary are looked up one by one. Windows in factors are duplicates, all others
are first occurrences and enter the index. The spans of all blocks are brought
together per document and their words removed.

Scale: a task first drops what repeats inside its own slice of documents (the
map-side combine that keeps copies from meeting in one block by the thousands).
Anchors that many slices see often are split: their windows are filed under
their own hash. Blocks are read as sorted streams; only one anchor's index is
held at a time. No broadcast but the split anchors, of which there are at most
``SPLIT_SHARE``.

Window equality is equality of 64 hash bits (inside a slice those of the window, in a
block a mix of its anchor's and of 32 of its own).
Defined cases: a null text has no words; ids are whole numbers of at most 64 bits; rows that share a doc_id but not the
text are told apart and none of their windows is earlier by doc_id; a null
doc_id stands after all others, with 2^63 - 1; equal rows get equal results; texts of any
length are taken whole; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textcols as tc
from tessera.llm.counts import keep
from tessera.llm.shipping import ship

WINDOW = 20
GRAM = 10
SLICE_BYTES = 6 << 20
SPLIT_SHARE = 100_000      # an anchor with over 1/SPLIT_SHARE of all pieces is split
SPLIT_LEAST = 10_000       # and at least so many pieces
LAST = np.int64(2**63 - 1)  # where a null doc_id stands
PIECES = "k bigint, d bigint, v bigint, pos int, n int, ext binary"


def anchors(h: np.ndarray, wo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash and anchor hash of each window of a slice's words."""
    win = tc.windows(h, WINDOW)
    if not len(win):
        return np.zeros(0, np.int64), win, win
    ok = np.flatnonzero(tc.window_ok(wo, len(h), WINDOW))
    gram = tc.mix64(tc.windows(h, GRAM))
    n = len(win)
    best = gram[:n].copy()
    for j in range(1, WINDOW - GRAM + 1):
        np.minimum(best, gram[j:j + n], out=best)
    return ok, win[ok], best[ok]


def _slice(b: pa.RecordBatch, lo: int, hi: int, data: np.ndarray, offs: np.ndarray):
    """Pieces of one slice of (d, v, text), documents in order: anchor, document
    row, first start, number of windows, window bits, and the local repeats."""
    ws, we, wo = tc.split_words(data, offs)
    start, win, anchor = anchors(tc.hash_spans(data, ws, we), wo)
    if not len(start):
        return None
    doc = np.searchsorted(wo, start, "right") - 1
    d = np.asarray(b.column(0).slice(lo, hi - lo))
    v = np.asarray(b.column(1).slice(lo, hi - lo))
    pos = start - wo[doc]
    order = np.lexsort((pos, v[doc], d[doc]))
    order = order if np.any(order[1:] < order[:-1]) else slice(None)
    win, anchor, doc, pos = win[order], anchor[order], doc[order], pos[order]
    seen = pd.Series(win).duplicated().to_numpy()
    if len(np.unique(d)) < len(d):       # repeats at the same place of one doc_id are no earlier ones
        first = pd.DataFrame({"w": win, "d": d[doc], "p": pos}).groupby("w")[["d", "p"]].transform("first")
        seen &= ~((first["d"].to_numpy() == d[doc]) & (first["p"].to_numpy() == pos))
    return d, v, doc, pos, win, anchor, seen


def _runs(doc: np.ndarray, pos: np.ndarray, key: np.ndarray | None = None) -> np.ndarray:
    """Where runs of consecutive starts (with one key) begin."""
    new = np.ones(len(doc), bool)
    if len(doc):
        new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
        if key is not None:
            new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _batch(k, d, v, pos, n, ext: bytes, offs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(k.view(np.int64)), pa.array(d), pa.array(v), pa.array(pos.astype(np.int32)),
        pa.array(n.astype(np.int32)),
        pa.BinaryArray.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(ext)]),
    ], ["k", "d", "v", "pos", "n", "ext"])


def duplicate_spans(docs: DataFrame, versions: bool = True) -> DataFrame:
    """(d, v, starts, counts): per document of ``docs`` (d, v, text) the runs of
    window starts whose window occurs earlier in the corpus. ``versions``: a d
    may have several v."""
    spark = docs.sparkSession
    ship(spark)

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in tc.utf8_slices(b.column(2), SLICE_BYTES):
                got = _slice(b, lo, hi, data, offs)
                if got is None:
                    continue
                _, _, doc, pos, _, anchor, seen = got
                keep = ~seen
                at = _runs(doc[keep], pos[keep], anchor[keep])
                k, n = np.unique(anchor[keep][at], return_counts=True)
                often = n > 2            # a split anchor's share is over that of a piece in some slice
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.append(k[often].view(np.int64), 0)), pa.array(np.append(n[often], len(at))),
                    pa.array(np.append(np.zeros(often.sum(), bool), True))], ["k", "n", "total"])

    often = keep(docs.mapInArrow(heavy, "k bigint, n bigint, total boolean").groupBy("total", "k")
                 .agg(F.sum("n").alias("n")).filter(F.col("total") | (F.col("n") >= SPLIT_LEAST)), "anchors")
    total = often.filter("total").agg(F.sum("n")).first()[0] or 0
    rows = [r["k"] for r in often.filter(~F.col("total") & (F.col("n") > total // SPLIT_SHARE)).select("k").collect()]
    split = spark.sparkContext.broadcast(np.sort(np.array(rows, np.int64).view(tc.U64)))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = split.value
        for b in batches:
            for lo, hi, data, offs in tc.utf8_slices(b.column(2), SLICE_BYTES):
                got = _slice(b, lo, hi, data, offs)
                if got is None:
                    continue
                d, v, doc, pos, win, anchor, seen = got
                bits = (win >> tc.U64(32)).astype("<u4")
                r = np.flatnonzero(seen)                 # known to be repeats: only the span travels
                at = _runs(doc[r], pos[r])
                n = np.diff(np.append(at, len(r)))
                i = r[at]
                key = tc.mix64(d[doc[i]].astype(tc.U64))
                yield _batch(key, d[doc[i]], v[doc[i]], pos[i], n, b"", np.zeros(len(i) + 1, np.int64))
                f = np.flatnonzero(~seen)
                k = anchor[f]
                own = np.isin(k, hot) if len(hot) else np.zeros(len(f), bool)
                k = np.where(own, tc.mix64(win[f] + tc.U64(1)), k)
                at = _runs(doc[f], pos[f], k)
                n = np.diff(np.append(at, len(f)))
                i = f[at]
                yield _batch(k[at], d[doc[i]], v[doc[i]], pos[i], n, bits[f].tobytes(),
                             4 * np.append(at, len(f)))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pd.DataFrame({"k": np.zeros(0, np.int64), "e": np.zeros(0, np.uint32), "d": np.zeros(0, np.int64),
                             "p": np.zeros(0, np.int64)})      # index of the last anchor, may go on in the next batch
        for b in batches:
            k, d, v, pos, n = (np.asarray(b.column(j)) for j in range(5))
            col = b.column(5)
            bounds = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(b) + 1].astype(np.int64)
            raw = np.frombuffer(col.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
            ext = np.frombuffer(raw.tobytes(), "<u4")
            own = (bounds[1:] - bounds[:-1]) // 4
            row = np.repeat(np.arange(len(b)), own)
            place = pos[row].astype(np.int64) + tc.ragged(np.zeros(len(b), np.int64), own)
            w = pd.DataFrame({"k": k[row], "e": ext, "d": d[row], "p": place})
            both = pd.concat([held, w], ignore_index=True)
            same = tc.mix64(both["k"].to_numpy().view(tc.U64)) ^ (both["e"].to_numpy().astype(tc.U64) * tc.U64(0x9E3779B97F4A7C15))
            again = pd.Series(same).duplicated().to_numpy()
            seen = again[len(held):].copy()
            if versions and seen.any():               # the same place of one doc_id is no earlier occurrence
                first = both.groupby(["k", "e"], sort=False)[["d", "p"]].transform("first").iloc[len(held):]
                seen &= ~((first["d"].to_numpy() == w["d"].to_numpy()) & (first["p"].to_numpy() == place))
            last = both["k"].to_numpy() == (k[-1] if len(k) else 0)
            held = both[last & ~again]
            r = np.flatnonzero(seen)
            at = _runs(row[r], place[r])                 # greedy factors: maximal runs of known windows
            i = r[at]
            pre = np.flatnonzero(own == 0)               # spans found in the slices
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([d[row[i]], d[pre]])), pa.array(np.concatenate([v[row[i]], v[pre]])),
                pa.array(np.concatenate([place[i].astype(np.int32), pos[pre]])),
                pa.array(np.concatenate([np.diff(np.append(at, len(r))).astype(np.int32), n[pre]]))],
                ["d", "v", "pos", "n"])

    blocks = docs.mapInArrow(pieces, PIECES).repartition("k").sortWithinPartitions("k", "d", "pos")
    spans = blocks.mapInArrow(parse, "d bigint, v bigint, pos int, n int")
    return spans.groupBy("d", "v").agg(F.collect_list("pos").alias("starts"), F.collect_list("n").alias("counts"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_words, n_removed, kept): ``kept`` is the words that
    stay, joined by one space."""
    spark = docs.sparkSession
    ship(spark)
    place = F.coalesce(F.col(key).cast("bigint"), F.lit(int(LAST)))
    twice = docs.groupBy(place).count().filter("count > 1").limit(1).count() > 0
    # rows with one doc_id are told apart by their text, only where there are such rows
    version = F.xxhash64(F.coalesce(F.col(text), F.lit(""))) if twice else F.lit(0).cast("bigint")
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    keyed = docs.select(place.alias("d"), version.alias("v"), F.col(text).alias("text"),
                        F.col(key).isNull().alias("null_id"))
    placed = keyed.select("d", "v", "text")
    if twice:
        found = duplicate_spans(placed.dropDuplicates(["d", "v"]))
    else:
        found = duplicate_spans(placed, versions=False)
    joined = keyed.join(found, ["d", "v"], "left") \
        .select(F.when(~F.col("null_id"), F.col("d")).cast(base.schema["doc_id"].dataType).alias("doc_id"),
                "text", "starts", "counts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in tc.utf8_slices(b.column(1), SLICE_BYTES):
                ws, we, wo = tc.split_words(data, offs)
                edge = np.zeros(len(ws) + 1, np.int64)
                for d, (s, n) in enumerate(zip(b.column(2).slice(lo, hi - lo), b.column(3).slice(lo, hi - lo))):
                    if s.is_valid:
                        s, n = np.asarray(s.values), np.asarray(n.values)
                        np.add.at(edge, wo[d] + s, 1)
                        np.subtract.at(edge, wo[d] + s + n + (WINDOW - 1), 1)
                gone = np.cumsum(edge[:-1]) > 0
                stay = np.flatnonzero(~gone)
                kept = tc.gather_text(data, ws[stay], we[stay], np.searchsorted(stay, wo), b" ")
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(np.diff(wo), pa.int64()),
                    pa.array(tc.span_sums(gone, wo), pa.int64()), pa.array(kept, pa.string())],
                    ["doc_id", "text", "n_words", "n_removed", "kept"])

    schema = base.select("*", F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_removed"),
                         F.lit("").alias("kept")).schema
    return joined.mapInArrow(cut, schema)


def digests(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + {WINDOW - 1}) AS g FROM (
          SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
dup AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM (
          SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT doc_id, list(p) AS ps FROM dup GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(coalesce(ps, []))::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(ps, []), i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

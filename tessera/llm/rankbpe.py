"""Operator 12, byte-level BPE by ranks in length-bucketed padded matrices.

A slice of texts is cut into pieces (contractions, words and numbers with a
leading space, signs, white space), and its distinct pieces are put into padded
numpy matrices, one row a piece, pieces of like length together. In each round
every row merges its leftmost pair of minimum rank: pair ranks come from a hashed
table of all pairs of tokens whose bytes together are a token, the merged row
closes the gap (so the matrix gets a column narrower each round), and rows with
nothing left to merge leave the matrix. A merged pair's id is its rank. Tokens
that merging cannot reach are known from the file and taken whole, as the library
does. Pieces of more than ``MAX_ROW`` bytes, whose rounds would take quadratic
time, are merged by the same rule with a heap.

One pass, no shuffle; memory is bounded by a slice of ``SLICE_BYTES`` (one text
alone if it is longer).

Defined cases: a null text is an empty one (no ids, empty decoding). Empty tables
give no rows, repeated rows are encoded each on its own, texts are taken whole,
and extra columns with the name of a result column are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textcols as tc
from tessera.llm.bpe import code_points
from tessera.llm.shipping import ship

SLICE_BYTES = 3 << 20
MAX_ROW = 128                 # bytes of a piece that stands in a matrix
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32, 48, 64, 96, MAX_ROW)
CELLS = 1 << 21               # of one matrix
NEVER = np.int32(2**31 - 1)   # rank of a pair that does not merge
_BITS = 21                    # hash table of pairs: 2^21 slots
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)

OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
# What may follow an apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point, asked of the tiktoken library, so that its
    Unicode version holds."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(probe.encode_ordinary(every)).decode()      # only what the pattern matches
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = value
    return out


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pieces of each text, and per text the index
    of its first piece."""
    at, cp = code_points(data)
    n = len(cp)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    text = np.searchsorted(at, offs)                 # first character of each text, and n
    begins = np.zeros(n + 1, bool)                   # a text begins here
    begins[text] = True
    cls = _classes()[cp]
    cut = begins.copy()
    cut[1:n] |= cls[1:] != cls[:-1]
    # the last blank before something else stands alone, a space goes with what follows
    last = np.flatnonzero((cls[:-1] == BLANK) & (cls[1:] != BLANK) & ~begins[1:n])
    cut[last] = True
    cut[last[cp[last] == 32] + 1] = False
    # an apostrophe that starts a piece, right before letters
    mark = np.flatnonzero((cp[:-1] == 39) & (cls[1:] == LETTER) & cut[:n - 1] & ~begins[1:n])
    if len(mark):
        letter = [np.where((mark + k < n) & ~begins[np.minimum(mark + k, n)], cp[np.minimum(mark + k, n - 1)], 0) for k in (1, 2)]
        taken = np.zeros(len(mark), np.int64)
        for c in CONTRACTIONS:
            hit = letter[0] == ord(c[0])
            if len(c) == 2:
                hit &= letter[1] == ord(c[1])
            taken[hit & (taken == 0)] = len(c)
        mark, taken = mark[taken > 0], taken[taken > 0]
        cut[mark + 1] = False
        cut[mark + 1 + taken] = True
    first = np.flatnonzero(cut[:n])
    edge = np.append(at, len(data))
    return at[first], edge[np.append(first[1:], n)], np.searchsorted(first, text)


class RankBpe:
    """One rank file."""

    def __init__(self, path: str):
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.size = 1 + max(ranks.values())
        tokens = [b""] * self.size
        for t, r in ranks.items():
            tokens[r] = t
        self.token_lens = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.cumsum(self.token_lens) - self.token_lens
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs: dict[int, int] = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    self.pairs[a * self.size + b] = r
        self._fill(np.array(list(self.pairs), np.int64), np.array(list(self.pairs.values()), np.int32))
        # tokens that their own bytes do not merge to
        self.whole: dict[bytes, int] = {}
        known = [t for t in tokens if t]
        ends = np.cumsum([len(t) for t in known])
        ids, at = self.merge(np.frombuffer(b"".join(known), np.uint8), ends - [len(t) for t in known], ends)
        for k, t in enumerate(known):
            if at[k + 1] - at[k] != 1:
                self.whole[t] = ranks[t]
        self.whole_lens = np.array(sorted({len(t) for t in self.whole}), np.int64)

    # -- pair ranks ----------------------------------------------------------

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * _MULTIPLIER >> np.uint64(64 - _BITS)).view(np.int64)

    def _fill(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing: a key lies in its slot or in the next free one."""
        self.slot_key = np.full((1 << _BITS) + 1, -1, np.int64)
        self.slot_rank = np.full((1 << _BITS) + 1, NEVER, np.int32)
        slot, rest = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(rest):
            self.probes += 1
            s = slot[rest]
            free = self.slot_key[s] < 0
            self.slot_key[s[free]] = keys[rest[free]]             # of rivals, the last written stays
            in_place = self.slot_key[s] == keys[rest]
            self.slot_rank[s[in_place]] = ranks[rest[in_place]]
            rest = rest[~in_place]
            slot[rest] = (slot[rest] + 1) & ((1 << _BITS) - 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NEVER where it does not merge or one of
        them is padding."""
        key = left.astype(np.int64) * self.size + right
        slot = self._slot(key)
        found = self.slot_key[slot]
        out = np.where(found == key, self.slot_rank[slot], NEVER)
        missed = np.flatnonzero((found != key) & (found >= 0))
        while len(missed):                                        # ends at a free slot
            slot[missed] = (slot[missed] + 1) & ((1 << _BITS) - 1)
            found = self.slot_key[slot[missed]]
            hit = found == key[missed]
            out[missed[hit]] = self.slot_rank[slot[missed[hit]]]
            missed = missed[~hit & (found >= 0)]
        out[(left < 0) | (right < 0)] = NEVER
        return out

    # -- merges --------------------------------------------------------------

    def _merge_rows(self, ids: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merge a padded matrix; yields (row numbers, rows of ids, their sizes)
        as rows get done."""
        row = np.arange(len(ids))
        rank = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(row):
            if ids.shape[1] == 1:
                yield row, ids, size
                return
            best_at = rank.argmin(1)                              # the leftmost of the minimum
            best = rank[np.arange(len(row)), best_at]
            done = best == NEVER
            if done.any():                                        # rows that are done leave
                yield row[done], ids[done], size[done]
                go = ~done
                row, ids, size, rank, best_at, best = row[go], ids[go], size[go], rank[go], best_at[go], best[go]
                if not len(row):
                    return
            n, width = ids.shape
            every = np.arange(n)
            ids[every, best_at] = best
            gap = np.arange(width) != (best_at + 1)[:, None]
            ids = ids[gap].reshape(n, width - 1)                  # close the gap
            gap = np.arange(width - 1) != best_at[:, None]
            rank = rank[gap].reshape(n, width - 2)
            size = size - 1
            left = np.flatnonzero(best_at > 0)
            if len(left):
                p = best_at[left]
                rank[left, p - 1] = self.rank(ids[left, p - 1], ids[left, p])
            right = np.flatnonzero(best_at < width - 2)
            if len(right):
                p = best_at[right]
                rank[right, p] = self.rank(ids[right, p], ids[right, p + 1])

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same rule for one long piece: a heap of pairs over linked ids."""
        ids = self.of_byte[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(i: int) -> tuple[int, int, int, int] | None:
            j = after[i]
            r = self.pairs.get(ids[i] * self.size + ids[j]) if j < n else None
            return None if r is None else (r, i, ids[i], ids[j])

        heap = [p for p in map(pair, range(n)) if p is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue                                          # one of them has merged since
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                p = pair(k) if k >= 0 else None
                if p is not None:
                    heapq.heappush(heap, p)
        return [t for t in ids if t >= 0]

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the pieces, and their offsets."""
        lens = ends - starts
        count = np.zeros(len(lens), np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []      # piece, its first ids, number of ids
        low = 0
        for width in WIDTHS:
            group = np.flatnonzero((lens > low) & (lens <= width))
            low = width
            for g in np.array_split(group, -(-len(group) * width // CELLS)) if len(group) else []:
                ids = np.full((len(g), int(lens[g].max())), -1, np.int32)
                inside = np.arange(ids.shape[1]) < lens[g][:, None]
                ids[inside] = self.of_byte[data[tc.ragged(starts[g], lens[g])]]
                for row, rows, size in self._merge_rows(ids, lens[g]):
                    done.append((g[row], rows[np.arange(rows.shape[1]) < size[:, None]], size))
        for g in np.flatnonzero(lens > MAX_ROW).tolist():
            ids = self._merge_long(data[starts[g]:ends[g]].tobytes())
            done.append((np.array([g]), np.array(ids, np.int32), np.array([len(ids)])))
        for g, _, size in done:
            count[g] = size
        at = np.concatenate([[0], np.cumsum(count)])
        flat = np.empty(at[-1], np.int32)
        for g, ids, size in done:
            flat[tc.ragged(at[g], size)] = ids
        return flat, at

    # -- texts ---------------------------------------------------------------

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts of a slice, and their offsets."""
        starts, ends, first = pieces(data, offs)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        rep, use = tc.distinct(tc.hash_spans(data, starts, ends))
        s, e = starts[rep], ends[rep]
        flat, at = self.merge(data, s, e)
        begin, size = at[:-1].copy(), np.diff(at)
        if self.whole:
            extra = []
            for k in np.flatnonzero(np.isin(e - s, self.whole_lens) & (size > 1)).tolist():
                r = self.whole.get(data[s[k]:e[k]].tobytes())
                if r is not None:
                    begin[k], size[k] = len(flat) + len(extra), 1
                    extra.append(r)
            flat = np.append(flat, np.array(extra, np.int32))
        used = size[use]
        return flat[tc.ragged(begin[use], used)], np.concatenate([[0], np.cumsum(used)])[first]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the tokens of each id list, and their offsets."""
        lens = self.token_lens[ids]
        return self.token_bytes[tc.ragged(self.token_starts[ids], lens)], np.concatenate([[0], np.cumsum(lens)])[offs]


@lru_cache(maxsize=4)
def load(path: str) -> RankBpe:
    """The tokenizer of a file, read once per worker."""
    return RankBpe(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of the whole text in array column ``ids``."""
    ship(docs.sparkSession)
    base = docs.select(*[c for c in docs.columns if c != ids])
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)
        for b in batches:
            for lo, hi, data, offs in tc.utf8_slices(b.column(names.index(text)), SLICE_BYTES):
                flat, at = tok.encode(data, offs)
                col = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, col], [*names, ids])

    return base.mapInArrow(run, base.withColumn(ids, F.lit(None).cast("array<int>")).schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of each id list in binary column
    ``decoded`` (null for a null list)."""
    ship(encoded.sparkSession)
    base = encoded.select(*[c for c in encoded.columns if c != decoded])
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)
        for b in batches:
            col = b.column(names.index(ids))
            lens = col.value_lengths().fill_null(0).to_numpy()
            offs = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
            raw, at = tok.decode(col.flatten().to_numpy(), offs)
            raw, at = raw.tobytes(), at.tolist()
            out = [raw[x:y] if v else None for x, y, v in zip(at[:-1], at[1:], col.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*names, decoded])

    return base.mapInArrow(run, base.withColumn(decoded, F.lit(None).cast("binary")).schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, and its
    ids decoded, in one pass."""
    ship(docs.sparkSession)
    base = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)
        for b in batches:
            for lo, hi, data, offs in tc.utf8_slices(b.column(1), SLICE_BYTES):
                flat, at = tok.encode(data, offs)
                raw, end = tok.decode(flat, at)
                little = memoryview(flat.astype("<u4").tobytes())
                raw = memoryview(raw.tobytes())
                cols = [b.column(0).slice(lo, hi - lo), pa.array(np.diff(at)),
                        pa.array([hashlib.sha256(little[4 * x:4 * y]).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist())]),
                        pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(end[:-1].tolist(), end[1:].tolist())])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = base.select("doc_id", F.lit(0).cast("bigint").alias("n_tokens"),
                         F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema
    return base.mapInArrow(run, schema)

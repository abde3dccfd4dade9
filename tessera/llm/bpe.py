"""Byte-level BPE over Arrow text columns, exact and vectorised.

A slice of texts is cut into pre-tokens over code-point classes, the distinct
pre-tokens are found by hash, each is encoded once (lexicon, else merges of all
words side by side), and the ids are gathered back per document. Two kinds of
tokenizer file are read: plain byte-level (a leading space belongs to its word)
and word-ended (lower case, white space dropped, ``</w>`` after each word).
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Regex, Tokenizer, pre_tokenizers

from tessera.llm import textcols as tc

NONE = np.int32(2**31 - 1)
MAX_VECTOR_WORD = 64     # bytes; longer pre-tokens are merged one by one with a heap
LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
_SLOT_BITS = 18
_SLOTS = 1 << _SLOT_BITS   # of the pair table: four times a 50k merge list and more
_SHORT, _LONG = "stmd", ("re", "ve", "ll")   # contractions after an apostrophe


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point (letter, number, white space, other), asked of
    the tokenizers library, so that its Unicode version holds."""
    cls = np.full(0x110000, OTHER, np.uint8)
    points = np.r_[0:0xD800, 0xE000:0x110000]
    split = [(pre_tokenizers.Split(Regex(pattern), "removed", invert=True), value)
             for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", SPACE))]
    for part in np.array_split(points, 64):
        every = "".join(map(chr, part))
        for splitter, value in split:
            for _, (lo, hi) in splitter.pre_tokenize_str(every):
                cls[part[lo:hi]] = value
    return cls


@lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """Printable character that stands for each byte: itself when printable,
    otherwise the next unused code point from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each character, and its code point."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    cp = data[at].astype(np.int32)
    for lead, mask, extra in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        hit = np.flatnonzero((cp >= lead) & (cp < (0xE0, 0xF0, 0xF8)[extra - 1]) & (data[at] == cp))
        if len(hit):
            v = cp[hit] & mask
            for j in range(1, extra + 1):
                v = (v << 6) | (data[at[hit] + j] & 0x3F)
            cp[hit] = v
    return at, cp


# Characters whose case and composition Python and the tokenizers library may
# know from different Unicode versions; texts with one take the library's way.
_NEWER = re.compile("[^\\x00-\u052f\u2010-\u2027\u20ac]")


class Bpe:
    """One tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.word_ended = bool(self.suffix)
        # the file's normalizer, without a second copy of its vocabulary
        bare = spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}
        self.normalizer = Tokenizer.from_str(json.dumps(bare)).normalizer if self.word_ended else None
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.specials.values()])
        self.tokens = [""] * self.size
        for t, i in (vocab | self.specials).items():
            self.tokens[i] = t
        self._special_re = re.compile("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True))) \
            if self.specials else None
        letters = byte_alphabet()
        self.first = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int32)
        left, right, new = [], [], []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            left.append(vocab[a])
            right.append(vocab[b])
            new.append(vocab[a + b])
        self.new_id = np.array(new, np.int32)
        keys = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        keys, rank = keys[order], order.astype(np.int32)
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]       # a pair listed twice keeps its lower rank
        keys, rank = keys[first], rank[first]
        self.pairs = dict(zip(keys.tolist(), rank.tolist()))
        # open addressing with linear probes; an empty slot holds -1 and no rank
        self.slot_keys = np.full(_SLOTS, -1, np.int64)
        self.slot_rank = np.full(_SLOTS, NONE, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.slot_keys[at[todo]] == -1
            self.slot_keys[at[todo[free]]] = keys[todo[free]]
            placed = self.slot_keys[at[todo]] == keys[todo]
            self.slot_rank[at[todo[placed]]] = rank[todo[placed]]
            todo = todo[~placed]
            at[todo] = (at[todo] + 1) & (_SLOTS - 1)

    # -- pre-tokens ---------------------------------------------------------

    def normalize(self, text: str) -> str:
        """Composed and lower-cased character by character for word-ended files."""
        if not self.word_ended:
            return text
        if text.isascii():
            return text.lower()
        if _NEWER.search(text):
            return self.normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pre_tokens(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of the pre-tokens, and the first one's index
        per text."""
        at, cp = code_points(data)
        n = len(cp)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
        cls = _classes()[cp]
        doc_start = np.searchsorted(at, offs)
        mark = np.ones(n + 1, bool)
        mark[1:n] = cls[1:] != cls[:-1]
        fresh = np.zeros(n + 1, bool)        # first character of a text
        fresh[doc_start] = True
        mark |= fresh
        run = np.flatnonzero(mark)           # the last entry is n
        begin, end, kind = run[:-1], run[1:], cls[run[:-1]]
        if self.word_ended:
            mark[:n] |= cls == DIGIT
        else:
            cut = end[(kind == SPACE) & (end < n) & ~fresh[end]]   # white space followed by something
            mark[cut - 1] = True
            mark[cut[cp[cut - 1] == 32]] = False                    # a space goes with what follows
        quote = (kind[:-1] == OTHER) & (end[:-1] - begin[:-1] == 1) & (kind[1:] == LETTER) & ~fresh[end[:-1]] \
            & (cp[begin[:-1]] == 39) & mark[begin[:-1]] if len(kind) > 1 else np.zeros(0, bool)
        i = np.flatnonzero(quote)
        if len(i):
            q, stop = begin[i], end[i + 1]
            c1 = cp[q + 1]
            c2 = np.where(q + 2 < stop, cp[np.minimum(q + 2, n - 1)], 0)
            take = np.isin(c1, [ord(c) for c in _SHORT]).astype(np.int64)
            for a, b in _LONG:
                take[(c1 == ord(a)) & (c2 == ord(b))] = 2
            hit = take > 0
            mark[q[hit] + 1] = False
            mark[q[hit] + 1 + take[hit]] = True
        starts = np.flatnonzero(mark[:n])
        ends = np.append(starts[1:], n)
        if self.word_ended:
            keep = cls[starts] != SPACE
            starts, ends = starts[keep], ends[keep]
        edge = np.append(at, len(data))
        return edge[starts], edge[ends], np.searchsorted(starts, doc_start)

    # -- merges -------------------------------------------------------------

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.view(tc.U64) * tc.U64(0x9E3779B97F4A7C15) >> tc.U64(64 - _SLOT_BITS)).view(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, NONE where it never merges (b may be -1)."""
        key = a.astype(np.int64)
        key *= self.size
        key += b
        at = self._slot(key)
        got = self.slot_keys[at]
        out = self.slot_rank[at]
        out[(got != key) | (b < 0)] = NONE
        todo = np.flatnonzero((got != key) & (got != -1) & (b >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (_SLOTS - 1)
            got = self.slot_keys[at[todo]]
            hit = got == key[todo]
            out[todo[hit]] = self.slot_rank[at[todo[hit]]]
            todo = todo[~hit & (got != -1)]
        return out

    def _merge_long(self, raw: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties, over a linked list with a heap."""
        ids = self.first[np.frombuffer(raw, np.uint8)].tolist()
        ids[-1] = int(self.last[raw[-1]])
        n = len(ids)
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < n:
                r = self.pairs.get(ids[i] * self.size + ids[j])
                if r is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.new_id[r]), -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            push(i)
            if prev[i] >= 0:
                push(prev[i])
        return [x for x in ids if x >= 0]

    def merge_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every word (flat) and their offsets; words of like length are
        merged together, one merge of each word per step."""
        lens = ends - starts
        out_len = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []    # word, number of ids, ids in a row
        for low, width in ((0, 6), (6, 10), (10, 16), (16, 32), (32, MAX_VECTOR_WORD)):
            group = np.flatnonzero((lens > low) & (lens <= width))
            for g in np.array_split(group, max(1, len(group) * width // 2_000_000)):
                if len(g):
                    parts += self._merge_matrix(data, starts[g], lens[g], g, width)
        for g in np.flatnonzero(lens > MAX_VECTOR_WORD):
            ids = self._merge_long(data[starts[g]:ends[g]].tobytes())
            parts.append((np.array([g]), np.array([len(ids)]), np.array(ids, np.int32)))
        for word, count, _ in parts:
            out_len[word] = count
        offs = np.concatenate([[0], np.cumsum(out_len)])
        flat = np.empty(offs[-1], np.int32)
        for word, count, ids in parts:
            flat[tc.ragged(offs[word], count)] = ids
        return flat, offs

    def _merge_matrix(self, data, starts, lens, words, width):
        """Words of up to ``width`` bytes side by side, one column each. ``key``
        holds rank * 64 + position of the pair that begins at a position, so a
        column's minimum is its next merge (lowest rank, then leftmost); rows
        are linked by the next and previous living position."""
        n = len(words)
        col = np.arange(n)
        s = np.full((width, n), -1, np.int32)
        for p in range(width):
            m = np.flatnonzero(lens > p)
            raw = data[starts[m] + p]
            s[p, m] = np.where(lens[m] == p + 1, self.last[raw], self.first[raw])
        key = np.full((width, n), NONE, np.int32)
        for p in range(width - 1):
            m = np.flatnonzero(lens > p + 1)
            r = self._rank(s[p, m], s[p + 1, m])
            key[p, m] = np.where(r == NONE, NONE, r * 64 + p)
        nxt = np.repeat(np.arange(1, width + 1, dtype=np.int8)[:, None], n, 1)
        prv = np.repeat(np.arange(-1, width - 1, dtype=np.int8)[:, None], n, 1)
        done = []

        def finish(c: np.ndarray) -> None:
            live = (s[:, c] >= 0).T
            done.append((words[c], live.sum(1), s[:, c].T[live]))

        while True:
            best = key.min(0)
            go = np.flatnonzero(best != NONE)
            if 2 * len(go) < len(words) or not len(go):
                finish(np.flatnonzero(best == NONE))
                if not len(go):
                    return done
                words, lens, best = words[go], lens[go], best[go]
                s, key, nxt, prv = (np.ascontiguousarray(x[:, go]) for x in (s, key, nxt, prv))
                go = np.arange(len(words))
            b = best[go]
            j, n = (b & 63).astype(np.int64), len(words)
            sf, kf, nf, pf = s.reshape(-1), key.reshape(-1), nxt.reshape(-1), prv.reshape(-1)
            at = j * n + go
            k = nf[at].astype(np.int64)
            gone = k * n + go
            new = self.new_id[b >> 6]
            sf[at] = new
            sf[gone] = -1
            kf[gone] = NONE
            k = nf[gone].astype(np.int64)
            nf[at] = k
            more = k < lens[go]
            kf[at] = NONE
            c, a = k[more] * n + go[more], at[more]
            pf[c] = j[more]
            r = self._rank(new[more], sf[c])
            kf[a] = np.where(r == NONE, NONE, r * 64 + j[more].astype(np.int32))
            p = pf[at].astype(np.int64)
            has = p >= 0
            a, p = p[has] * n + go[has], p[has]
            r = self._rank(sf[a], new[has])
            kf[a] = np.where(r == NONE, NONE, r * 64 + p.astype(np.int32))

    # -- texts --------------------------------------------------------------

    def _pieces(self, texts: list[str]) -> tuple[list[str], list[int], list[int]]:
        """Texts cut at special tokens; the piece count per text, and the
        special ids that follow pieces (-1: the text ends)."""
        pieces, counts, after = [], [], []
        for t in texts:
            at = 0
            k = len(pieces)
            for m in self._special_re.finditer(t):
                pieces.append(t[at:m.start()])
                after.append(self.specials[m[0]])
                at = m.end()
            pieces.append(t[at:])
            after.append(-1)
            counts.append(len(pieces) - k)
        return pieces, counts, after

    def slice_words(self, texts: list[str]):
        """Distinct pre-tokens of the texts: (bytes, starts, ends, number of
        each in order of use, first index per text)."""
        raw = [self.normalize(t).encode("utf-8") for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        starts, ends, first = self.pre_tokens(data, offs)
        rep, use = tc.distinct(tc.hash_spans(data, starts, ends))
        return data, starts[rep], ends[rep], use, first

    def encode(self, texts: list[str], lookup=None) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets per text. ``lookup(data, starts, ends)`` may
        return known words as (found, flat ids, starts, lens); the rest are merged."""
        if self._special_re is not None and any("<|" in t for t in texts):
            pieces, counts, after = self._pieces(texts)
        else:
            pieces, counts, after = texts, None, None
        data, ws, we, use, first = self.slice_words(pieces)
        if lookup is not None and len(ws):
            found, known, k_start, k_len = lookup(data, ws, we)
        else:
            found, known, k_start, k_len = np.zeros(len(ws), bool), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        rest = np.flatnonzero(~found)
        flat, offs = self.merge_words(data, ws[rest], we[rest])
        start, lens = np.empty(len(ws), np.int64), np.empty(len(ws), np.int64)
        start[found], lens[found] = k_start, k_len
        start[rest], lens[rest] = offs[:-1] + len(known), np.diff(offs)
        table = np.concatenate([known, flat])
        used = lens[use]
        ids = table[tc.ragged(start[use], used)]
        at = np.concatenate([[0], np.cumsum(used)])[first]
        if counts is not None:
            sp = np.array(after)
            j = np.flatnonzero(sp >= 0)
            ids = np.insert(ids, at[j + 1], sp[j])
            shift = np.concatenate([[0], np.cumsum(sp >= 0)])
            at = (at + shift)[np.concatenate([[0], np.cumsum(counts)])]
        return ids, at


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """The tokenizer of a file, read once per worker."""
    return Bpe(path)


def text_lists(col: pa.Array, limit: int):
    """Yield (first row, texts) in pieces of about ``limit`` bytes; null is ''."""
    for lo, hi, _, _ in tc.utf8_slices(col, limit):
        yield lo, [t or "" for t in col.slice(lo, hi - lo).to_pylist()]

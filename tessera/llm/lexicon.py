"""Operator 2, BPE encoding and decoding through a minimal acyclic transducer.

The most frequent pre-tokens of the corpus (counted over every document) are
compiled with their id sequences into a minimal acyclic automaton: words that
end alike share their suffix states, and the number of words skipped on the way
is the word's index into the id outputs. The compiled bytes are broadcast (their
size is bounded by ``max_words``), memory-mapped by each worker, and walked for
all distinct pre-tokens of a slice at once. Pre-tokens that are not in it are
merged exactly, so the lexicon changes the speed and never the result.

Defined cases: a null text is an empty one (no ids, empty decoding). Empty
tables give no rows, repeated rows are encoded each on its own, texts are taken
whole, and clashing extra columns of the input are replaced.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm import textcols as tc
from tessera.llm.counts import frequent
from tessera.llm.shipping import ship

MAX_WORDS = 1 << 16        # words compiled at most; bounds what is broadcast
MAX_WORD_BYTES = 48        # longer words are always merged
SLICE_BYTES = 3 << 20


def word_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(word binary, n) of every pre-token of up to MAX_WORD_BYTES bytes,
    counted per slice first and then over the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = bpe.load(path)
        for b in batches:
            for _, texts in bpe.text_lists(b.column(0), SLICE_BYTES):
                data, ws, we, use, _ = tok.slice_words(texts)
                n = np.bincount(use, minlength=len(ws))
                k = np.flatnonzero(we - ws <= MAX_WORD_BYTES)
                lens = we[k] - ws[k]
                words = pa.BinaryArray.from_buffers(pa.binary(), len(k), [
                    None, pa.py_buffer(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)),
                    pa.py_buffer(data[tc.ragged(ws[k], lens)])])
                yield pa.RecordBatch.from_arrays([words, pa.array(n[k], pa.int64())], ["word", "n"])

    ship(docs.sparkSession)
    return docs.select(text).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class _State:
    __slots__ = ("final", "key", "next", "number")

    def __init__(self):
        self.next: dict[int, _State] = {}
        self.final = False
        self.number = -1


def compile_words(words: list[bytes], ids: list[np.ndarray]) -> bytes:
    """Minimal automaton of distinct words (with the ids of each) as one block
    of bytes: a JSON header line, then arrays."""
    order = sorted(range(len(words)), key=words.__getitem__)
    root, register, path = _State(), {}, []      # path: (parent, byte, child) of the last word, not yet shared

    def share(down_to: int) -> None:
        while len(path) > down_to:
            parent, byte, child = path.pop()
            sig = (child.final, tuple((b, id(t)) for b, t in child.next.items()))
            parent.next[byte] = register.setdefault(sig, child)

    last = b""
    for i in order:
        w = words[i]
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        share(common)
        node = path[-1][2] if path else root
        for byte in w[common:]:
            child = _State()
            node.next[byte] = child
            path.append((node, byte, child))
            node = child
        node.final = True
        last = w
    share(0)
    states: list[_State] = []
    count: list[int] = []

    def number(top: _State) -> None:             # children before parents, without recursion
        stack = [(top, iter(list(top.next.values())))]
        while stack:
            state, rest = stack[-1]
            child = next((c for c in rest if c.number < 0), None)
            if child is not None:
                stack.append((child, iter(list(child.next.values()))))
                continue
            stack.pop()
            if state.number < 0:
                state.number = len(states)
                states.append(state)
                count.append(int(state.final) + sum(count[c.number] for c in state.next.values()))

    number(root)
    keys, target, skip = [], [], []
    for state in states:
        passed = int(state.final)
        for byte in sorted(state.next):
            t = state.next[byte].number
            keys.append(state.number * 256 + byte)
            target.append(t)
            skip.append(passed)
            passed += count[t]
    arrays = {
        "keys": np.array(keys, np.int64), "target": np.array(target, np.int32), "skip": np.array(skip, np.int32),
        "final": np.array([s.final for s in states], np.uint8), "root": np.array([root.number], np.int32),
        "offs": np.concatenate([[0], np.cumsum([len(ids[i]) for i in order])]).astype(np.int64),
        "ids": np.concatenate([ids[i] for i in order]).astype(np.int32) if order else np.zeros(0, np.int32),
    }
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 8) * 8
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 8) + b"\n"
    return line + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays.values())


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, block: bytes):
        fd, name = tempfile.mkstemp(prefix="lexicon-")
        try:
            with os.fdopen(fd, "wb") as f:
                f.write(block)
            with open(name, "rb") as f:
                self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        finally:
            os.unlink(name)          # the mapping stays, no file is left behind
        end = self._map.find(b"\n") + 1
        for key, (kind, n, at) in json.loads(self._map[:end]).items():
            setattr(self, key, np.frombuffer(self._map, kind, n, end + at))

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Walk all words at once: (found, flat ids, first id, number of ids)
        of the words found, in order."""
        n = len(starts)
        state = np.full(n, self.root[0], np.int64)
        index = np.zeros(n, np.int64)
        live = np.flatnonzero((ends - starts <= MAX_WORD_BYTES) & (ends > starts))
        over: list[np.ndarray] = []
        p = 0
        while len(live) and len(self.keys):
            key = state[live] * 256 + data[starts[live] + p]
            j = np.searchsorted(self.keys, key)
            j[j == len(self.keys)] = 0
            ok = self.keys[j] == key
            live, j = live[ok], j[ok]
            state[live] = self.target[j]
            index[live] += self.skip[j]
            p += 1
            ended = ends[live] - starts[live] == p
            over.append(live[ended])
            live = live[~ended]
        hit = np.concatenate(over) if over else np.zeros(0, np.int64)
        found = np.zeros(n, bool)
        found[hit[self.final[state[hit]] == 1]] = True
        k = index[found]
        return found, self.ids, self.offs[k], self.offs[k + 1] - self.offs[k]


_OPEN: dict[str, Lexicon] = {}


def _opened(shared) -> Lexicon:
    """The worker's mapping of a broadcast lexicon, made once."""
    ident = shared[0]
    if ident not in _OPEN:
        _OPEN.clear()
        _OPEN[ident] = Lexicon(shared[1].value)
    return _OPEN[ident]


def build(docs: DataFrame, path: str, text: str = "text", max_words: int = MAX_WORDS) -> bytes:
    """Compile the most frequent pre-tokens, ``max_words`` at most."""
    words = sorted(bytes(r[0]) for r in frequent(word_counts(docs, path, text), max_words).select("word").collect())
    if not words:
        return compile_words([], [])
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    flat, offs = bpe.load(path).merge_words(np.frombuffer(b"".join(words), np.uint8), starts, ends)
    return compile_words(words, [flat[a:b] for a, b in zip(offs[:-1], offs[1:])])


class _Decoder:
    """Token strings of a file, each with a space after it, as one table."""

    def __init__(self, path: str):
        raw = [t.encode() + b" " for t in bpe.load(path).tokens]
        self.lens = np.array([len(r) for r in raw], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.table = np.frombuffer(b"".join(raw), np.uint8)

    def texts(self, ids: np.ndarray, offs: np.ndarray) -> list[str]:
        """Tokens joined by one space, per list of ids."""
        out, lo, n = [], 0, len(offs) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + _DECODE_IDS, "right")) - 1)
            k = ids[offs[lo]:offs[hi]]
            at = np.concatenate([[0], np.cumsum(self.lens[k])])[offs[lo:hi + 1] - offs[lo]]
            raw = self.table[tc.ragged(self.starts[k], self.lens[k])].tobytes()
            out += [raw[x:max(x, y - 1)].decode("utf-8") for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            lo = hi
        return out


_DECODE_IDS = 1 << 18      # ids decoded at once


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None,
           max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` with the token ids of the whole text in array column ``ids``;
    with ``decoded``, also the text decoded back from those ids (in the same
    worker: a second one would double the memory)."""
    ship(docs.sparkSession)
    shared = (uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(build(docs, path, text, max_words)))
    added = [ids] + [decoded] * (decoded is not None)
    base = docs.select(*[c for c in docs.columns if c not in added])
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, lex = bpe.load(path), _opened(shared)
        decoder = _Decoder(path) if decoded is not None else None
        for b in batches:
            for lo, texts in bpe.text_lists(b.column(names.index(text)), SLICE_BYTES):
                flat, offs = tok.encode(texts, lex.lookup)
                cols = [pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(flat, pa.int32()))]
                if decoder is not None:
                    cols.append(pa.array(decoder.texts(flat, offs), pa.string()))
                yield pa.RecordBatch.from_arrays([*b.slice(lo, len(texts)).columns, *cols], [*names, *added])

    kinds = ["array<int>", "string"]
    schema = base.select(*names, *[F.lit(None).cast(k).alias(n) for n, k in zip(added, kinds)]).schema
    return base.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with the decoded text of each id list: the file has no
    decoder, so tokens are joined by one space, special ones included."""
    ship(encoded.sparkSession)
    base = encoded.select(*[c for c in encoded.columns if c != decoded])
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _Decoder(path)
        for b in batches:
            col = b.column(names.index(ids)).fill_null([]) if b.column(names.index(ids)).null_count else b.column(names.index(ids))
            offs = np.asarray(col.offsets).astype(np.int64)
            texts = decoder.texts(np.asarray(col.values), offs)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, decoded])

    return base.mapInArrow(run, base.withColumn(decoded, F.lit("")).schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``docs``."""
    both = encode(docs.select("doc_id", "text"), path, decoded="decoded").drop("text")
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))

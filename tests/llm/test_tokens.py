"""Operators 2 and 7 against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from data import awkward, same, table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, lexicon, registry, tokenfile

WORD = registry.tokenizer_path("word_bpe_49k.json")
BYTE = registry.tokenizer_path("byte_bpe_50k.json")


def fuzz(n=300):
    rng = random.Random(5)
    bits = ["don't", "it's", "  x", "\n\n", "a\t b", "'re", "we'll've", "12 34", "x'S", "Éa", "ß", "Σας", "İx", "中文", "😀", "!!!",
            "''s", "!'s", " 's", "<|endoftext|>", "<|startoftext|>", "½²", "a_b", "\x1c", "\x85", "é", "z" * 90]
    out = ["".join(rng.choice(bits) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 20))) for _ in range(n)]
    return out + ["".join(chr(rng.choice([rng.randrange(32, 0x2FFF), rng.randrange(32, 0xD7FF)])) for _ in range(15)) for _ in range(n)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_engine_equals_library(path):
    texts = fuzz() + [t or "" for _, t in awkward()]
    ids, at = bpe.load(path).encode(texts)
    for t, e, lo, hi in zip(texts, Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False), at, at[1:]):
        assert ids[lo:hi].tolist() == e.ids, t


def test_long_words_merge_like_short_ones():
    tok = bpe.load(BYTE)
    rng = random.Random(2)
    raw = [bytes(rng.choice(b"thein rs") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    ends = np.cumsum([len(r) for r in raw])
    flat, offs = tok.merge_words(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)
    assert [flat[a:b].tolist() for a, b in zip(offs, offs[1:])] == [tok._merge_long(r) for r in raw]


def test_lexicon_finds_exactly_its_words():
    rng = random.Random(4)
    words = sorted({bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 7))) for _ in range(600)})
    inside, outside = words[::2], words[1::2]
    block = lexicon.compile_words(inside, [np.array([k, k + 1][:1 + k % 2], np.int32) for k in range(len(inside))])
    lex = lexicon.Lexicon(block)
    ends = np.cumsum([len(w) for w in words])
    found, flat, start, size = lex.lookup(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    assert [w for w, f in zip(words, found) if f] == inside and not set(outside) & set(inside)
    assert [flat[a:a + n].tolist() for a, n in zip(start, size)] == [[k, k + 1][:1 + k % 2] for k in range(len(inside))]
    tree = {w[:i] for w in inside for i in range(len(w) + 1)}
    assert len(lex.final) < len(tree)                  # suffixes are shared
    nothing = lexicon.Lexicon(lexicon.compile_words([], []))
    assert not nothing.lookup(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2]))[0].any()


def test_lexicon_query(spark):
    rows = awkward() + list(enumerate(fuzz(40), 500))
    docs = table(spark, rows, ids="clash", decoded=1)
    tok = Tokenizer.from_file(WORD)
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same(lexicon.digests(docs, WORD).collect(), want)
    small = lexicon.encode(docs, WORD, max_words=5)    # the lexicon's size changes nothing
    both = lexicon.decode(small, WORD).select("doc_id", F.size("ids"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256),
                                              F.sha2("decoded", 256))
    same(both.collect(), want)
    assert lexicon.digests(docs.limit(0), WORD).count() == 0


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 1000, 300)
    counts[5] = 0
    got = tokenfile.code_lengths(counts)
    import heapq

    heap = [(int(c), [i]) for i, c in enumerate(counts) if c]
    plain = np.zeros(len(counts), int)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[1] + b[1]:
            plain[i] += 1
        heapq.heappush(heap, (a[0] + b[0], a[1] + b[1]))
    assert (counts * got).sum() == (counts * plain).sum() and got[5] == 0
    steep = np.array([2**k for k in range(40)])
    short = tokenfile.code_lengths(steep)
    assert short.max() <= tokenfile.MAX_BITS and sum(2.0 ** -short.astype(float)) <= 1
    assert tokenfile.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0]


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.geometric(0.02, 5000) % 700, np.arange(700)]).astype(np.int32)
    lengths = tokenfile.code_lengths(np.bincount(ids, minlength=900))
    for n in (1, 255, 256, 257, len(ids)):
        raw, offs = tokenfile.pack(ids[:n], lengths, tokenfile.canonical(lengths))
        back = tokenfile.unpack(raw, offs[::tokenfile.CHECK_EVERY], n, tokenfile.decode_table(lengths))
        assert back.tolist() == ids[:n].tolist()


def test_token_file(spark):
    rows = [r for r in awkward() if r[0] is not None] + list(enumerate(fuzz(40), 500))
    tok = Tokenizer.from_file(BYTE)
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] is not None, (r[1] or "").encode())):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    same(tokenfile.query(spark, table(spark, rows, start=1, part="x"), BYTE).collect(), want)
    assert tokenfile.query(spark, table(spark, rows).limit(0), BYTE).count() == 0
    with_null = tokenfile.query(spark, table(spark, [(None, "a"), (2, "b")]), BYTE).collect()
    assert sorted((r["doc_id"] is None, r["start"]) for r in with_null) == [(False, 2), (True, 0)]

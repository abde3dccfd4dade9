"""Operator 12 against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from data import awkward, same, table
from pyspark.sql import functions as F

from tessera.llm import rankbpe, registry

MULTI = registry.tokenizer_path("byte_bpe_multi_50k.tiktoken")
PLAIN = registry.tokenizer_path("byte_bpe_50k.tiktoken")


def library(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hostile(n=400):
    rng = random.Random(11)
    bits = ["don't", "it's", "'s", "''s", " 's", "\n's", "!'s", "'re", "'r", "'ve", "'ll", "'l", "'d", "'m", "'sx", "'S", "'", " '", "x'",
            "  x", "   ", "\n\n", "\n \n", "a\t b", " x", " ", "　中", "12 34", "½²", "Ⅷ", "a_b", "!!!", "...", "\x1c", "\x85",
            "\x00", "Éa", "é", "ß", "Σας", "İx", "中文", "日本語", "한국어", "😀", "👩‍👩", "नमस्ते", "<|endoftext|>", "z" * 90, "\U0001e900"]
    out = ["".join(rng.choice(bits) + rng.choice(["", "", " ", "\n", "  "]) for _ in range(rng.randint(0, 24))) for _ in range(n)]
    out += ["".join(chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0x20, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)]))
                    for _ in range(20)) for _ in range(n)]
    return out + ["", " ", "'", "a" * 5000, "ab" * 3000, "".join(rng.choice("thein rs") for _ in range(3000)).replace(" ", "")]


def encode(path, texts):
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return rankbpe.load(path).encode(np.frombuffer(b"".join(raw), np.uint8), offs)


@pytest.mark.parametrize("path", [MULTI, PLAIN])
def test_equals_library(path):
    texts, lib = hostile() + [t or "" for _, t in awkward()], library(path)
    ids, at = encode(path, texts)
    for t, lo, hi in zip(texts, at, at[1:]):
        assert ids[lo:hi].tolist() == lib.encode_ordinary(t), t[:80]
    raw, end = rankbpe.load(path).decode(ids, at)
    assert [raw[a:b].tobytes().decode() for a, b in zip(end, end[1:])] == texts


def test_every_token_is_one_piece_or_known():
    tok, lib = rankbpe.load(MULTI), library(MULTI)
    for t, r in tok.whole.items():                # merging alone does not give these
        assert lib._encode_single_piece(t) == [r]
    lens = tok.token_lens[tok.token_lens > 0]
    assert len(lens) == len(lib.token_byte_values())


def test_rows_and_heap_merge_alike():
    tok, rng = rankbpe.load(MULTI), random.Random(3)
    raw = [bytes(rng.choice(b"thein rs,aou") for _ in range(rng.randint(1, rankbpe.MAX_ROW))) for _ in range(400)]
    ends = np.cumsum([len(r) for r in raw])
    flat, at = tok.merge(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [tok._merge_long(r) for r in raw]


def test_pair_table_holds_exactly_the_pairs():
    tok = rankbpe.load(MULTI)
    keys = np.array(list(tok.pairs), np.int64)
    assert (tok.rank(keys // tok.size, keys % tok.size) == np.array(list(tok.pairs.values()))).all()
    rng = np.random.default_rng(1)
    a, b = rng.integers(-1, tok.size, 20000), rng.integers(-1, tok.size, 20000)
    want = [rankbpe.NEVER if x < 0 or y < 0 else tok.pairs.get(x * tok.size + y, rankbpe.NEVER) for x, y in zip(a.tolist(), b.tolist())]
    assert tok.rank(a, b).tolist() == want


def test_query(spark):
    rows, lib = awkward() + list(enumerate(hostile(30), 500)), library(MULTI)
    docs = table(spark, rows, ids="clash", n_tokens=1)
    want = []
    for i, t in rows:
        ids = lib.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(lib.decode_bytes(ids)).hexdigest()))
    same(rankbpe.digests(docs, MULTI).collect(), want)
    both = rankbpe.decode(rankbpe.encode(docs, MULTI), MULTI)
    assert set(both.columns) == {*docs.columns, "decoded"}
    same(both.select("doc_id", F.col("decoded").cast("string")).collect(), [(i, t or "") for i, t in rows])
    assert rankbpe.digests(docs.limit(0), MULTI).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert [r["decoded"] for r in rankbpe.decode(nothing, MULTI).orderBy("doc_id").collect()] == [None, b""]


def test_slices_do_not_touch():
    texts = ["it", "'s", " ", " x", "'", "s", "", "12", "3"]
    ids, at = encode(MULTI, texts)
    for t, lo, hi in zip(texts, at, at[1:]):
        assert ids[lo:hi].tolist() == library(MULTI).encode_ordinary(t)

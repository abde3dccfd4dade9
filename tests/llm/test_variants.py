"""Operator 11 against brute force over plain strings."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from data import awkward, same, table

from tessera.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_counts(rows, drop_every=97):
    n = Counter()
    for i, t in rows:
        for w in map(lower, RUN.findall(t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if drop_every and h % drop_every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5}


def brute(vocab):
    near = {w: sorted((v for v in vocab if one_edit(w, v)), key=lambda v: (-vocab[v], v)) for w in vocab}
    form = {w: near[w][0] if near[w] and vocab[near[w][0]] >= 2 * vocab[w] else None for w in vocab}
    out = []
    for w in vocab:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, vocab[w], len(near[w]), vocab.get(form[w])))
    return out


def texts(n=260):
    rng = random.Random(6)
    letters = "abcdehéñÿÀ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(60)]

    def typo(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]])

    out = []
    for i in range(n):
        ws = [rng.choice(base[:1 + rng.randrange(60)]) for _ in range(rng.randint(1, 60))]
        out.append((i, rng.choice([" ", "-", "9", "中", "×÷ "]).join(typo(w) if rng.random() < 0.2 else w for w in ws)))
    return out


@pytest.mark.parametrize("drop_every", [97, 5, None])
def test_counts(spark, drop_every):
    rows = awkward() + texts() + [(900, "x" * 90 + " Ünï" + "É" * 70), (None, "É" * 70), (901, "ab" * 40_000 + " abcdef")]
    got = variants.word_counts(table(spark, rows, word="clash", n=1), drop_every=drop_every).collect()
    same(got, list(brute_counts(rows, drop_every).items()))


def test_every_neighbour_is_met():
    """Whatever is one edit away shares a generated key with it, from one end."""
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abéijqr") for _ in range(rng.randint(1, 4))) for _ in range(300)})
    for symbols in (2, 3, 8, 97):
        col = pa.array(words)
        own = {}
        for w, k in zip(words, variants.reduced_keys(col, symbols).tolist()):
            own.setdefault(k, []).append(w)
        met = Counter()
        for number, key in variants.neighbourhood(col, symbols):
            for i, k in zip(number.tolist(), key.tolist()):
                for other in own.get(k, []):
                    met[words[i], other] += 1
        for a in words:
            for b in words:
                if one_edit(a, b):
                    same_reduced = [ord(x) % symbols for x in a] == [ord(x) % symbols for x in b]
                    assert met[a, b] + met[b, a] == (2 if same_reduced else 1), (a, b, symbols)


@pytest.mark.parametrize("symbols", [3, 8])
def test_groups(spark, symbols):
    rows = texts()
    vocab = {w: c for w, c in brute_counts(rows).items() if c >= 3}
    want = brute(vocab)
    assert any(r[1] for r in want) and any(r[1] is None and r[4] for r in want)
    words = variants.vocabulary(variants.word_counts(table(spark, rows)), symbols=symbols)
    same(variants.group(words, symbols=symbols).collect(), want)


def test_long_chain_of_forms(spark):
    """Forms one edit apart, each twice as frequent: the root is at the end."""
    chain = [("b" * k + "a" * (40 - k), 3 * 2**k) for k in range(30)]
    counts = spark.createDataFrame(chain, "word string, n bigint")
    got = {r["word"]: r for r in variants.group(variants.vocabulary(counts)).collect()}
    assert {r["root"] for r in got.values()} == {chain[-1][0]}
    assert [got[w]["form"] for w, _ in chain] == [w for w, _ in chain[1:]] + [None]


def test_ties_and_bounds(spark):
    counts = spark.createDataFrame([("aaaaa", 3), ("aaaab", 6), ("aaaac", 6), ("aaaaé", 6), ("zzzzz", 2), ("yyyyy", 3), ("aaaa", 99)],
                                   "word string, n bigint")
    got = {r["word"]: tuple(r)[1:] for r in variants.group(variants.vocabulary(counts)).collect()}
    assert got["aaaaa"] == ("aaaa", "aaaa", 3, 4, 99) and "zzzzz" not in got
    assert got["yyyyy"] == (None, "yyyyy", 3, 0, None)
    some = variants.vocabulary(counts.filter("word != 'aaaa'"))
    assert {r["word"]: r["form"] for r in variants.group(some).collect()}["aaaaa"] == "aaaab"


def test_empty(spark):
    for docs in (table(spark, [(1, None), (2, "")]), table(spark, awkward()).limit(0)):
        assert variants.query(docs).collect() == []


def test_shifted_crc_is_the_crc():
    words = [b"a", b"abc", "éé".encode(), b"q" * 64, b"q" * 65, b"r" * 300]
    lens, use = np.array([len(w) for w in words]), np.tile(np.arange(len(words)), 3)
    doc = np.repeat(np.arange(3), len(words))
    got = variants._crc_of_runs(["7", "", "-12345678901"], doc, words, lens, use)
    assert got.tolist() == [zlib.crc32(f"{i}:".encode() + w) for i in ("7", "", "-12345678901") for w in words]

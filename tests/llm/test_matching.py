"""Operators 3, 4 and 8 against brute force."""

import hashlib
import math
import random
import re

import numpy as np
from data import awkward, same, table
from pyspark.sql import types as T

from tessera.llm import fmindex, licenses, lzdedup

ITEM = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def hits(text, items):
    w, hit, names = words(text), set(), set()
    for ident, t in items:
        v = words(t)
        for j in range(max(1, len(v) - 9) if v else 0):
            g = v[j:j + 10]
            for i in range(len(w) - len(g) + 1):
                if w[i:i + len(g)] == g:
                    hit |= set(range(i, i + len(g)))
                    names.add("null" if ident is None else str(ident))
    return len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)


def contaminated():
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([4, 10, 14, 30])))) for k in range(12)]
    items += [(None, "no id for this item"), (50, None), (51, "..."), (52, "Ünïcode"), (3, items[5][1]), (10, items[0][1])]
    docs = awkward(n=10)
    for k in range(40):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12)))]
        for _, t in rng.sample(items[:12], 2):
            v = t.split()
            lo = rng.randint(0, 3)
            parts += [", ".join(v[lo:lo + rng.randint(5, 30)]).upper(), " ".join(rng.choice(vocab) for _ in range(3))]
        docs.append((300 + k, " ".join(parts)))
    docs += [(400, items[0][1]), (401, "no id for this item"), (402, "ünïcode Ünïcode")] + [(500 + k, docs[-3][1]) for k in range(8)]
    return docs, items


def test_decontamination_matches_brute_force(spark):
    docs, items = contaminated()
    got = fmindex.digests(table(spark, docs, n_words=0, spans="x", items=1), spark.createDataFrame(items, ITEM))
    same(got.collect(), [(i, *hits(t, items)) for i, t in docs])


def test_decontamination_in_blocks_and_without_items(spark, monkeypatch):
    docs, items = contaminated()
    bench = spark.createDataFrame(items, ITEM)
    monkeypatch.setattr(fmindex.phrase_blocks, "__defaults__", ("item_id", "text", 40))
    assert len(fmindex.phrase_blocks(bench)) > 3
    same(fmindex.digests(table(spark, docs), bench).collect(), [(i, *hits(t, items)) for i, t in docs])
    assert fmindex.digests(table(spark, docs), bench.limit(0)).filter("contaminated").count() == 0
    assert fmindex.digests(table(spark, docs).limit(0), bench).count() == 0


def test_removal_leaves_no_hit_and_no_change_elsewhere(spark):
    docs, items = contaminated()
    bench = spark.createDataFrame(items, ITEM)
    out = {(r["doc_id"], r["text"]) for r in fmindex.remove(table(spark, docs), bench).collect()}
    assert all(not hits(t, items)[4] for _, t in out)
    clean = {(i, t) for i, t in docs if not hits(t, items)[4]}
    assert clean <= out
    assert {i for i, t in docs} - {i for i, _ in out} == {i for i, t in docs if words(t) and hits(t, items)[1] == len(words(t))}


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(7)
    for n_words, size in ((1, 40), (3, 400), (50, 900)):
        seq = rng.integers(0, n_words + 1, size)
        seq[-1] = 0
        seq[: size // 4] = seq[size // 4: 2 * (size // 4)]       # a long repeat
        seq[size // 4 - 1] = 0
        index = fmindex.FmIndex(seq, n_words)
        for m in (1, 2, 5, 10):
            at = [i for i in range(size - m) if (seq[i:i + m] > 0).all()]
            phrases = {tuple(seq[i:i + m]) for i in at} | {tuple(rng.integers(1, n_words + 1, m)) for _ in range(20)}
            p = np.array([list(x) + [0] * (10 - m) for x in phrases], np.int32)
            lo, hi = index.search(p, np.full(len(p), m))
            for x, a, b in zip(phrases, lo, hi):
                want = [i for i in range(size - m + 1) if tuple(seq[i:i + m]) == x]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def license_row(text):
    w = words(text)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    mine, best = set(), 0.0
    for line in (text or "").split("\n"):
        block = set(words(line))
        for label, t in licenses.TEMPLATES:
            t = set(t.split())
            if len(t & block) >= math.ceil(0.8 * len(t) - 1e-9):
                mine.add(label)
                best = max(best, len(t & block) / len(t))
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | mine)), best)


def test_licenses_match_brute_force(spark):
    rng = random.Random(3)
    docs = awkward(n=10)
    notices = [t for _, t in licenses.TEMPLATES] + [p for p, _ in licenses.PHRASES]
    for k in range(120):
        v = rng.choice(notices).split()
        v = [x for x in v if rng.random() > 0.12] + ["filler"] * rng.randint(0, 3)
        if rng.random() < 0.3:
            rng.shuffle(v)
        docs.append((600 + k, "Some words.\n" + rng.choice([" ", ", ", "-"]).join(v).title() + rng.choice(["", "\nmore", " mit license"])))
    docs += [(800, "Apache License apache license, APACHE\nLICENSE"), (801, "cc by cc by"), (802, "the mit licenses"), (803, "mit\x7flicense")]
    got = licenses.scan(table(spark, docs, labels="clash", score="x"))
    same(got.collect(), [(i, *license_row(t)) for i, t in docs])
    assert licenses.scan(table(spark, docs).limit(0)).count() == 0


def deduped(rows):
    space = re.compile("[^\x20\x09-\x0d]+")
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    first, out = {}, {}
    split = {r: space.findall(r[1] or "") for r in rows}
    for r in rows:
        w = split[r]
        for p in range(len(w) - 19):
            g = tuple(w[p:p + 20])
            first[g] = min(first.get(g, (True, 1 << 62, 1 << 62)), (r[0] is None, r[0] or 0, p))
    for r in rows:
        w, gone = split[r], set()
        for p in range(len(w) - 19):
            if first[tuple(w[p:p + 20])] < (r[0] is None, r[0] or 0, p):
                gone |= set(range(p, p + 20))
        out[r] = (r[0], len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def repeats():
    rng = random.Random(11)
    text = lambda n: " ".join(f"t{rng.randrange(5000)}" for _ in range(n))
    passages = [text(n) for n in (20, 21, 25, 60, 200)]
    rows = awkward(seed=4, n=15)
    for k in range(80):
        parts = [text(rng.randint(0, 30))]
        for p in rng.sample(passages, 2):
            w = p.split()
            lo = rng.randint(0, 5)
            parts += [" ".join(w[lo:lo + rng.randint(15, 200)]), text(rng.randint(0, 9))]
        rows.append((700 + k, "\n".join(parts)))
    rows += [(900, "a b " * 40), (901, "a b " * 40 + "c"), (902, passages[3] + " " + passages[3])]
    rows += [(903, passages[4] + " x"), (903, "y " + passages[4])]        # one id, two texts
    return rows


def test_substring_dedup_matches_brute_force(spark):
    rows = repeats()
    want = deduped(rows)
    got = lzdedup.digests(table(spark, rows, n_words=1, kept="x").repartition(7)).collect()
    same(got, [want[r] for r in rows])
    assert lzdedup.digests(table(spark, rows).limit(0)).count() == 0


def test_substring_dedup_with_split_anchors_and_small_slices(spark, monkeypatch):
    rows = [r for r in repeats() if r[0] not in (130, 131, 903)]
    want = deduped(rows)
    monkeypatch.setattr(lzdedup, "SPLIT_LEAST", 1)
    monkeypatch.setattr(lzdedup, "SPLIT_SHARE", 10_000_000)
    got = lzdedup.digests(table(spark, rows).repartition(3)).collect()
    same(got, [want[r] for r in rows])


def test_substring_dedup_keeps_the_largest_id(spark):
    words = " ".join(f"w{k}" for k in range(30))
    rows = [(2**63 - 1, words), (None, "a text without an id"), (1, words + " more")]
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in lzdedup.digests(table(spark, rows)).collect()}
    assert got == {(2**63 - 1, 30, 30), (None, 5, 0), (1, 31, 0)}

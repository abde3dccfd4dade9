"""Operator 13 against brute force over plain strings."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from data import awkward, same, table

from tessera.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(rows, items, top=10):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    big_n = sum(bool(c) for _, c in docs)
    length = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted = {}
    for ident, t in items:
        wanted.setdefault(ident, Counter()).update(terms(t))
    out = []
    for ident, q in wanted.items():
        scored = []
        for i, c in docs:
            n = sum(c.values())
            m = 100 - 75 + (75 * n * big_n) // length if length else 0
            s = sum(times * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t, times in q.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(ident, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top])]
    return out


def case(seed=2):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["ra", "é", "中", "9", "x", "tion", "A"]) for _ in range(rng.randint(1, 3))) for _ in range(80)]

    def some(n):
        return "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-", "_", "\x00", "~"]) for _ in range(n))

    rows = [(i, some(rng.choice([1, 5, 30, 200]))) for i in range(80)] + awkward(n=15)
    rows += [(700, some(20_000)), (701, rows[3][1]), (2**63 - 1, rows[3][1]), (None, rows[3][1]), (-9, rows[4][1])]
    items = [(k, some(rng.choice([1, 3, 20]))) for k in range(12)]
    items += [(50, None), (51, "..."), (52, "nowhere"), (53, "the THE the"), (54, rows[3][1]), (55, "x"), (55, "9 x"), (None, "é")]
    return rows, items


def bench(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("block_rows,piece", [(1 << 18, 1 << 22), (5, 1 << 22), (1 << 18, 7)])
def test_search(spark, monkeypatch, block_rows, piece):
    rows, items = case()
    block = ranked.Block(ranked.item_terms(bench(spark, items)).collect())
    raw = [(t or "").encode() for _, t in rows]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    size, doc, term, tf = ranked.scan(block, np.frombuffer(b"".join(raw), np.uint8), offs, piece)
    assert size.tolist() == [len(terms(t)) for _, t in rows]
    want = {(d, t): c for d, (_, x) in enumerate(rows) for t, c in Counter(terms(x)).items() if t in set(block.terms)}
    assert {(d, block.terms[t]): c for d, t, c in zip(doc.tolist(), term.tolist(), tf.tolist())} == want
    got = ranked.search(table(spark, rows, item_id="clash", rank=1), bench(spark, items), block_rows=block_rows)
    same(got.collect(), brute(rows, items))


def test_small_cells(monkeypatch):
    """Scores do not depend on how many documents are multiplied at once."""
    rng = np.random.default_rng(1)
    rows = [{"item": i, "term": f"t{t}", "times": int(rng.integers(1, 4))} for i in range(9) for t in rng.choice(30, 8, replace=False)]
    block = ranked.Block(rows)
    block.weigh(40, 900, {k: k % 12 for k in range(30)})
    pairs = sorted({(int(d), int(t)) for d, t in zip(rng.integers(0, 25, 200), rng.integers(0, len(block.terms), 200))})
    doc, term = np.array(pairs).T
    tf, size = rng.integers(1, 9, len(doc)), rng.integers(1, 99, 25)

    def scores():
        return [x for d, i, s in ranked._scores(block, size, doc, term, tf) for x in zip(d.tolist(), i.tolist(), s.tolist())]

    whole = scores()
    monkeypatch.setattr(ranked, "CELLS", 10)
    assert whole and scores() == whole


def test_blocks_cover_all_buckets_within_the_limit():
    rng = random.Random(3)
    sizes = [(b, rng.randint(1, 40)) for b in rng.sample(range(500), 120)]
    blocks = ranked.pack(sizes, 50)
    assert sum(n for b, n in sizes for lo, hi in blocks if lo <= b <= hi) == sum(n for _, n in sizes)
    assert all(sum(n for b, n in sizes if lo <= b <= hi) <= 50 for lo, hi in blocks)
    assert ranked.pack([(3, 80), (4, 1)], 50) == [(3, 3), (4, 4)]


def test_empty(spark):
    docs, items = table(spark, awkward()), bench(spark, [(1, "the"), (2, None)])
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (table(spark, [(1, None)]), items)):
        got = ranked.search(d, i)
        assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_item_ids_of_any_type(spark):
    items = spark.createDataFrame([("b'x", "the"), ("", "ra")], "item_id string, text string")
    rows = awkward()
    got = ranked.search(table(spark, rows), items).collect()
    same(got, brute(rows, [("b'x", "the"), ("", "ra")]))

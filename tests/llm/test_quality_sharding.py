"""Operators 1 and 9 against brute force."""

import collections
import re
import zlib

import pytest
from data import awkward, same, table

from tessera.llm import quality, sharding

WORD = re.compile("[^\x20\x09-\x0d]+")


def judge(text):
    text = text or ""
    w = WORD.findall(text)
    grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    rep = {p for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for p in range(i, i + 5)}
    lines = text.split("\n")
    full = [x for x in lines if WORD.search(x)]
    lost = removed = 0
    for x in lines:
        words = WORD.findall(x)
        chars = sum(map(len, words))
        symbols = len(re.findall(r"[#*$%&|<>~^{}\\=_]", x))
        marks = len(re.findall("[!?]", x))
        seps = sum(k in quality.SEPARATORS for k in words)
        if words and (10 * symbols > chars or marks >= 3 and 12 * marks > chars or seps >= 2 and 5 * seps >= len(words)
                      or x.strip(" \t").lower() in quality.MENU
                      or len(words) <= 40 and any(p in x.lower() for p in quality.BOILERPLATE)):
            lost, removed = lost + len(words), removed + 1
    base = len(w) < 10 or 100 * len(rep) > 20 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(rep), base,
            len(lines), removed, len(w) - lost, not base and 100 * lost <= 30 * len(w))


EXTRA = ["Home\nAll rights reserved 2020\nA b | c | d | e\n!!! OH NO !!!\n" + "plain words here " * 9,
         "a*** b&&& c%%% d$$$ e### f*** g&&& h%%% i$$$ j### k", "1 2 3 4 5 6 7 8 9 10 11\n" * 3,
         "» x » y » z\nnine words that are plain stand in this line."]


def test_quality_matches_brute_force(spark):
    rows = awkward() + list(enumerate(EXTRA, 200))
    got = quality.assess(table(spark, rows, n_words="clash", kept=3).select("doc_id", "text", "n_words", "kept")).drop("text")
    same(got.collect(), [(i, *judge(t)) for i, t in rows])


def test_quality_filter_cleans_and_keeps_columns(spark):
    docs = table(spark, [(1, "Home\n" + "some plain words here, each one different from the rest of them.\n\nend of it"),
                         (2, "too short"), (3, None)])
    out = quality.filter_quality(docs)
    assert out.schema == docs.schema
    rows = out.collect()
    assert [(r["doc_id"], r["text"].split("\n")[0][:10], r["n_chars"] == len(r["text"])) for r in rows] == [(1, "some plain", True)]
    assert quality.assess(docs.limit(0)).count() == 0


def test_shards_hold_the_key_law(spark):
    rows = awkward() + [(i, f"text {i}") for i in range(1000, 1400)] + [(7, "hot")] * 50
    docs = table(spark, rows, shard="clash", slot=1)
    path = sharding.write_shards(spark, docs, bucket_bytes=4 << 10)       # several buckets a shard
    got = sharding.read_shards(spark, path, docs).collect()
    same([(r["doc_id"], r["text"]) for r in got], rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len((r["text"] or "").encode()) + 1
        assert r["grown_shard"] in (r["shard"], sharding.N_SHARDS)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    of = collections.defaultdict(set)
    for r in got:
        of[r["doc_id"]].add((r["shard"], r["grown_shard"]))
    assert all(len(s) == 1 for s in of.values())
    moved = sum(r["grown_shard"] == sharding.N_SHARDS for r in got)
    assert 0 < moved < len(got) / 4
    again = spark.read.parquet(sharding.write_shards(spark, docs.repartition(5), bucket_bytes=4 << 10))
    key = ["doc_id", "text", "shard", "slot"]
    same([tuple(r[k] for k in key) for r in again.collect() if r["doc_id"] != 7],
         [tuple(r[k] for k in key) for r in got if r["doc_id"] != 7])
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"])) if r["doc_id"] and r["doc_id"] >= 1000]
    assert order != sorted(order)


def test_files_are_in_slot_order_on_both_sides_of_the_broadcast_bound(spark):
    import glob

    import pyarrow.parquet as pq

    docs = table(spark, [(i, f"text {i}" * (1 + i % 9)) for i in range(600)])
    found = []
    for bound in (0, 100_000):
        path = sharding.write_shards(spark, docs, bucket_bytes=1 << 10, broadcast_buckets=bound)
        files = [pq.read_table(f).column("slot").to_pylist() for f in glob.glob(f"{path}/shard=*/*.parquet")]
        assert len(files) > sharding.N_SHARDS
        for slots in files:
            assert slots == list(range(slots[0], slots[0] + len(slots)))
        found.append(sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharding.read_shards(spark, path, docs).collect()))
    assert found[0] == found[1]


def test_shards_of_nothing(spark):
    docs = table(spark, [(1, "x")]).limit(0)
    back = sharding.read_shards(spark, sharding.write_shards(spark, docs), docs)
    assert back.count() == 0 and {"slot", "shard", "grown_shard", "size"} <= set(back.columns)


@pytest.mark.parametrize("text", ["", "é", "plain"])
def test_checksum_is_unsigned_utf8(spark, text):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.crc32(F.lit(text).cast("binary"))).first()[0] == zlib.crc32(text.encode())

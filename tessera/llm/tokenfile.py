"""Operator 7, token-id output: canonical length-limited Huffman blocks.

1. Documents are range-partitioned by id and encoded; each partition's ids
   (with the end id after every document) are written once, as bytes.
2. Global counts of the ids (at most one row per vocabulary entry) give code
   lengths of at most ``MAX_BITS`` bits by package-merge; codes are canonical,
   so the header holds lengths only.
3. Each partition packs its documents into independent blocks of about
   ``BLOCK_IDS`` ids: a bit stream plus the bit offset of every
   ``CHECK_EVERY``-th id. The file format is a Parquet dataset of blocks
   (``blocks``) and one header row (``header``), both in the shared folder.
4. Reading decodes all checkpoints of a block side by side through one lookup
   table of 2**MAX_BITS entries.

Defined cases: a null text has no ids but the end id; empty tables give a header
and no blocks; rows with equal ids stay together, ordered by text; a very long
document is a block of its own. Extra columns of the input are not stored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm import textcols as tc
from tessera.llm.shipping import ship
from tessera.session import ensure_checkpoint_dir

MAX_BITS = 16
BLOCK_IDS = 1 << 16
CHECK_EVERY = 256
SLICE_BYTES = 6 << 20
END_ID = 0

BLOCKS = "part int, block int, doc_ids binary, doc_null binary, lens binary, n_ids bigint, bits binary, checks binary"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for symbols with counts
    over 0 (package-merge); 0 for the others."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols need more than {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    n = len(leaf)
    levels = []                      # per level: is the item a leaf, in order of weight
    packages = np.zeros(0, np.int64)
    for _ in range(max_bits):
        weight = np.concatenate([leaf, packages])
        sort = np.argsort(weight, kind="stable")
        levels.append(sort < n)
        w = weight[sort]
        packages = w[:len(w) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * n - 2
    length = np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        m = int(is_leaf[:take].sum())
        length[:m] += 1              # the m lightest leaves are among the items taken
        take = 2 * (take - m)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint32)
    code = 0
    for bits in range(1, MAX_BITS + 1):
        code <<= 1
        at = np.flatnonzero(lengths == bits)
        codes[at] = code + np.arange(len(at))
        code += len(at)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bit stream (most significant bit first) and the bit offset of each id."""
    lens = lengths[ids].astype(np.int64)
    offs = np.cumsum(lens) - lens
    total = int(offs[-1] + lens[-1]) if len(ids) else 0
    words = np.zeros((total >> 5) + 3, np.uint64)
    if len(ids):
        word = offs >> 5
        value = codes[ids].astype(np.uint64) << (64 - (offs & 31) - lens).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        at = word[first]
        words[at] += np.add.reduceat(value >> np.uint64(32), first)       # bits of ids never overlap
        words[at + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes(), offs


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for every MAX_BITS-bit prefix."""
    codes = canonical(lengths)
    sym = np.zeros(1 << MAX_BITS, np.int32)
    bits = np.ones(1 << MAX_BITS, np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    n = np.left_shift(1, MAX_BITS - lengths[order].astype(np.int64))
    start = codes[order].astype(np.int64) << (MAX_BITS - lengths[order].astype(np.int64))
    idx = tc.ragged(start, n)
    sym[idx] = np.repeat(order, n)
    bits[idx] = np.repeat(lengths[order], n)
    return sym, bits


def unpack(raw: bytes, checks: np.ndarray, n_ids: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Ids of a block: one step decodes the next id after every checkpoint."""
    sym, bits = table
    data = np.frombuffer(raw, np.uint8)
    pos = checks.astype(np.int64).copy()
    out = np.zeros((CHECK_EVERY, len(pos)), np.int32)
    for step in range(min(CHECK_EVERY, n_ids)):
        b = pos >> 3
        b = np.minimum(b, len(data) - 3)         # past the end only after a last, short run
        window = (data[b].astype(np.int64) << 16) | (data[b + 1].astype(np.int64) << 8) | data[b + 2]
        peek = (window >> (8 - (pos & 7))) & 0xFFFF
        out[step] = sym[peek]
        pos += bits[peek]
    return out.T.reshape(-1)[:n_ids]


def write(spark: SparkSession, docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
          end_id: int = END_ID, out: str | None = None) -> str:
    """Write the token file of ``docs`` and return its folder."""
    ship(spark)
    out = out or f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")) \
        .repartitionByRange(parts, "k").sortWithinPartitions("k", "t")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, seq = bpe.load(path), TaskContext.get().partitionId(), 0
        kind = np.uint16 if tok.size <= 1 << 16 else np.uint32
        for b in batches:
            for lo, texts in bpe.text_lists(b.column(1), SLICE_BYTES):
                flat, offs = tok.encode(texts)
                flat = np.insert(flat, offs[1:], end_id)
                lens = np.diff(offs) + 1
                k = b.column(0).slice(lo, len(texts))
                keys = np.asarray(k.fill_null(0)).astype("<i8")
                hist = np.bincount(flat, minlength=tok.size)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                    "doc_ids": pa.array([keys.tobytes()]), "doc_null": pa.array([np.asarray(k.is_null()).tobytes()]),
                    "lens": pa.array([lens.astype("<i8").tobytes()]), "n_ids": pa.array([len(flat)], pa.int64()),
                    "ids": pa.array([flat.astype(kind).tobytes()]), "hist": pa.array([hist.astype("<i8").tobytes()])})
                seq += 1

    raw = f"{out}/raw"
    ordered.mapInArrow(encode, "part int, seq int, doc_ids binary, doc_null binary, lens binary, n_ids bigint, "
                               "ids binary, hist binary").write.parquet(raw)
    stored = spark.read.parquet(raw)
    size = bpe.load(path).size

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for h in b.column(0):
                total += np.frombuffer(h.as_buffer(), "<i8")
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(total[k])], ["id", "n"])

    counts = np.zeros(size, np.int64)          # one entry per id of the vocabulary
    for r in stored.select("hist").mapInArrow(add_up, "id int, n bigint").groupBy("id").agg(F.sum("n")).collect():
        counts[r[0]] = r[1]
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()), MAX_BITS, CHECK_EVERY, end_id)],
                          "lengths binary, max_bits int, check_every int, end_id int").write.parquet(f"{out}/header")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(lengths)
        kind = np.uint16 if size <= 1 << 16 else np.uint32
        for b in batches:
            for row in b.to_pylist():
                ids = np.frombuffer(row["ids"], kind)
                lens, keys = np.frombuffer(row["lens"], "<i8"), np.frombuffer(row["doc_ids"], "<i8")
                null = np.frombuffer(row["doc_null"], bool)
                ends, lo, block = np.cumsum(lens), 0, 0
                while lo < len(lens):
                    at = int(ends[lo] - lens[lo])
                    hi = max(lo + 1, int(np.searchsorted(ends, at + BLOCK_IDS, "right")))
                    bits, offs = pack(ids[at:ends[hi - 1]], lengths, codes)
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([row["part"]], pa.int32()),
                        "block": pa.array([(row["seq"] << 12) + block], pa.int32()),
                        "doc_ids": pa.array([keys[lo:hi].tobytes()]), "doc_null": pa.array([null[lo:hi].tobytes()]),
                        "lens": pa.array([lens[lo:hi].tobytes()]),
                        "n_ids": pa.array([int(ends[hi - 1]) - at], pa.int64()), "bits": pa.array([bits]),
                        "checks": pa.array([offs[::CHECK_EVERY].astype("<i8").tobytes()])})
                    lo, block = hi, block + 1

    stored.drop("hist").mapInArrow(compress, BLOCKS).write.parquet(f"{out}/blocks")
    return out


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_le32) of every document in the file;
    ``ids_le32`` holds the ids as little-endian unsigned 32-bit integers."""
    ship(spark)
    head = spark.read.parquet(f"{folder}/header").first()
    lengths = np.frombuffer(bytes(head["lengths"]), np.uint8)
    blocks = spark.read.parquet(f"{folder}/blocks")
    # ids before each block: within its part, and in all earlier parts (one row per part)
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    inside = sizes.withColumn("inside", F.sum("n_ids").over(W.partitionBy("part").orderBy("block")) - F.col("n_ids"))
    at = inside.join(before, "part").select("part", "block", (F.col("inside") + F.col("before")).alias("start"))
    placed = blocks.join(at, ["part", "block"]).select("start", "doc_ids", "doc_null", "lens", "n_ids", "bits", "checks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for b in batches:
            for i in range(len(b)):
                row = {n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)}
                lens = np.frombuffer(row["lens"], "<i8")
                ids = unpack(row["bits"], np.frombuffer(row["checks"], "<i8"), row["n_ids"], table)
                ends = np.cumsum(lens)
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(),
                             mask=np.frombuffer(row["doc_null"], bool)),
                    pa.array(ends - lens + row["start"]), pa.array(lens),
                    pa.array([raw[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), lens.tolist())], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_le32"])

    return placed.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_le32 binary")


def query(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    back = read(spark, write(spark, docs, path))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids_le32").alias("ids_crc32"))

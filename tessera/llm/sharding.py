"""Operator 9, sharding: two-pass external shuffle.

Pass 1 scatters the records by a seeded hash of their key into buckets small
enough for one task's memory; pass 2 puts each bucket in a canonical order,
Fisher-Yates shuffles it with a generator seeded by the bucket, and the rows
are written into their shard at the bucket's offset.

Law ``key``: the shard depends on ``doc_id`` and the number of shards only
(highest seeded hash among the shards), so one shard more takes rows only into
itself. The number of buckets follows the input's bytes, so a bucket stays near
``bucket_bytes`` at any size; equal texts have different keys and spread out.

Defined cases: a null text has size 1 and checksum 0; a null key hashes like
any value; rows repeated with one key share a shard and get slots of their own;
empty tables give no rows; clashing extra columns of the input are replaced.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shipping import ship
from tessera.session import ensure_checkpoint_dir

N_SHARDS = 16
SEED = 20240229
BUCKET_BYTES = 16 << 20
BROADCAST_BUCKETS = 100_000    # of (bucket, offset), 16 bytes each, that are broadcast


def shard_of(key: str, n_shards: int, seed: int = SEED):
    """Column: the shard with the highest seeded hash of the key (ties: the
    larger shard number)."""
    return F.greatest(*[F.struct(F.xxhash64(F.lit(seed), F.col(key), F.lit(s)).alias("h"), F.lit(s).alias("s"))
                        for s in range(n_shards)])["s"]


def write_shards(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text",
                 n_shards: int = N_SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES,
                 path: str | None = None, broadcast_buckets: int = BROADCAST_BUCKETS) -> str:
    """Write every row of ``docs`` to ``path`` (Parquet, partitioned by shard,
    rows in slot order inside each bucket file) and return the path. Rows learn
    their bucket's offset before the scatter, so that nothing comes between the
    shuffle of a bucket and its file at any number of buckets."""
    ship(spark)
    path = path or f"{ensure_checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    own = ["size", "shard", "bucket", "slot", "grown_shard"]
    rows = docs.select(*[c for c in docs.columns if c not in own]) \
        .withColumn("size", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")) \
        .withColumn("shard", shard_of(key, n_shards, seed)) \
        .withColumn("grown_shard", shard_of(key, n_shards + 1, seed))
    total = rows.agg(F.sum("size")).first()[0] or 1
    per_shard = max(1, math.ceil(total / n_shards / bucket_bytes))
    rows = rows.withColumn("bucket", (F.col("shard") * per_shard + F.pmod(
        F.xxhash64(F.lit(seed + 1), F.col(key), F.col("size")), F.lit(per_shard))).cast("int"))
    counts = rows.groupBy("bucket").count()          # one row per bucket
    offsets = counts.select("bucket", (F.sum("count").over(
        W.partitionBy(F.floor(F.col("bucket") / per_shard)).orderBy("bucket")) - F.col("count")).alias("offset"))
    n_buckets = n_shards * per_shard
    rows = rows.join(F.broadcast(offsets) if n_buckets <= broadcast_buckets else offsets, "bucket")
    # one bucket per partition: the buckets are dealt by their number, not by its hash
    scattered = rows.repartitionByRange(n_buckets, "bucket").sortWithinPartitions("bucket", key, text)
    names = scattered.columns
    at = names.index("bucket")

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            t = pa.Table.from_batches(held)
            b = t.column(at)[0].as_py()
            order = np.random.default_rng([seed, b]).permutation(len(t))    # Fisher-Yates
            t = t.take(pa.array(order)).append_column("at", pa.array(np.arange(len(t)), pa.int64()))
            held.clear()
            yield from t.to_batches(max_chunksize=10_000)

        for batch in batches:
            ids = batch.column(at).to_numpy()
            cuts = np.flatnonzero(np.diff(ids)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
                if held and held[0].column(at)[0].as_py() != int(ids[lo]):
                    yield from flush()
                held.append(batch.slice(lo, hi - lo))
        yield from flush()

    shuffled = scattered.mapInArrow(shuffle, scattered.withColumn("at", F.lit(0).cast("bigint")).schema)
    shuffled.withColumn("slot", F.col("offset") + F.col("at")).drop("offset", "at", "bucket") \
        .write.partitionBy("shard").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """The rows of the shard files of ``docs`` (also when there are none)."""
    own = {"size": "bigint", "grown_shard": "int", "slot": "bigint", "shard": "int"}
    schema = docs.select(*[c for c in docs.columns if c not in own and c != "bucket"]) \
        .withColumns({c: F.lit(None).cast(t) for c, t in own.items()}).schema
    return spark.read.schema(schema).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = read_shards(spark, write_shards(spark, docs), docs)
    return back.select(
        "doc_id", "size", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.col("grown_shard").cast("int").alias("grown_shard"))

"""S3 / S4 with a staged commit: readers see the old data or the new, never half.

``stage`` writes the rows into a folder of their own, which no reader follows, and
reads them back once for the row count and a checksum; ``publish`` then adds one
line to ``_manifests``, a single file that the write moves into place when it is
complete. Readers follow the newest manifest only. So a writer that is lost before
``publish`` leaves what was there, and one that is lost afterwards leaves the new
data. Old versions stay until their owner removes them. Nothing is gathered but one
row of counts; everything goes through Spark's readers and writers, on any file
system.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDER, MANIFESTS = "_versions", "_manifests"
MANIFEST_SCHEMA = "version bigint, folder string, fmt string, n_rows bigint, checksum string, schema string, partitions array<string>"


@dataclass
class Manifest:
    version: int
    folder: str              # below the output folder
    fmt: str                 # json or parquet
    n_rows: int
    checksum: str            # of the rows in any order
    schema: str
    partitions: list[str]


def checksum(df: DataFrame) -> tuple[int, str]:
    """(rows, order-independent checksum): one aggregation. Two sums of hashes of
    the row as JSON, so that rows may hold any type and a lost, added, doubled or
    changed row shows."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    part = [F.sum(F.xxhash64(row, F.lit(k)).cast("decimal(38,0)")) for k in (1, 2)]
    n, a, b = df.agg(F.count(F.lit(1)), *part).first()
    return n, f"{a or 0}/{b or 0}"


def _published(spark: SparkSession, out_dir: str) -> list[Manifest]:
    """Manifests, oldest first (none if nothing was published)."""
    try:
        found = spark.read.schema(MANIFEST_SCHEMA).json(os.path.join(out_dir, MANIFESTS))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [Manifest(**r.asDict()) for r in found.orderBy("version", "folder").collect()]


def current(spark: SparkSession, out_dir: str) -> Manifest | None:
    """The newest manifest."""
    return next(reversed(_published(spark, out_dir)), None)


def _read(spark: SparkSession, out_dir: str, m: Manifest) -> DataFrame:
    return spark.read.schema(T.StructType.fromJson(json.loads(m.schema))).format(m.fmt).load(os.path.join(out_dir, m.folder))


def stage(df: DataFrame, out_dir: str, fmt: str = "json", partitions: tuple[str, ...] = ()) -> Manifest:
    """Write ``df`` unseen, and describe what was written."""
    spark, last = df.sparkSession, current(df.sparkSession, out_dir)
    folder = f"{FOLDER}/{uuid.uuid4().hex}"
    options = {"ignoreNullFields": "false"} if fmt == "json" else {}
    df.write.format(fmt).options(**options).partitionBy(*partitions).save(os.path.join(out_dir, folder))
    # partition columns come last when read back
    schema = T.StructType([f for f in df.schema if f.name not in partitions] + [df.schema[p] for p in partitions])
    m = Manifest(1 + (last.version if last else 0), folder, fmt, 0, "", schema.json(), list(partitions))
    m.n_rows, m.checksum = checksum(_read(spark, out_dir, m))
    return m


def publish(spark: SparkSession, out_dir: str, manifest: Manifest) -> None:
    """Let readers follow a staged version: one file appears. Of writers that
    staged on the same version, the last folder name wins for all readers."""
    spark.createDataFrame([asdict(manifest)], MANIFEST_SCHEMA).coalesce(1) \
        .write.mode("append").json(os.path.join(out_dir, MANIFESTS))


def write(df: DataFrame, out_dir: str, fmt: str = "json", partitions: tuple[str, ...] = ()) -> Manifest:
    m = stage(df, out_dir, fmt, partitions)
    publish(df.sparkSession, out_dir, m)
    return m


class Damaged(RuntimeError):
    """The data is not what the manifest says."""


def read(spark: SparkSession, out_dir: str, verify: bool = False) -> DataFrame:
    """The published rows; with ``verify`` they are counted and summed first."""
    m = current(spark, out_dir)
    if m is None:
        raise FileNotFoundError(f"nothing is published in {out_dir}")
    df = _read(spark, out_dir, m)
    if verify:
        found = checksum(df)
        if found != (m.n_rows, m.checksum):
            raise Damaged(f"{out_dir}: version {m.version} has {found}, its manifest says {(m.n_rows, m.checksum)}")
    return df

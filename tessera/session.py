"""SparkSession construction and the shared query parameters."""

from __future__ import annotations

import datetime as _dt
import os
import tempfile

from pyspark.sql import SparkSession

# Reference date that replaces now(): one day before max(o_orderdate) at every
# driver scale factor, so "this month" is a full July 2001.
AS_OF = _dt.date(2001, 7, 31)
AS_OF_SQL = "DATE '2001-07-31'"


def _base_conf() -> dict[str, str]:
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        # Runtime re-planning: coalesce small shuffles, split skewed partitions,
        # convert sort-merge to broadcast when the *measured* side is small.
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }


def _is_local(master: str | None) -> bool:
    # not local-cluster[...]: its executors are processes of their own, as on a cluster
    return bool(master) and (master == "local" or master.startswith("local["))


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tessera", extra: dict | None = None) -> SparkSession:
    """Return (or create) a SparkSession with the engine's settings.

    On a cluster the master, resources and the shuffle partition count come
    from spark-submit (AQE coalesces / splits shuffle partitions at run
    time); only SQL behaviour settings are forced here. Locally the shuffle
    partition count defaults to 2 x cores.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = _base_conf()
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if _is_local(master):
        if shuffle_partitions is None:
            cores = master[len("local["):-1] if master.startswith("local[") else "1"
            n = os.cpu_count() if cores in ("*", "") else int(cores)
            conf["spark.sql.shuffle.partitions"] = str(2 * max(1, n or 1))
        conf.setdefault("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEM", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and scratch output: the cluster's
    ``spark.checkpoint.dir``. Only a local-mode session (tests) without the
    setting gets a fresh folder of its own; on a cluster a machine-local
    folder would be wrong, so its absence is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not _is_local(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="tessera-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d

"""Sinks (S3, S4, S7): distributed writers. Nothing is gathered on the
driver; every output is written by the executors in parallel."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared ``spark.checkpoint.dir`` (never a
    machine-local temp folder on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tessera-out", f"{name}-{uuid.uuid4().hex[:12]}")


def write_jsonl(split_df: DataFrame, out_dir: str, split_col: str = "split") -> str:
    """S3: train / validation as JSON lines, one folder per split
    (``split=train``, ``split=validation``) from a single pass."""
    split_df.write.mode("overwrite").partitionBy(split_col).json(out_dir)
    return out_dir


def write_eval_results(results: DataFrame, out_dir: str, fmt: str = "json") -> str:
    """Per-case evaluation records (nested struct / arrays) as JSON or
    Parquet."""
    w = results.write.mode("overwrite")
    (w.json(out_dir) if fmt == "json" else w.parquet(out_dir))
    return out_dir


def eval_record(df: DataFrame) -> DataFrame:
    """S4 record shape: name, status, generated SQL, metrics{...}, keyword
    lists, errors[]."""
    errors = F.filter(F.array("validation_error", "execution_error", "error"), lambda e: e.isNotNull())
    return df.select(
        F.col("query_index").alias("test_case"), "name", "domain", "complexity", "status", F.col("sql").alias("generated_sql"),
        F.struct(F.col("is_valid").alias("is_syntactically_valid"), F.col("is_executable"),
                 F.col("keyword_score").alias("keyword_match_score")).alias("metrics"),
        "keywords_found", "keywords_missing", errors.alias("errors"))

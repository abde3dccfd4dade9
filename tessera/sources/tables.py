"""Readers for the driver tables and corpus files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazily scan one driver table. Column pruning and filter pushdown reach
    the Parquet reader through Catalyst; nothing is cached here."""
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register_views(spark: SparkSession, sf_dir: str, names=TABLES, prefix: str = "") -> None:
    """Expose tables as temp views for ``spark.sql``."""
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(prefix + n)


# Raw text-to-SQL sample record: six strings plus our stable row key.
SAMPLE_SCHEMA = T.StructType([
    T.StructField("sample_id", T.LongType()),
    T.StructField("sql_context", T.StringType()),
    T.StructField("sql_prompt", T.StringType()),
    T.StructField("sql", T.StringType()),
    T.StructField("sql_explanation", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("sql_complexity", T.StringType()),
])


def load_samples(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Load a corpus with an explicit schema (no inference).

    A JSON-lines file of user samples may omit fields; missing fields read as
    NULL and the formatting operators apply the reference defaults.
    A file without ``sample_id`` gets one from ``monotonically_increasing_id``,
    which is stable for a given input file layout.
    """
    if fmt == "json":
        df = spark.read.schema(SAMPLE_SCHEMA).json(path)
    else:
        df = spark.read.parquet(path)
        for f in SAMPLE_SCHEMA.fields:
            if f.name not in df.columns:
                df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in SAMPLE_SCHEMA.fields])
    if fmt == "json":
        df = df.withColumn("sample_id", F.coalesce("sample_id", F.monotonically_increasing_id()))
    return df

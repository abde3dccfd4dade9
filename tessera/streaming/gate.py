"""ST1: the response gate (R8) on an arriving response log.

The batch operator is a pure per-row projection, so the streaming version
is the same column expressions over ``readStream``: no state, no
watermark. The sink is file-based with a checkpoint in the shared
checkpoint folder, so a restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.responses import gate_responses


def gate_stream(stream: DataFrame, response: str = "response") -> DataFrame:
    """R8 over a streaming DataFrame (identical expressions to batch)."""
    return gate_responses(stream, response)


def run_available(spark: SparkSession, gated: DataFrame, out_dir: str) -> StreamingQuery:
    """Process everything currently available, then stop (``availableNow``)."""
    q = (gated.writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", os.path.join(out_dir, "_checkpoint"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q

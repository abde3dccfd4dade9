"""Bindings for the streaming queries over the documents Parquet source: the
response gate (ST1) and the attempts of a prompt (R6). Their output must equal the
batch operators', so the oracles are those of the batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans import fixtures as FX
from tessera.plans import register
from tessera.plans.responses import _GATE, RESOLVED, RESP, prompt_text
from tessera.sources import sinks as SK
from tessera.sources.tables import table
from tessera.streaming import attempts as SA
from tessera.streaming import gate as SG


def _documents(spark, d, **options):
    # a table is one file or a folder of files; as a pattern the path may be either
    # (a plain path to a stream must be a folder)
    schema = table(spark, d, "documents").schema
    return spark.readStream.schema(schema).options(**options).parquet(f"{d}/{{documents}}.parquet")


@register("stream_attempts", RESOLVED)
def stream_attempts(spark, d):
    # files are in no order of event time: all of them are one batch, else the watermark
    # of one drops the rows of the next
    s = FX.samples_from(_documents(spark, d)).withColumn("prompt", prompt_text())
    arriving = FX.attempts_from(FX.responses_from(s, "prompt"), "prompt") \
        .withColumn("event_time", F.timestamp_seconds(F.col("prompt_id") * 60 + F.col("attempt")))
    out = SK.scratch_path(spark, "stream_attempts")
    SA.write_available(spark, SA.resolve_attempt_stream(arriving, prompt="prompt"), f"{out}/decided", f"{out}/checkpoint")
    return spark.read.schema("prompt_id bigint, outcome string, decided_by_attempt int, response string").parquet(f"{out}/decided")


@register("stream_gate", RESP + _GATE)
def stream_gate(spark, d):
    src = _documents(spark, d, maxFilesPerTrigger=1)
    gated = SG.gate_stream(FX.responses_from(FX.samples_from(src)).select("sample_id", "response"))
    out = SK.scratch_path(spark, "stream_gate")
    SG.run_available(spark, gated, out)
    return spark.read.schema(gated.schema).parquet(out)

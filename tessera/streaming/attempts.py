"""R6 on a stream: attempts resolved as they arrive.

State per prompt holds the attempts seen so far. A prompt is decided, and its row
emitted, as soon as the outcome cannot change any more: a good attempt with every
earlier one seen, or all ``max_attempts`` seen. Otherwise an event-time timer,
``time_out`` after the prompt's first attempt, decides with what is there. The row
is the one that batch R6 gives for the attempts it was decided on.

A decided prompt keeps a marker without texts until that timer, so attempts that
still come are ignored; the marker then goes, which bounds the state by the prompts
of one time-out and the watermark's delay. Rows behind the watermark are dropped by
Spark. The first arrival of an attempt number counts, later ones of it are ignored.
A call of Python for each prompt took some milliseconds, whatever it did, so the
prompts of a hash group share one state value and one call a batch; each still has
its own timer, and the group's is the earliest of them.
Checkpoint and state lie in the folder the caller names, so a restarted query goes
on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions import text as TX
from tessera.operators.responses import MAX_ATTEMPTS
from tessera.shipping import ship

GOOD, LOOP, NOTHING = 0, 1, 2          # what an attempt came to
# of the prompts of a group, side by side
STATE = ("keys array<string>, until array<bigint>, decided array<boolean>, attempts array<array<int>>, kinds array<array<int>>, "
         "responses array<string>, good array<int>, sql_prompts array<boolean>")
GROUPS = 1 << 12                       # a checkpoint goes on with the number it began with


def _decide(attempts: list[int], kinds: list[int], response: str | None, good: int | None, sql_prompt: bool | None,
            final: bool, max_attempts: int) -> tuple | None:
    """(outcome, decided_by_attempt, response) once it stands, else None."""
    if good is not None and (final or set(range(1, good)) <= set(attempts)):
        return "ok", good, response
    if not final and not set(range(1, max_attempts + 1)) <= set(attempts):
        return None
    if good is not None:
        return "ok", good, response
    last = max(range(len(attempts)), key=attempts.__getitem__)
    if kinds[last] != LOOP:
        return "none", attempts[last], None
    text = None if sql_prompt is None else TX.FALLBACK_SQL_TEXT if sql_prompt else TX.FALLBACK_ERROR_TEXT
    return "fallback", attempts[last], text


def _as_text(kind: str) -> tuple:
    """Functions of a column of a type that give its text, and the value again."""
    if kind == "binary":
        return F.hex, F.unhex
    if kind == "timestamp":
        return (lambda c: F.unix_micros(c).cast("string")), (lambda c: F.timestamp_micros(c.cast("bigint")))
    return (lambda c: c.cast("string")), (lambda c: c.cast(kind))


def resolve_attempt_stream(attempts: DataFrame, key: str = "prompt_id", event_time: str = "event_time", prompt: str | None = None,
                           delay: str = "10 minutes", time_out_seconds: int = 600, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(key, outcome, decided_by_attempt, response) of a stream of (key, attempt,
    response, event_time) rows, optionally with ``error`` and the prompt's text."""
    r = TX.strip(F.coalesce(F.col("response"), F.lit("")))
    failed = F.col("error").isNotNull() if "error" in attempts.columns else F.lit(False)
    kind = F.when(failed | (F.col("_r") == ""), NOTHING).when(TX.is_token_loop(F.col("_r")), LOOP).otherwise(GOOD)
    # a loop with an error counts as an error, like in the batch operator
    asks_sql = TX.fallback_response(F.col(prompt)) == F.lit(TX.FALLBACK_SQL_TEXT) if prompt else F.lit(None).cast("boolean")
    # as text: a null among whole numbers would make them floats in pandas
    kind_of_key = attempts.schema[key].dataType.simpleString()
    coded, back = _as_text(kind_of_key)
    rows = attempts.withColumn("_r", r).select(
        F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int").alias("_group"), coded(F.col(key)).alias("_key"),
        F.col(event_time).alias("_t"), F.col("attempt").cast("int").alias("_attempt"), kind.cast("int").alias("_kind"),
        F.when(kind == GOOD, F.col("_r")).alias("_text"), asks_sql.alias("_asks_sql")).withWatermark("_t", delay)
    kept_ms = time_out_seconds * 1000

    def update(ident: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = {k: [until, decided, list(seen), list(kinds), *rest]
                for k, until, decided, seen, kinds, *rest in zip(*state.get)} if state.exists else {}
        touched = set()
        if not state.hasTimedOut:
            came = pd.concat(list(batches)).sort_values(["_t", "_attempt"], kind="stable")
            for k, t, a, kind, text, asks in zip(*(came[c] for c in ("_key", "_t", "_attempt", "_kind", "_text", "_asks_sql"))):
                if k not in held:
                    held[k] = [int(t.value // 1_000_000) + kept_ms, False, [], [], None, None, None]
                touched.add(k)
                _, decided, seen, kinds, _, good, _ = p = held[k]
                if decided or pd.isna(a) or int(a) in seen:
                    continue
                seen.append(int(a))
                kinds.append(int(kind))
                if asks is not None and not pd.isna(asks):
                    p[6] = bool(asks)
                if kind == GOOD and (good is None or a < good):
                    p[4:6] = text, int(a)
        out = []
        for k in touched if touched and not any(p[0] < now for p in held.values()) else list(held):
            until, decided, seen, kinds, response, good, sql_prompt = p = held[k]
            over = k not in touched
            if over and until >= now:
                continue
            row = None if decided or not seen else _decide(seen, kinds, response, good, sql_prompt, over, max_attempts)
            if row is not None:
                out.append((k, *row))
            if over:
                del held[k]
            else:
                p[0] = max(until, now + 1)
                if row is not None:
                    p[1:6] = True, [], [], None, None
        if held:
            state.update(tuple(map(list, zip(*([k, *p] for k, p in held.items())))))
            state.setTimeoutTimestamp(max(now + 1, min(p[0] for p in held.values())))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["_key", "outcome", "decided_by_attempt", "response"])

    ship(attempts.sparkSession)
    return rows.groupBy("_group").applyInPandasWithState(
        update, "_key string, outcome string, decided_by_attempt int, response string", STATE, "append",
        GroupStateTimeout.EventTimeTimeout) \
        .select(back(F.col("_key")).alias(key), "outcome", "decided_by_attempt", "response")


def write_available(spark: SparkSession, resolved: DataFrame, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, append the decided prompts to Parquet, then stop."""
    q = (resolved.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q

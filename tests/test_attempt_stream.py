"""Attempts resolved on a stream equal the batch operator, across restarts."""

import datetime as dt
import random
import tempfile

from tessera.operators import responses as R
from tessera.streaming import attempts as A

SCHEMA = "prompt_id bigint, attempt int, response string, error string, event_time timestamp, prompt string"
START = dt.datetime(2024, 1, 1)
LOOP = "<|im_end|>" * 6
PROMPTS = ["please get rows", "write a poem"]


def at(second):
    return START + dt.timedelta(seconds=second)


def folder(name):
    return tempfile.mkdtemp(prefix=f"{name}-", dir="/tmp")


def arrive(spark, rows, path):
    """One more file of the source."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, out, checkpoint, **options):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    A.write_available(spark, A.resolve_attempt_stream(source, prompt="prompt", **options), out, checkpoint)
    return sorted(map(tuple, spark.read.parquet(out).collect()))


def batch(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    prompts = df.select("prompt_id", "prompt").distinct()
    return sorted(map(tuple, R.resolve_attempts(df.drop("prompt"), prompts).collect()))


def row(p, a, text, second, error=None):
    return (p, a, text, error, at(second), PROMPTS[p % 2])


def test_equals_batch_after_a_restart(spark):
    rng = random.Random(2)
    rows = [row(p, a, rng.choice(["", "  ok  ", "SELECT 1;", LOOP, None]), 10 * p + a, rng.choice([None, None, "failed"]))
            for p in range(40) for a in (1, 2, 3)]
    src, out, ck = folder("src"), folder("out"), folder("ck")
    mixed = rows[:]
    rng.shuffle(mixed)                       # attempts of a prompt arrive in any order, in different files
    for part in (mixed[:40], mixed[40:80]):
        arrive(spark, part, src)
    first = run(spark, src, out, ck, delay="1 hour", time_out_seconds=3600)
    arrive(spark, mixed[80:], src)           # the query ended in mid-stream and starts again
    whole = run(spark, src, out, ck, delay="1 hour", time_out_seconds=3600)
    assert len(first) < len(whole) and set(first) <= set(whole)
    assert whole == batch(spark, rows)


def test_time_out_late_and_repeated_attempts(spark):
    src, out, ck = folder("src"), folder("out"), folder("ck")
    options = {"delay": "10 seconds", "time_out_seconds": 60}
    early = [row(1, 1, "", 0), row(2, 1, LOOP, 0), row(3, 2, "second", 0), row(4, 1, "good", 0), row(5, 1, LOOP, 1), row(5, 2, "", 2),
             row(7, 2, "good", 3), row(8, 1, "", 0), row(8, 1, "not the first", 0)]
    arrive(spark, early, src)
    # 4 is decided by its first attempt; 7 waits for its first
    assert [r[0] for r in run(spark, src, out, ck, **options)] == [4]
    arrive(spark, [row(4, 2, "too late", 5), row(7, 1, "", 6), row(9, 1, "", 500)], src)      # 500: time passes
    run(spark, src, out, ck, **options)
    arrive(spark, [row(1, 2, "behind the watermark", 20), row(10, 1, "x", 501)], src)
    got = run(spark, src, out, ck, **options)
    kept = early[:-1] + [row(7, 1, "", 6), row(10, 1, "x", 501)]
    want = [r for r in batch(spark, kept) if r[0] != 9]
    assert got == want and {r[0]: r[1] for r in got} == {1: "none", 2: "fallback", 3: "ok", 4: "ok", 5: "none", 7: "ok", 8: "none", 10: "ok"}


def test_decisions():
    assert A._decide([2], [A.GOOD], "x", 2, None, False, 3) is None
    assert A._decide([2, 1], [A.GOOD, A.LOOP], "x", 2, None, False, 3) == ("ok", 2, "x")
    assert A._decide([3, 1, 2], [A.LOOP, A.NOTHING, A.NOTHING], None, None, True, False, 3)[:2] == ("fallback", 3)
    assert A._decide([1], [A.LOOP], None, None, None, True, 3) == ("fallback", 1, None)
    assert A._decide([1, 2], [A.LOOP, A.NOTHING], None, None, True, True, 3) == ("none", 2, None)


def test_prompts_of_a_group_share_state_and_keep_their_own_timers(spark, monkeypatch):
    monkeypatch.setattr(A, "GROUPS", 2)
    big = 2 ** 60                            # keys beyond the whole numbers of floats
    src, out, ck = folder("src"), folder("out"), folder("ck")
    options = {"delay": "1 second", "time_out_seconds": 60}

    def run_on():
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        q = A.write_available(spark, A.resolve_attempt_stream(source, prompt="prompt", **options), out, ck)
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 2     # a value for each group, not each prompt
        return {r["prompt_id"] for r in spark.read.parquet(out).collect()}

    # of each three prompts the second has a loop and nothing, the others a good attempt
    early = [row(big + p, a, ["", "good", LOOP][(p + a) % 3], p) for p in range(30) for a in (1, 2)]
    good = {r[0] for r in early if r[2] == "good"}
    arrive(spark, [*early, (None, 1, "keyless", None, at(3), "get")], src)
    assert run_on() == good | {None}
    # time passes, then the same groups get rows: 1, 4 and 7 time out, the others still wait
    late = row(big + 28, 3, "late but in time", 70)
    arrive(spark, [late], src)
    more = [row(big + p, 1, "more", 71) for p in range(100, 120)]
    arrive(spark, more, src)
    assert run_on() == good | {None, big + 1, big + 4, big + 7, big + 28} | {r[0] for r in more}
    last = row(big + 200, 1, "x", 200)
    arrive(spark, [last], src)
    run_on()
    got = spark.read.parquet(out).filter("prompt_id IS NOT NULL").collect()
    assert sorted(map(tuple, got)) == batch(spark, [*early, late, *more, last])

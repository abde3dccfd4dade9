"""Damaged corpus files are accounted for line by line; published data is old or
new, never half."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import published as P
from tessera.sources import quarantine as Q
from tessera.sources.tables import SAMPLE_SCHEMA

GOOD = {"sample_id": 1, "sql": "SELECT 1", "sql_prompt": "p", "domain": None}
LINES = [
    (json.dumps(GOOD), "sample"),
    (json.dumps({**GOOD, "extra": {"a": [1, 2]}, "more": "x"}), "sample"),
    ("﻿" + json.dumps({"sql": "with a mark"}), "sample"),
    ("{}", "sample"),
    ('{"sql": "a \\u0000 \\ud83d\\ude00"}', "sample"),
    ("", Q.BLANK_LINE), (" \t ", Q.BLANK_LINE),
    ('{"sql": "cut off', Q.BAD_JSON), ("not json at all", Q.BAD_JSON), ('{"sql": "a"} {"sql": "b"}', Q.BAD_JSON),
    ('{"sql": "a", "sql": "b"}', Q.BAD_JSON), ("{'sql': 'a',}", Q.BAD_JSON),
    ("[1, 2]", Q.NOT_AN_OBJECT), ('"text"', Q.NOT_AN_OBJECT), ("17", Q.NOT_AN_OBJECT), ("null", Q.NOT_AN_OBJECT),
    ('{"sql": 5}', Q.WRONG_TYPE + "sql"), ('{"sql": ["a"], "domain": true}', Q.WRONG_TYPE + "sql, domain"),
    ('{"sample_id": "7"}', Q.WRONG_TYPE + "sample_id"), ('{"sample_id": 1.5}', Q.WRONG_TYPE + "sample_id"),
    ('{"sql_prompt": {"text": "p"}}', Q.WRONG_TYPE + "sql_prompt"),
    ('{"sql": "bad bytes �"}', Q.BAD_ENCODING),
]


def test_every_line_is_accounted_for(spark):
    path = tempfile.mkdtemp(prefix="lines-", dir="/tmp")
    with open(os.path.join(path, "a.jsonl"), "w", encoding="utf-8") as f:
        f.write("\n".join(t for t, _ in LINES) + "\n")
    with open(os.path.join(path, "b.jsonl"), "wb") as f:
        f.write(b'{"sql": "\xff\xfe"}\r\n{"sql": "fine"}\r\n')
    got = Q.load_lines(spark, path)
    rows = {r.line: r for r in got.collect()}
    for text, reason in LINES:
        assert (rows[text].reason or "sample") == reason, text
    counts = {r.reason: (r.n, r.n_rescued) for r in Q.account(got).collect()}
    assert sum(n for n, _ in counts.values()) == len(LINES) + 2 == got.count()
    assert counts["sample"] == (6, 1) and counts[Q.BAD_ENCODING] == (2, 0)
    extra = rows[LINES[1][0]]
    assert {k: json.loads(v) if v[0] in "{[" else v for k, v in json.loads(extra.rescued).items()} == {"extra": {"a": [1, 2]}, "more": "x"}
    assert (extra.sample_id, extra.sql, extra.domain) == (1, "SELECT 1", None)
    samples = Q.samples_of(got)
    assert samples.columns == SAMPLE_SCHEMA.names and samples.count() == 6
    assert all(getattr(r, n) is None for r in rows.values() if r.reason for n in SAMPLE_SCHEMA.names)


def test_no_lines(spark):
    none = Q.classify(spark.createDataFrame([], "value string"))
    assert Q.account(none).collect() == [] and Q.samples_of(none).collect() == []
    assert Q.classify(spark.createDataFrame([(None,)], "value string")).first().reason == Q.BLANK_LINE


def out_dir():
    return os.path.join(tempfile.mkdtemp(prefix="published-", dir="/tmp"), "out")


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_old_or_new(spark, fmt):
    out = out_dir()
    df = spark.range(100).select("id", F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).alias("t"), F.array("id").alias("a"),
                                 F.when(F.col("id") < 80, "train").otherwise("test").alias("split"))
    with pytest.raises(FileNotFoundError):
        P.read(spark, out)
    assert P.write(df, out, fmt, ("split",)).version == 1
    same = P.read(spark, out, verify=True).select(*df.columns)
    assert sorted(map(str, same.collect())) == sorted(map(str, df.collect()))
    staged = P.stage(df.filter("id < 10"), out, fmt, ("split",))       # the writer stops here
    assert P.read(spark, out, verify=True).count() == 100 and staged.n_rows == 10
    P.publish(spark, out, staged)                                       # or it does not
    assert P.read(spark, out, verify=True).count() == 10 and P.current(spark, out).version == 2
    P.write(df.limit(0), out, fmt, ("split",))
    assert P.read(spark, out, verify=True).count() == 0


def test_a_half_written_manifest_is_not_followed(spark):
    out = out_dir()
    P.write(spark.range(5).toDF("x"), out)
    # what a lost job leaves behind: task output that was never committed
    left = os.path.join(out, P.MANIFESTS, "_temporary", "0", "_temporary", "attempt", "part-0.json")
    os.makedirs(os.path.dirname(left))
    with open(left, "w") as f:
        f.write('{"version": 9, "folder": "nowhere"')
    assert P.read(spark, out).count() == 5


def test_damage_shows(spark):
    df = spark.range(20).select("id", F.lit("a").alias("t"))
    n, total = P.checksum(df)
    assert (n, total) == P.checksum(df.repartition(7)) and n == 20
    for other in (df.filter("id > 0"), df.union(df.limit(1)), df.withColumn("t", F.when(F.col("id") == 3, "b").otherwise("a")),
                  df.withColumn("t", F.when(F.col("id") != 3, "a"))):
        assert P.checksum(other) != (n, total)
    out = out_dir()
    m = P.write(df, out, "parquet")
    spark.range(1).select("id", F.lit("z").alias("t")).write.mode("append").parquet(os.path.join(out, m.folder))
    with pytest.raises(P.Damaged):
        P.read(spark, out, verify=True)

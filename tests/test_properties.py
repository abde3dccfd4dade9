"""Property checks of the corpus split and the batch/stream gate."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from tessera.operators import corpus as C
from conftest import SF_MID


def test_stratified_split_exact_sizes(spark):
    s = E.queries()["stratified_split"](spark, SF_MID)
    rows = s.groupBy("split", "complexity").count().collect()
    val = {r.complexity: r["count"] for r in rows if r.split == "validation"}
    total = {r.complexity: 0 for r in rows}
    for r in rows:
        total[r.complexity] += r["count"]
    n = sum(total.values())
    assert sum(val.values()) == -(-n // 10)
    assert val == {"de": 13, "en": 62, "es": 11, "fr": 14}
    for k, v in val.items():
        assert abs(v - total[k] * sum(val.values()) / n) < 1
    assert s.select("sample_id").distinct().count() == n


def test_random_split_fallback_small(spark):
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(20)], "sample_id long, complexity string")
    out = C.quota_split(df, "sample_id", "complexity")
    assert out.filter(F.col("split") == "validation").count() == 2   # ceil(0.1 * 20), not stratified


def test_split_large_bucket_path(spark):
    df = spark.range(0, 20000).select(F.col("id").alias("sample_id"),
                                      F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("c"))
    out = C.quota_split(df, "sample_id", "c").cache()
    v = {r.c: r["count"] for r in out.filter(F.col("split") == "validation").groupBy("c").count().collect()}
    assert v == {"hot": 667, "cold": 1333}
    # identical membership to the plain rank-by-key definition
    from pyspark.sql import Window
    w = Window.partitionBy("c").orderBy(C.split_key("sample_id"), "sample_id")
    ref = df.withColumn("rn", F.row_number().over(w)).withColumn(
        "q", F.when(F.col("c") == "hot", 667).otherwise(1333)).filter(F.col("rn") <= F.col("q"))
    got = out.filter(F.col("split") == "validation").select("sample_id")
    assert ref.select("sample_id").subtract(got).count() == 0 and got.count() == 2000


def test_stream_equals_batch(spark):
    q = E.queries()
    a = q["stream_gate"](spark, SF_MID)
    b = q["gate_responses"](spark, SF_MID)
    cols = sorted(b.columns)
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0
    assert b.select(cols).exceptAll(a.select(cols)).count() == 0


def test_stream_reads_a_table_of_several_files(spark, tmp_path):
    """``documents`` is one file or a folder of files, in no order of time."""
    docs = spark.createDataFrame(
        [(i, f"select {i} from t{i}" if i % 3 else f"text {i}", "en", f"src{i % 4}", 10) for i in range(200)],
        "doc_id long, text string, lang string, source string, n_chars int")
    docs.repartition(5, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    q = E.queries()
    for stream, batch in (("stream_gate", "gate_responses"), ("stream_attempts", "resolve_attempts")):
        a, b = q[stream](spark, str(tmp_path)), q[batch](spark, str(tmp_path))
        cols = sorted(b.columns)
        assert a.count() == 200
        assert a.select(cols).exceptAll(b.select(cols)).count() == 0


def test_sinks_write_every_row(spark):
    q = E.queries()
    assert q["write_jsonl"](spark, SF_MID).count() == 1000
    assert q["write_eval_results"](spark, SF_MID).count() == 399


def test_chat_offsets_blocked_prefix(spark):
    df = spark.range(0, 3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
                                     F.lit("user").alias("role"), F.lit("ab").alias("text"))
    seglen = len("<|im_start|>user\nab<|im_end|>\n")
    got = [r.char_offset for r in C.chat_turns(df, block=7).orderBy("turn").collect()]
    assert got == [i * seglen for i in range(3000)]


def test_topk_per_group_hot_group_equals_plain_window(spark):
    from pyspark.sql import Window
    from tessera.operators import analytics as A
    df = spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("g"),
        F.col("id"), ((F.col("id") * 7919) % 1000).alias("v"))
    got = A.topk_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 5, salt_on=["id"])
    w = Window.partitionBy("g").orderBy(F.col("v").desc(), F.col("id"))
    ref = df.withColumn("rank", F.row_number().over(w).cast("bigint")).filter("rank <= 5")
    cols = ["g", "id", "v", "rank"]
    assert got.select(cols).exceptAll(ref.select(cols)).count() == 0
    assert ref.select(cols).exceptAll(got.select(cols)).count() == 0


def test_top1_aggregation_equals_window(spark):
    from pyspark.sql import Window
    from tessera.operators import analytics as A
    df = spark.range(0, 20000).select((F.col("id") % 7).alias("g"), F.col("id"),
                                      ((F.col("id") * 31) % 97).cast("double").alias("q"))
    got = A.top1_per_group(df, ["g"], [("q", False), ("id", True)])
    w = Window.partitionBy("g").orderBy(F.col("q").desc(), F.col("id"))
    ref = df.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    assert got.select("g", "id", "q").exceptAll(ref.select("g", "id", "q")).count() == 0
    assert got.count() == 7


def test_split_keeps_null_labels(spark):
    df = spark.range(100).select(F.col("id").alias("sample_id"),
                                 F.when(F.col("id") % 4 != 0, F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))).alias("label"))
    out = C.quota_split(df, "sample_id", "label")
    assert out.count() == 100 and out.filter("label IS NULL").count() == 25
    assert out.filter("split = 'validation'").count() == 10


def test_quotas_beyond_64_bits(spark):
    counts = spark.createDataFrame([("=a", 3 * 10**10), ("=b", 2 * 10**10), ("null", 7)], "_l string, n_c bigint")
    got = {r["stratum"]: r["quota"] for r in C._quotas(counts, 0.1).collect()}
    assert got == {"=a": 3 * 10**9, "=b": 2 * 10**9, "null": 1}


def test_left_join_with_a_hot_right_key(spark):
    from tessera.operators import analytics as A
    left = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    right = spark.range(1000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % 30).alias("rk"), F.col("id").alias("y"))
    got = A.left_join_hot_right(left, right, "k", "rk").select("k", "x", "y")
    want = left.join(right, left["k"] == right["rk"], "left").select("k", "x", "y")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0

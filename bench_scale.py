"""Throughput of the corpus pipeline on a replicated corpus.

The documents table is replicated R times inside Spark (``explode`` of a
sequence, new keys ``doc_id * R + copy``, a ``copy`` tag appended to the
source so domains grow too) — nothing is written, the replicas are derived
on the fly from the given table. Measured: rows/s for format + exact split
(A1 + A5), the grouping-sets profile (B4) and the response gate (R8).

    BENCH_SF_DIR=/root/testdata/sf0.1 SCALE_REPLICAS=100 python bench_scale.py
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import functions as F

    from tessera.operators import corpus as C
    from tessera.operators import profile as P
    from tessera.operators import responses as R
    from tessera.plans import fixtures as FX
    from tessera.session import get_session
    from tessera.sources.tables import table

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    reps = int(os.environ.get("SCALE_REPLICAS", "100"))
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", extra={
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tessera-scale-", dir="/tmp")})
    docs = table(spark, sf_dir, "documents")
    big = (docs.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
               .select((F.col("doc_id") * reps + F.col("_copy")).alias("doc_id"), "text", "lang",
                       F.concat(F.col("source"), F.lit("-"), (F.col("_copy") % 10).cast("string")).alias("source"),
                       "n_chars"))
    # The driver files hold one row group each, so the replicas would all sit
    # in one task; spread them the way a many-file source would be, and keep
    # that layout (written once to the scratch folder) for all measurements.
    path = os.path.join(spark.conf.get("spark.checkpoint.dir"), f"replicated-{reps}")
    big.repartition(int(cpus) * 4).write.mode("overwrite").parquet(path)
    big = spark.read.parquet(path)
    n = big.count()
    samples = FX.samples_from(big)

    def run(name, df):
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        el = time.perf_counter() - t0
        return name, round(el, 3), round(n / el)

    out = {}
    for name, df in [
        ("format_split", C.quota_split(C.format_samples(samples), "sample_id", "complexity")),
        ("corpus_report", P.corpus_report(samples)),
        ("gate_responses", R.gate_responses(FX.responses_from(samples).select("sample_id", "response"))),
    ]:
        k, sec, rps = run(name, df)
        out[k] = {"sec": sec, "rows_per_sec": rps}
    print(json.dumps({"rows": n, "replicas": reps, "cpus": int(cpus), "results": out}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Physical-plan properties the scale design relies on."""

import __spark_entry__ as E
from conftest import SF_SMALL


def plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString() + "\n" + \
        df._jdf.queryExecution().optimizedPlan().toString()


def test_date_filter_reaches_parquet(spark):
    p = plan(spark, "last_n_days")
    assert "GreaterThanOrEqual(o_orderdate,2001-07-01" in p


def test_column_pruning(spark):
    p = plan(spark, "revenue_by_month_ytd")
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in p


def test_topk_without_global_sort(spark):
    p = plan(spark, "top_n_agg")
    assert "TakeOrderedAndProject" in p


def test_topk_per_group_limits_before_windows(spark):
    p = plan(spark, "topk_per_group")
    assert p.count("WindowGroupLimit") >= 2
    assert "_salt" in p


def physical(spark, name):
    return E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


def test_argmax_and_attempts_are_hash_aggregations(spark):
    for name in ("argmax_per_group", "ensemble_vote", "resolve_attempts"):
        p = physical(spark, name)
        assert "HashAggregate" in p and "SortAggregate" not in p, name


def test_report_scans_once(spark):
    assert physical(spark, "corpus_report").count("FileScan parquet") == 1


def test_extraction_is_not_run_for_a_null_filter(spark):
    # one regexp_extract per pattern and use, none repeated in a pushed filter
    assert "isnotnull(CASE WHEN" not in physical(spark, "classify_statement").replace("IsNotNull", "isnotnull")


def test_year_compare_reaches_parquet(spark):
    assert "GreaterThanOrEqual(o_orderdate,2000-01-01" in physical(spark, "fn_strftime_compare")


def test_hot_right_keys_are_reduced_before_the_exchange(spark):
    for name in ("semi_join_filtered", "anti_join", "left_join", "null_test"):
        p = plan(spark, name)
        assert "HashAggregate" in p, name


def test_split_moves_no_rows(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("stratified_split", "random_split", "split_null_labels"):
            p = physical(spark, name)
            assert "Exchange hashpartitioning" not in p and "CartesianProduct" not in p and "NestedLoop" not in p, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_median_uses_histogram_not_percentile(spark):
    p = plan(spark, "query_length_stats")
    assert "percentile" not in p.lower()

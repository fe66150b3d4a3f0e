from datetime import datetime

from pyspark.sql import functions as F

from quillgraph.operators.snapshots import row_hash, snapshot_changes

SCHEMA = "id bigint, graph_no string, graph_version bigint, doc_no string, sha256 string, update_time timestamp_ntz, change string"


def rows(spark, *data):
    full = [(i, g, v, d, s, datetime(2024, 1, 1, 0, 0, t) if t is not None else None, "x") for i, (g, v, d, s, t) in enumerate(data)]
    df = spark.createDataFrame(full, SCHEMA)
    out = snapshot_changes(df, compared=[F.lower("sha256")], time=F.col("update_time"))
    return {tuple(r) for r in out.collect()}


def test_changes_versions_may_skip_and_case_means_nothing(spark):
    got = rows(
        spark, ("g", 1, "a", "AA", 1), ("g", 1, "b", "bb", 1), ("g", 1, "c", "cc", 1),
        ("g", 4, "a", "aa", 2), ("g", 4, "b", "b2", 2), ("g", 4, "d", "dd", 2), ("h", 7, "a", "aa", 1),
    )
    assert got == {("g", 4, "b", "changed"), ("g", 4, "c", "removed"), ("g", 4, "d", "added")}


def test_latest_delivery_counts_and_null_time_is_oldest(spark):
    got = rows(spark, ("g", 1, "a", "1", 5), ("g", 1, "a", "2", None), ("g", 2, "a", "9", 1), ("g", 2, "a", "1", 3), ("g", 2, "a", "1", 3))
    assert got == set()


def test_null_values_keys_and_empty_table(spark):
    assert rows(spark, ("g", 1, "a", None, 1), ("g", 2, "a", None, 1), ("g", 2, None, "x", 1), (None, 2, "a", "x", 1), ("g", None, "a", "x", 1)) == set()
    assert rows(spark, ("g", 1, "a", None, 1), ("g", 2, "a", "x", 1)) == {("g", 2, "a", "changed")}
    assert rows(spark) == set()


def test_row_hash_tells_null_from_text(spark):
    df = spark.createDataFrame([(None, "a"), ("n", "a"), ("va", None), ("v", "a")], "x string, y string")
    assert df.select(row_hash([F.col("x"), F.col("y")])).distinct().count() == 4
    swapped = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    assert swapped.select(row_hash([F.col("x"), F.col("y")])).distinct().count() == 2


def test_equal_times_go_to_the_greater_id_and_other_kinds_of_time(spark):
    df = spark.createDataFrame([(1, "g", 1, "a", "x", 5), (9, "g", 1, "a", "y", 5), (3, "g", 2, "a", "y", 1), (4, "g", 2, "a", "z", None)], "id bigint, graph_no string, graph_version bigint, doc_no string, sha256 string, t int")
    for time in (F.col("t"), F.timestamp_seconds("t"), F.timestamp_seconds("t").cast("timestamp_ntz")):
        assert snapshot_changes(df, compared=[F.col("sha256")], time=time).count() == 0
    assert snapshot_changes(df.filter("id <> 9"), compared=[F.col("sha256")], time=F.col("t")).count() == 1


def test_one_exchange_of_the_rows_and_no_sort(spark):
    df = spark.createDataFrame([(1, "g", 1, "a", "x", 5), (3, "g", 2, "a", "y", 1)], "id bigint, graph_no string, graph_version bigint, doc_no string, sha256 string, t int")
    plan = snapshot_changes(df, compared=[F.col("sha256")], time=F.col("t"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("BroadcastExchange") == 1 and "SortAggregate" not in plan and "HashAggregate" in plan


def test_under_adaptive_execution_and_code_generation(shipped):
    test_changes_versions_may_skip_and_case_means_nothing(shipped)
    test_latest_delivery_counts_and_null_time_is_oldest(shipped)

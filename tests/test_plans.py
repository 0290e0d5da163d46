"""Shapes of the physical plans that scale depends on."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import append, audit, metrics, windows
from tidemark.plans import ordered, queries
from tidemark.schemas import ATTEMPT, SENSOR_EVENT
from tidemark.sources import tables

SF = "/root/testdata/sf0.001"


def physical(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "t")
    (spark.range(0, 100_000, 1, 4)
     .select(F.concat(F.lit("d"), (F.col("id") % 9).cast("string")).alias("device_id"),
             F.col("id").cast("double").alias("temperature"), (F.col("id") * 10).alias("event_ms"),
             F.lit("unused").alias("other")).write.parquet(path))
    return path


def test_window_agg_is_one_shuffle_with_partial_aggregation(spark):
    plan = physical(windows.window_agg(tables.sensor_events(spark, SF)))
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in plan


def test_completed_windows_filter_reaches_the_scan(spark, stored):
    rows = spark.read.schema(SENSOR_EVENT).parquet(stored)
    plan = physical(windows.windows_completed(rows, 500_000))
    assert "LessThan(event_ms,490000)" in plan
    assert "ReadSchema: struct<device_id:string,temperature:double,event_ms:bigint>" in plan


def test_registered_bounds_reach_the_scan(spark):
    for name, sign in (("windows_completed", "LessThan(ts,"), ("windows_active", "GreaterThanOrEqual(ts,")):
        assert sign in physical(queries.registered()[name](spark, SF)), name


def test_offset_audit_shuffles_bitmaps_only(spark):
    log = spark.read.schema("partition int, offset long, value string").parquet(queries.stored_log(spark, SF))
    plan = physical(audit.offset_audit(log))
    assert "partial_bitmap_construct_agg" in plan and "ReadSchema: struct<offset:bigint>" in plan


def test_replica_diff_has_no_join(spark):
    log = queries.log_scan(spark, SF)
    assert "Join" not in physical(audit.replica_diff(log, log))


def test_no_plan_has_a_nested_loop_or_python(spark):
    for name, query in queries.registered().items():
        if name.startswith("stream_"):
            continue
        plan = physical(query(spark, SF))
        for bad in ("NestedLoop", "CartesianProduct", "Python", "ArrowEval"):
            assert bad not in plan, (name, bad)


def test_percentiles_reduce_before_the_shuffle(spark):
    df = spark.range(0, 1_000, 1, 4).select((F.col("id") % 10).alias("x"), F.lit("w").alias("wide"))
    plan = physical(metrics.nearest_rank(df, "x"))
    assert "partial_count" in plan and "wide" not in plan


def test_percentiles_read_the_input_once(spark):
    df = metrics.nearest_rank(metrics.with_latency(tables.samples(spark, SF)), "latency_ms", by=["event_type"])
    df.collect()
    assert "ReusedExchange" in physical(df)


def test_each_payload_is_parsed_once(spark):
    for name in ("event_from_json", "log_fan_in", "dead_letters"):
        plan = queries.registered()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1, name


def test_acks_sort_narrow_rows_once(spark, tmp_path, monkeypatch):
    """One range sort, of rows without payload, and the payload moves in one join."""
    source = str(tmp_path / "attempts")
    tables.append_attempts(spark, SF).write.parquet(source)
    sorted_frames, cut = [], ordered.materialize
    monkeypatch.setattr(ordered, "materialize", lambda df, label: sorted_frames.append(df) or cut(df, label))
    result = append.append_acks(spark.read.schema(ATTEMPT).parquet(source))
    assert len(sorted_frames) == 1
    sort = physical(sorted_frames[0])
    assert sort.count("rangepartitioning") == 1 and "value" not in sort and "key:" not in sort
    plan = physical(result)
    assert "rangepartitioning" not in plan
    assert sum("value:string" in line for line in plan.splitlines() if "ReadSchema" in line) == 1

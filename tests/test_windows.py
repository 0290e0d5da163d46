"""Windows, lateness, completion and counters."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.operators import windows

ARRIVAL = "device_id string, temperature double, event_ms long, arrival_ms long"
PLAIN = "device_id string, temperature double, event_ms long"


def test_three_readings_in_one_window(spark):
    df = spark.createDataFrame([("device-A", t, 1_000) for t in (20.0, 24.0, 22.0)], PLAIN)
    done = windows.windows_completed(df, 61_000, grace_ms=0).collect()
    assert len(done) == 1
    row = done[0]
    assert (row["count"], row["max"], row["avg"], row["sum"]) == (3, 24.0, 22.0, 66.0)
    assert (row.window_start_ms, row.window_end_ms) == (0, 10_000)
    assert windows.windows_active(df, 61_000, grace_ms=0).count() == 0


def test_hot_window(spark):
    df = (spark.range(0, 8_000, 1, 8)
          .select(F.lit("device-stress").alias("device_id"), F.lit(20.0).alias("temperature"),
                  F.lit(50_000).cast("long").alias("event_ms"), F.lit(50_000).cast("long").alias("arrival_ms")))
    row = windows.run_counters(df, 50_000).first()
    assert (row.processed, row.late, row.active_windows, row.flushed_windows) == (8_000, 0, 1, 0)


def test_late_event(spark):
    df = spark.createDataFrame([("device-0", 22.0, 70_000, 100_000)], ARRIVAL)
    row = windows.run_counters(df, 100_000, grace_ms=1_000).first()
    assert (row.processed, row.late) == (0, 1)
    assert windows.late_accept(df, grace_ms=1_000).count() == 0
    assert windows.late_rejects(df, grace_ms=1_000).count() == 1


@pytest.mark.parametrize("arrival, accepted", [(14_999, True), (15_000, True), (15_001, False)])
def test_lateness_boundary(spark, arrival, accepted):
    df = spark.createDataFrame([("d", 1.0, 1_000, arrival)], ARRIVAL)
    assert windows.late_accept(df).count() == int(accepted)
    assert windows.late_rejects(df).count() == int(not accepted)


@pytest.mark.parametrize("asof, completed", [(14_999, False), (15_000, True)])
def test_flush_boundary(spark, asof, completed):
    df = spark.createDataFrame([("d", 1.0, 1_000)], PLAIN)
    assert windows.windows_completed(df, asof).count() == int(completed)
    assert windows.windows_active(df, asof).count() == int(not completed)


def test_completed_bound_equals_the_window_test(spark):
    """The comparison on the event time selects exactly the windows with end + grace <= asof."""
    df = spark.range(-40_000, 120_000, 733).select(
        F.lit("d").alias("device_id"), F.lit(1.0).alias("temperature"), F.col("id").alias("event_ms"))
    for asof in (0, 14_999, 15_000, 15_001, 60_000, 77_777):
        for grace in (0, 1, 5_000, 12_345):
            want = {r.window_start_ms for r in windows.window_agg(df).collect()
                    if r.window_end_ms + grace <= asof}
            got = {r.window_start_ms for r in windows.windows_completed(df, asof, grace_ms=grace).collect()}
            assert got == want


def test_nan_is_the_maximum(spark):
    df = spark.createDataFrame([("d", 1.0, 0), ("d", float("nan"), 1), ("d", 3.0, 2)], PLAIN)
    assert windows.window_agg(df).first()["max"] != windows.window_agg(df).first()["max"]


def test_merging_partial_windows(spark):
    small = spark.createDataFrame([("d", 0, 10_000, 2, 40.0, 20.0, 22.0), ("d", 10_000, 20_000, 1, 24.0, 24.0, 24.0)],
                                  "device_id string, window_start_ms long, window_end_ms long, count long, "
                                  "sum double, avg double, max double")
    row = windows.window_rollup(small, 60_000).first()
    assert (row["count"], row["sum"], row["max"], row["avg"]) == (3, 64.0, 24.0, 64.0 / 3)
    assert (row.window_start_ms, row.window_end_ms) == (0, 60_000)


def test_rollup_needs_whole_windows(spark):
    with pytest.raises(ValueError):
        windows.window_rollup(None, 25_000)


def test_rollup_equals_direct_aggregation(spark):
    df = spark.range(0, 5_000).select(
        F.concat(F.lit("device-"), (F.col("id") % 7).cast("string")).alias("device_id"),
        (F.col("id") % 100).cast("double").alias("temperature"), (F.col("id") * 997).alias("event_ms"))
    direct = windows.window_agg(df, 120_000)
    rolled = windows.window_rollup(windows.window_agg(df), 120_000)
    assert direct.exceptAll(rolled).isEmpty() and rolled.exceptAll(direct).isEmpty()


def test_conservation_and_empty_input(spark):
    df = spark.createDataFrame([("d", 1.0, 1_000, 1_000), ("d", 1.0, 1_000, 90_000)], ARRIVAL)
    row = windows.window_conservation(df).first()
    assert (row.consumed, row.accepted, row.readings, row.conserved) == (2, 1, 1, True)
    none = windows.window_conservation(df.limit(0)).first()
    assert (none.consumed, none.readings, none.conserved) == (0, 0, True)
    assert tuple(windows.run_counters(df.limit(0), 5).first()) == (0, 0, 0, 0)


def test_results_do_not_depend_on_partitioning(spark):
    df = spark.range(0, 20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), (F.col("id") % 50).cast("string"))).alias("device_id"),
        (F.col("id") % 64).cast("double").alias("temperature"), (F.col("id") * 31 % 200_000).alias("event_ms"))
    seen = set()
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(sorted(map(tuple, windows.window_agg(df.repartition(n)).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert len(seen) == 1




def sequential(events, asof, size, grace):
    """What one aggregator would hold after taking the events one by one and flushing at ``asof``."""
    live, late = {}, 0
    for device, value, at, arrival in events:
        start = at - at % size
        if start + size + grace < arrival:
            late += 1
            continue
        n, total, top = live.get((device, start), (0, 0.0, value))
        live[(device, start)] = (n + 1, total + value, max(top, value))
    done = {k: v for k, v in live.items() if k[1] + size + grace <= asof}
    return late, done, {k: v for k, v in live.items() if k not in done}


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 64).map(float), st.integers(-50, 300),
                          st.integers(0, 300)), min_size=1, max_size=30),
       st.integers(0, 400), st.sampled_from([(10, 5), (7, 0), (50, 100)]))
def test_any_events_equal_the_sequential_model(spark, events, asof, shape):
    size, grace = shape
    late, done, live = sequential(events, asof, size, grace)
    df = spark.createDataFrame(events, ARRIVAL)
    kept = windows.late_accept(df, size, grace)

    def found(result):
        return {(r.device_id, r.window_start_ms): (r["count"], r["sum"], r["max"]) for r in result.collect()}
    assert found(windows.windows_completed(kept, asof, size, grace)) == done
    assert found(windows.windows_active(kept, asof, size, grace)) == live
    counters = windows.run_counters(df, asof, size, grace).first()
    assert tuple(counters) == (len(events) - late, late, len(live), len(done))

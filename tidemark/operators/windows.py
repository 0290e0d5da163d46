"""Tumbling windows per device: aggregate, roll up, complete, count, reconcile."""

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.scalar import (average, completed_before, is_late, lateness_flag, lateness_ms,
                                       window_end, window_start, with_window)
from tidemark.schemas import GRACE_MS, LATE_FLAG_MS, PERCENTILES, WINDOW_MS

RESULT = ["device_id", "window_start_ms", "window_end_ms", "count", "sum", "avg", "max"]


def window_assign(events: DataFrame, size_ms=WINDOW_MS) -> DataFrame:
    return with_window(events, size_ms=size_ms)


def window_agg(events: DataFrame, size_ms=WINDOW_MS) -> DataFrame:
    """Count, sum, average and maximum per (device, window).

    Partial aggregation runs before the one shuffle, so a hot device costs one row per task and window.
    """
    return (events
            .groupBy("device_id", window_start(size_ms=size_ms).alias("window_start_ms"))
            .agg(F.count("*").alias("count"), F.sum("temperature").alias("sum"),
                 F.max("temperature").alias("max"))
            .withColumn("window_end_ms", window_end(size_ms=size_ms))
            .withColumn("avg", average())
            .select(*RESULT))


def window_rollup(windows: DataFrame, size_ms, from_ms=WINDOW_MS) -> DataFrame:
    """Merges windows of ``from_ms`` into larger ones of ``size_ms`` without going back to the events."""
    if size_ms % from_ms:
        raise ValueError(f"windows of {from_ms} ms do not fill windows of {size_ms} ms")
    return (windows
            .groupBy("device_id", window_start("window_start_ms", size_ms).alias("window_start_ms"))
            .agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.max("max").alias("max"))
            .withColumn("window_end_ms", window_end(size_ms=size_ms))
            .withColumn("avg", average())
            .select(*RESULT))


SKETCH_SIZE = 1_024


def window_sketches(events: DataFrame, size_ms=WINDOW_MS, sketch_size=SKETCH_SIZE) -> DataFrame:
    """``device_id, window_start_ms, window_end_ms, count, sketch``: a mergeable quantile sketch (KLL) of each window's readings.

    A window of up to ``sketch_size`` readings is held exactly; beyond, ranks are off by at most some 2.6 / sketch_size of the
    readings with a confidence of 99 per cent, however often sketches are merged. Tasks build partial sketches before the shuffle.
    """
    return (events.groupBy("device_id", window_start(size_ms=size_ms).alias("window_start_ms"))
            .agg(F.count("temperature").alias("count"), F.kll_sketch_agg_double("temperature", F.lit(sketch_size)).alias("sketch"))
            .select("device_id", "window_start_ms", window_end(size_ms=size_ms).alias("window_end_ms"), "count", "sketch"))


def rollup_sketches(windows: DataFrame, size_ms, from_ms=WINDOW_MS, sketch_size=SKETCH_SIZE) -> DataFrame:
    """Merges the sketches of windows of ``from_ms`` into larger windows without going back to the events."""
    if size_ms % from_ms:
        raise ValueError(f"windows of {from_ms} ms do not fill windows of {size_ms} ms")
    return (windows.groupBy("device_id", window_start("window_start_ms", size_ms).alias("window_start_ms"))
            .agg(F.sum("count").alias("count"), F.kll_merge_agg_double("sketch", F.lit(sketch_size)).alias("sketch"))
            .select("device_id", "window_start_ms", window_end(size_ms=size_ms).alias("window_end_ms"), "count", "sketch"))


def sketched_quantiles(windows: DataFrame, percents=PERCENTILES) -> DataFrame:
    """Adds ``p50`` and so on, read from the sketches; NULL for a window without readings."""
    read = [F.when(F.col("count") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100.0))).alias(f"p{p:g}") for p in percents]
    return windows.select(*[c for c in windows.columns if c != "sketch"], *read)


def _rejected(size_ms, grace_ms):
    return F.coalesce(is_late(size_ms=size_ms, grace_ms=grace_ms), F.lit(True))


def late_accept(events: DataFrame, size_ms=WINDOW_MS, grace_ms=GRACE_MS) -> DataFrame:
    """Events that are not late; one without an event or an arrival time is none of them."""
    return events.where(~_rejected(size_ms, grace_ms))


def late_rejects(events: DataFrame, size_ms=WINDOW_MS, grace_ms=GRACE_MS) -> DataFrame:
    """All other events: late ones, and those whose times do not tell."""
    return events.where(_rejected(size_ms, grace_ms))


def windows_completed(events: DataFrame, asof_ms, size_ms=WINDOW_MS, grace_ms=GRACE_MS) -> DataFrame:
    """Windows with ``end + grace <= asof`` (inclusive). The test is applied to the events, before the shuffle."""
    return window_agg(events.where(F.col("event_ms") < completed_before(asof_ms, size_ms, grace_ms)), size_ms)


def windows_active(events: DataFrame, asof_ms, size_ms=WINDOW_MS, grace_ms=GRACE_MS) -> DataFrame:
    return window_agg(events.where(F.col("event_ms") >= completed_before(asof_ms, size_ms, grace_ms)), size_ms)


def completed_bound(asof_ms: int, size_ms=WINDOW_MS, grace_ms=GRACE_MS) -> int:
    """``completed_before`` of a known time, as a number."""
    return (asof_ms - grace_ms) // size_ms * size_ms


def run_counters(events: DataFrame, asof_ms, size_ms=WINDOW_MS, grace_ms=GRACE_MS) -> DataFrame:
    """One row: events processed, late events, windows still active, windows flushed. One shuffle."""
    late = _rejected(size_ms, grace_ms)
    windows = (events
               .groupBy("device_id", window_start(size_ms=size_ms).alias("window_start_ms"))
               .agg(F.count_if(~late).alias("accepted"), F.count_if(late).alias("late")))
    flushed = F.col("window_start_ms") < completed_before(asof_ms, size_ms, grace_ms)
    return windows.agg(
        F.coalesce(F.sum("accepted"), F.lit(0)).alias("processed"),
        F.coalesce(F.sum("late"), F.lit(0)).alias("late"),
        F.count_if((F.col("accepted") > 0) & ~flushed).alias("active_windows"),
        F.count_if((F.col("accepted") > 0) & flushed).alias("flushed_windows"))


def window_conservation(events: DataFrame, size_ms=WINDOW_MS, grace_ms=GRACE_MS) -> DataFrame:
    """One row: events consumed, events accepted, readings over all windows, and whether the last two agree."""
    accepted = late_accept(events, size_ms, grace_ms)
    seen = events.agg(F.count("*").alias("consumed"),
                      F.count_if(~_rejected(size_ms, grace_ms)).alias("accepted"))
    readings = window_agg(accepted, size_ms).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("readings"))
    return (seen.withColumn("readings", readings.scalar())
            .withColumn("conserved", F.col("readings") == F.col("accepted")))


def lateness_profile(events: DataFrame, threshold_ms=LATE_FLAG_MS, by=()) -> DataFrame:
    """Events more than ``threshold_ms`` behind their arrival, and the others."""
    late = lateness_flag(threshold_ms=threshold_ms)
    return events.groupBy(*by).agg(
        F.count("*").alias("events"), F.count_if(late).alias("late"), F.count_if(~late).alias("on_time"),
        F.max(lateness_ms()).alias("max_lateness_ms"))

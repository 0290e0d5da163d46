"""Time, rounding and text expressions. All of them are built-in column expressions."""

from pyspark.sql import Column, functions as F

from tidemark.schemas import GRACE_MS, LATE_FLAG_MS, WINDOW_MS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v).cast("long")


def window_start(ts_ms="event_ms", size_ms=WINDOW_MS) -> Column:
    """Start of the tumbling window; floors, so times before the epoch fall into the window that holds them."""
    ts = _col(ts_ms)
    return ts - F.pmod(ts, F.lit(size_ms).cast("long"))


def window_end(start_ms="window_start_ms", size_ms=WINDOW_MS) -> Column:
    """Exclusive end: a window is [start, end)."""
    return _col(start_ms) + F.lit(size_ms).cast("long")


def with_window(df, ts_ms="event_ms", size_ms=WINDOW_MS):
    start = window_start(ts_ms, size_ms)
    return df.withColumns({"window_start_ms": start, "window_end_ms": window_end(start, size_ms)})


def is_late(ts_ms="event_ms", now_ms="arrival_ms", size_ms=WINDOW_MS, grace_ms=GRACE_MS) -> Column:
    """True when the event's window closed more than the grace period before ``now`` (strict)."""
    return window_end(window_start(ts_ms, size_ms), size_ms) + F.lit(grace_ms).cast("long") < _col(now_ms)


def completed_before(asof_ms, size_ms=WINDOW_MS, grace_ms=GRACE_MS) -> Column:
    """First event time that is not yet in a completed window as of ``asof_ms``.

    ``window_end + grace <= asof`` holds for exactly the events below this bound, so the test becomes a plain
    comparison on the stored time column, which the parquet scan can use to skip row groups.
    """
    return window_start(_value(asof_ms) - F.lit(grace_ms).cast("long"), size_ms)


def average(total="sum", count="count") -> Column:
    return F.when(_col(count) == 0, F.lit(0.0)).otherwise(_col(total) / _col(count))


def window_name(device="device_id", start="window_start_ms", end="window_end_ms") -> Column:
    return F.format_string("%s@[%d,%d)", _col(device), _col(start), _col(end))


def window_stats_text(count="count", avg="avg", top="max") -> Column:
    return F.format_string("count=%d, avg=%.1f, max=%.1f", _col(count), _col(avg), _col(top))


def window_line(device="device_id", start="window_start_ms", end="window_end_ms",
                count="count", avg="avg", top="max") -> Column:
    return F.concat(F.lit("Window["), window_name(device, start, end), F.lit("] -> "),
                    window_stats_text(count, avg, top))


def window_report(device="device_id", start="window_start_ms", end="window_end_ms",
                  count="count", avg="avg", top="max") -> Column:
    """The aligned line for a console report."""
    return F.format_string("[WINDOW] %-20s | count=%4d | avg=%5.1f°C | max=%5.1f°C",
                           window_name(device, start, end), _col(count), _col(avg), _col(top))


def latency_ms(start_ns="start_ns", end_ns="end_ns") -> Column:
    """Whole milliseconds between two nanosecond columns, truncated by integer division."""
    return F.expr(f"({end_ns} - {start_ns}) div 1000000")


def round_half_up_1dp(x) -> Column:
    return F.floor(_col(x) * 10 + 0.5) / 10.0


def lateness_ms(event_ms="event_ms", arrival_ms="arrival_ms") -> Column:
    return _col(arrival_ms) - _col(event_ms)


def lateness_flag(event_ms="event_ms", arrival_ms="arrival_ms", threshold_ms=LATE_FLAG_MS) -> Column:
    return lateness_ms(event_ms, arrival_ms) > F.lit(threshold_ms).cast("long")


def backdated(event_ms, number, every=33, step_ms=1_000) -> Column:
    """Moves every ``every``-th event 1 to 8 steps into the past, by integer arithmetic on its number."""
    n = _col(number)
    return _col(event_ms) - F.when(n % every == 0, (1 + n % 8) * F.lit(step_ms).cast("long")).otherwise(F.lit(0).cast("long"))


def event_time(ts_ms="event_ms") -> Column:
    """TIMESTAMP for watermarks and ``window``; independent of the session time zone."""
    return F.timestamp_millis(_col(ts_ms))

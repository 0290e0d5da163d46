"""The registered queries: each takes (spark, sf_dir) and runs one operator over whole tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import payload, scalar
from tidemark.functions.routing import key_hash, key_partition
from tidemark.operators import append, audit, metrics, windows
from tidemark.schemas import ATTEMPT, LOG, RESULT_SCHEMA, STORED_LOG
from tidemark.session import scratch_path
from tidemark.sources import log_table, tables
from tidemark.streaming import appender
from tidemark.streaming import windows as stream

PARTITIONS = 4
SIZE_MS = 6 * tables.HOUR_MS
GRACE_MS = tables.HOUR_MS
WEEK_MS = 7 * tables.DAY_MS
RUN_SECONDS = 30 * 24 * 3600

_stored: dict = {}


def rounded(result: DataFrame) -> DataFrame:
    """Readings have two decimals: rounding the sum there makes it independent of the order of addition."""
    return (result.withColumn("sum", F.round("sum", 2)).withColumn("avg", scalar.average("sum", "count")))


def _once(spark: SparkSession, sf_dir: str, label: str, write) -> str:
    """Path of a table derived from the given ones; written once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _stored:
        path = scratch_path(spark, label)
        write(path)
        _stored[key] = path
    return _stored[key]


def _attempts(spark, sf_dir) -> DataFrame:
    path = _once(spark, sf_dir, "attempts", lambda to: tables.append_attempts(
        spark, sf_dir, PARTITIONS).write.parquet(to))
    return spark.read.schema(ATTEMPT).parquet(path)


def stored_log(spark, sf_dir) -> str:
    """The log table built from the append attempts."""
    return _once(spark, sf_dir, "log", lambda to: log_table.write_log(
        append.log_records(_attempts(spark, sf_dir)), to))


def _log(spark, sf_dir) -> DataFrame:
    return log_table.read_log(spark, stored_log(spark, sf_dir), STORED_LOG)


def _consumed(log: DataFrame) -> DataFrame:
    return log.where("offset % 97 <> 0")


def _replica(log: DataFrame) -> DataFrame:
    changed = F.when(F.col("offset") % 101 == 0, F.concat("value", F.lit("*"))).otherwise(F.col("value"))
    return _consumed(log).withColumn("value", changed)


def _latest(events: DataFrame, column="event_ms"):
    return events.agg(F.max(column)).scalar()


# --- log: sources and sinks -------------------------------------------------------------------------------

def log_scan(spark, sf_dir):
    return log_table.read_log(spark, stored_log(spark, sf_dir))


def log_fetch(spark, sf_dir):
    return log_table.fetch(spark, stored_log(spark, sf_dir), 2, 100, PARTITIONS)


def log_fan_in(spark, sf_dir):
    from_log = payload.decoded_events(log_scan(spark, sf_dir)).select("device_id", "temperature", "event_ms")
    merged = log_table.fan_in(from_log, tables.shipments(spark, sf_dir))
    return rounded(windows.window_agg(merged, WEEK_MS))


def log_append(spark, sf_dir):
    """Writes a new log table and reads back what was stored."""
    path = scratch_path(spark, "log-append")
    log_table.write_log(append.log_records(_attempts(spark, sf_dir)), path)
    return log_table.read_log(spark, path, STORED_LOG)


# --- projections -------------------------------------------------------------------------------------------

def event_to_json(spark, sf_dir):
    return tables.sensor_events(spark, sf_dir).select("event_id", payload.event_to_json().alias("value"))


def event_from_json(spark, sf_dir):
    return (payload.decoded_events(log_scan(spark, sf_dir))
            .select("partition", "offset", "device_id", "temperature", "event_ms"))


def _damaged(spark, sf_dir):
    n, good = F.col("event_id"), payload.event_to_json()
    text = (F.when(n % 10 == 3, F.expr("substring(value, 1, length(value) - 7)"))
            .when(n % 10 == 5, F.concat(F.lit('{"deviceId":"'), F.col("device_id"), F.lit('"}')))
            .when(n % 10 == 7, F.regexp_replace("value", r"\}$", ',"unit":"C"}')).otherwise(F.col("value")))
    return (tables.sensor_events(spark, sf_dir).withColumn("value", good)
            .select("event_id", text.alias("value")))


def dead_letters(spark, sf_dir):
    return payload.dead_letters(_damaged(spark, sf_dir))


def key_partition_query(spark, sf_dir):
    rows = tables.sensor_events(spark, sf_dir)
    return rows.select("event_id", key_hash("device_id").alias("key_hash"),
                       key_partition("device_id", PARTITIONS).alias("partition"))


def key_hash_text(spark, sf_dir):
    """The hash over long texts in several languages, so beyond plain ASCII keys."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", key_hash("text").alias("key_hash"))


def window_assign(spark, sf_dir):
    return windows.window_assign(tables.sensor_events(spark, sf_dir)).select(
        "event_id", "window_start_ms", "window_end_ms")


def window_label(spark, sf_dir):
    result = rounded(windows.window_agg(tables.sensor_events(spark, sf_dir), SIZE_MS))
    return result.select("device_id", "window_start_ms", scalar.window_line().alias("label"))


def round_half_up_1dp(spark, sf_dir):
    return tables.sensor_events(spark, sf_dir).select(
        "event_id", scalar.round_half_up_1dp("temperature").alias("rounded"))


def lateness_profile(spark, sf_dir):
    return windows.lateness_profile(tables.late_events(spark, sf_dir), 500, by=["event_type"])


def late_arrivals(spark, sf_dir):
    return tables.late_events(spark, sf_dir).select("event_id", "device_id", "event_ms", "arrival_ms")


# --- windows -----------------------------------------------------------------------------------------------

_LATE_COLUMNS = ["event_id", "device_id", "temperature", "event_ms", "arrival_ms"]


def late_accept(spark, sf_dir):
    return windows.late_accept(tables.late_events(spark, sf_dir), SIZE_MS, GRACE_MS).select(*_LATE_COLUMNS)


def late_rejects(spark, sf_dir):
    return windows.late_rejects(tables.late_events(spark, sf_dir), SIZE_MS, GRACE_MS).select(*_LATE_COLUMNS)


def window_agg(spark, sf_dir):
    return rounded(windows.window_agg(tables.sensor_events(spark, sf_dir), SIZE_MS))


def window_agg_10s(spark, sf_dir):
    return rounded(windows.window_agg(tables.sensor_events(spark, sf_dir)))


def window_agg_shipments(spark, sf_dir):
    return rounded(windows.window_agg(tables.shipments(spark, sf_dir), WEEK_MS))


def window_agg_accepted(spark, sf_dir):
    accepted = windows.late_accept(tables.late_events(spark, sf_dir), SIZE_MS, GRACE_MS)
    return rounded(windows.window_agg(accepted, SIZE_MS))


def _asof(spark, sf_dir):
    """The latest event time, as a number, so that bounds made of it can be pushed to the scan."""
    return tables.sensor_events(spark, sf_dir).agg(F.max("event_ms")).first()[0] or 0


def windows_completed(spark, sf_dir):
    asof = _asof(spark, sf_dir)
    rows = tables.sensor_events(spark, sf_dir, before_ms=windows.completed_bound(asof, SIZE_MS, GRACE_MS))
    return rounded(windows.windows_completed(rows, asof, SIZE_MS, GRACE_MS))


def windows_active(spark, sf_dir):
    asof = _asof(spark, sf_dir)
    rows = tables.sensor_events(spark, sf_dir, from_ms=windows.completed_bound(asof, SIZE_MS, GRACE_MS))
    return rounded(windows.windows_active(rows, asof, SIZE_MS, GRACE_MS))


def window_rollup(spark, sf_dir):
    small = windows.window_agg(tables.shipments(spark, sf_dir), WEEK_MS)
    return rounded(windows.window_rollup(small, 4 * WEEK_MS, WEEK_MS))


def window_quantiles(spark, sf_dir):
    """Percentiles of four weeks, merged from the sketches of single weeks."""
    small = windows.window_sketches(tables.shipments(spark, sf_dir), WEEK_MS)
    return windows.sketched_quantiles(windows.rollup_sketches(small, 4 * WEEK_MS, WEEK_MS))


def run_counters(spark, sf_dir):
    rows = tables.late_events(spark, sf_dir)
    return windows.run_counters(rows, _latest(rows, "arrival_ms"), SIZE_MS, GRACE_MS)


def window_conservation(spark, sf_dir):
    return windows.window_conservation(tables.late_events(spark, sf_dir), SIZE_MS, GRACE_MS)


# --- appending ---------------------------------------------------------------------------------------------

def append_attempts(spark, sf_dir):
    return tables.append_attempts(spark, sf_dir, PARTITIONS)


def idempotent_dedup(spark, sf_dir):
    return append.idempotent_dedup(_attempts(spark, sf_dir))


def idempotent_dedup_sliced(spark, sf_dir):
    return append.idempotent_dedup(_attempts(spark, sf_dir))


def log_offsets(spark, sf_dir):
    return append.log_records(_attempts(spark, sf_dir))


def log_offsets_sliced(spark, sf_dir):
    return append.log_records(_attempts(spark, sf_dir))


def append_plain(spark, sf_dir):
    return append.append_plain(_attempts(spark, sf_dir))


def append_acks(spark, sf_dir):
    return append.append_acks(_attempts(spark, sf_dir))


def append_acks_sliced(spark, sf_dir):
    return append.append_acks(_attempts(spark, sf_dir))


def producer_state(spark, sf_dir):
    return append.producer_state(_log(spark, sf_dir))


def log_end_offsets(spark, sf_dir):
    return append.log_end_offsets(_log(spark, sf_dir))


def consumer_progress(spark, sf_dir):
    return append.consumer_progress(_log(spark, sf_dir), 100)


# --- metrics -----------------------------------------------------------------------------------------------

def latency_percentiles(spark, sf_dir):
    return metrics.nearest_rank(metrics.with_latency(tables.samples(spark, sf_dir)), "latency_ms",
                                by=["event_type"])


def latency_percentiles_all(spark, sf_dir):
    return metrics.nearest_rank(metrics.with_latency(tables.samples(spark, sf_dir)), "latency_ms")


def _nanoseconds(spark, sf_dir):
    return tables.samples(spark, sf_dir).withColumn("latency_ns", F.col("end_ns") - F.col("start_ns") + F.col("user_id") * 997)


def latency_percentiles_ns(spark, sf_dir):
    """Exact percentiles of nanoseconds, whose range is far beyond one level of bins."""
    return metrics.radix_rank(_nanoseconds(spark, sf_dir), "latency_ns", by=["event_type"])


def latency_summary(spark, sf_dir):
    return metrics.latency_summary(tables.samples(spark, sf_dir))


def latency_summary_by_user(spark, sf_dir):
    return metrics.latency_summary(tables.samples(spark, sf_dir), by=["user_id"])


def throughput(spark, sf_dir):
    return metrics.throughput(tables.sensor_events(spark, sf_dir), RUN_SECONDS, by=["event_type"])


def throughput_by_bucket(spark, sf_dir):
    return metrics.throughput_by_bucket(tables.sensor_events(spark, sf_dir), tables.HOUR_MS)


# --- audits ------------------------------------------------------------------------------------------------

def reconcile_loss(spark, sf_dir):
    log = _log(spark, sf_dir)
    return audit.reconcile_loss(log, _consumed(log))


def lost_records(spark, sf_dir):
    log = _log(spark, sf_dir)
    return audit.lost_records(log, _consumed(log)).select("partition", "offset", "key")


def offset_audit(spark, sf_dir):
    return audit.offset_audit(_log(spark, sf_dir))


def offset_audit_damaged(spark, sf_dir):
    """The same audit over a copy with holes and with repeated records."""
    log = _log(spark, sf_dir)
    return audit.offset_audit(_consumed(log).unionByName(log.where("offset % 89 = 0")))


def offset_duplicates(spark, sf_dir):
    log = _log(spark, sf_dir)
    return audit.offset_duplicates(log.unionByName(log.where("offset % 89 = 0")))


def replica_diff(spark, sf_dir):
    log = _log(spark, sf_dir)
    return audit.replica_diff(log, _replica(log))


def replica_summary(spark, sf_dir):
    log = _log(spark, sf_dir)
    return audit.replica_summary(_replica(log), log)


def replica_damage(spark, sf_dir):
    log = _log(spark, sf_dir)
    return audit.replica_damage(log, _replica(log))


def device_liveness(spark, sf_dir):
    rows = tables.sensor_events(spark, sf_dir)
    return audit.device_liveness(tables.roster(spark, sf_dir), rows, _latest(rows), SIZE_MS)


def order_audit(spark, sf_dir):
    return audit.order_audit(_log(spark, sf_dir), PARTITIONS)


def key_placement(spark, sf_dir):
    return audit.key_placement(_log(spark, sf_dir))


def run_verdict(spark, sf_dir):
    log = _log(spark, sf_dir)
    return audit.run_verdict(tables.samples(spark, sf_dir), log, _consumed(log))


# --- streams: run to the end of the input, then return what the sink holds ----------------------------------

def stream_window_agg(spark, sf_dir):
    out = scratch_path(spark, "windows")
    events = tables.as_sensor_events(tables.event_stream(spark, sf_dir))
    result = stream.window_stream(events, SIZE_MS, GRACE_MS)
    stream.start(result, scratch_path(spark, "ckpt"), path=out, drain=True).awaitTermination()
    return rounded(spark.read.schema(result.schema).parquet(out))


def _append_stream(spark, sf_dir):
    """Feeds the attempts in three arrivals, one after the other, to the streaming appender."""
    inbox, log, ckpt = (scratch_path(spark, n) for n in ("inbox", "log", "ckpt"))
    attempts = _attempts(spark, sf_dir)
    first, last = attempts.agg(F.min("arrival_ms"), F.max("arrival_ms")).first()
    step = (last - first) // 3 + 1
    for n in range(3):
        begin = first + n * step
        (attempts.where((F.col("arrival_ms") >= begin) & (F.col("arrival_ms") < begin + step))
         .write.mode("append").parquet(inbox))
        frame = spark.readStream.schema(ATTEMPT).parquet(inbox)
        stream.start(frame, ckpt, handler=appender.append_handler(log), drain=True).awaitTermination()
    return log


def stream_dedup(spark, sf_dir):
    return log_table.read_log(spark, _append_stream(spark, sf_dir), STORED_LOG)


def _accounted(spark, sf_dir) -> str:
    """Runs the late variant through the windowed stream in three arrivals; every 7th event comes with the next arrival, so some
    are behind the watermark. The folder returned holds what was emitted, the checkpoint and the ledger."""
    def run(base):
        rows = tables.late_events(spark, sf_dir)
        first, last = rows.agg(F.min("arrival_ms"), F.max("arrival_ms")).first()
        step = ((last or 0) - (first or 0)) // 3 + 1
        arrival = F.least(F.lit(2), F.expr(f"(arrival_ms - {first or 0}) div {step}") + (F.col("event_id") % 7 == 0).cast("int"))
        ledger = stream.Ledger(spark, f"{base}/ledger")
        spark.streams.addListener(ledger)
        try:
            for n in range(3):
                rows.where(arrival == n).write.mode("append").parquet(f"{base}/in")
                events = stream.accounted(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), "rows", SIZE_MS, GRACE_MS)
                query = stream.start(stream.window_stream(events, SIZE_MS, GRACE_MS), f"{base}/ckpt", path=f"{base}/out", drain=True)
                query.awaitTermination()
                if not ledger.wait(query):
                    raise RuntimeError("the last reports of the query are not stored")
        finally:
            spark.streams.removeListener(ledger)
    return _once(spark, sf_dir, "accounted", run)


def stream_late_counts(spark, sf_dir):
    """Every row that the stream read, as processed, late by its own arrival, or dropped behind the watermark."""
    return stream.ledger_report(spark, f"{_accounted(spark, sf_dir)}/ledger").select("processed", "late", "dropped")


def stream_open_windows(spark, sf_dir):
    """The windows of that stream, emitted or still open in its state."""
    base = _accounted(spark, sf_dir)
    emitted = spark.read.schema(RESULT_SCHEMA).parquet(f"{base}/out").withColumn("open", F.lit(False))
    held = stream.open_windows(spark, f"{base}/ckpt").withColumn("open", F.lit(True))
    return rounded(emitted.unionByName(held))


def log_append_repeated(spark, sf_dir):
    """Two batches, the first sent twice, and what a writer that died has left of the second before it is sent."""
    path, attempts = scratch_path(spark, "log-repeated"), _attempts(spark, sf_dir)
    middle = attempts.agg(F.expr("percentile(arrival_ms, 0.5)")).first()[0] or 0
    first, second = attempts.where(F.col("arrival_ms") < middle), attempts.where(F.col("arrival_ms") >= middle)
    append.append_to_log(spark, first, path, 0)
    append.append_to_log(spark, first, path, 0)
    log_table.write_log(log_table.read_log(spark, path, STORED_LOG).where("offset % 2 = 0"), f"{path}/_staged_1")
    append.append_to_log(spark, second, path, 1)
    return log_table.read_log(spark, path, STORED_LOG)


def lost_records_damaged(spark, sf_dir):
    """Loss where offsets are missing, repeated or unknown on either side."""
    log = _log(spark, sf_dir)
    unknown = log.where("offset % 83 = 0").withColumn("offset", F.lit(None).cast("long"))
    produced = log.unionByName(unknown).unionByName(log.where("offset % 89 = 0"))
    consumed = _consumed(log).unionByName(unknown.where("partition <> 1"))
    return audit.lost_records(produced, consumed).select("partition", "offset", "key")


def stream_log_to_windows(spark, sf_dir):
    """Log table to windows: tail, decode, drop and count late rows, aggregate, store."""
    out = scratch_path(spark, "windows")
    tailed = log_table.tail(spark, stored_log(spark, sf_dir), schema=LOG)
    events = payload.decoded_events(tailed).withColumnRenamed("timestamp", "arrival_ms")
    result = stream.window_stream(stream.counted(events, size_ms=SIZE_MS, grace_ms=GRACE_MS), SIZE_MS, GRACE_MS)
    stream.start(result, scratch_path(spark, "ckpt"), path=out, drain=True).awaitTermination()
    return rounded(spark.read.schema(result.schema).parquet(out))


def registered() -> dict:
    named = {
        "key_partition": key_partition_query,
    }
    for function in (
            window_agg, window_agg_10s, window_agg_shipments, window_agg_accepted, window_assign, window_label,
            window_rollup, windows_completed, windows_active, window_conservation, run_counters,
            late_accept, late_rejects, late_arrivals, lateness_profile, round_half_up_1dp,
            log_scan, log_fetch, log_fan_in, log_append, event_to_json, event_from_json, dead_letters,
            key_hash_text, append_attempts, idempotent_dedup, idempotent_dedup_sliced, log_offsets, log_offsets_sliced,
            append_plain, append_acks, append_acks_sliced, producer_state, log_end_offsets, consumer_progress,
            latency_percentiles, latency_percentiles_all, latency_summary, latency_summary_by_user,
            throughput, throughput_by_bucket, reconcile_loss, lost_records, offset_audit,
            offset_audit_damaged, offset_duplicates, replica_diff, replica_summary, device_liveness,
            order_audit, key_placement, run_verdict, latency_percentiles_ns, window_quantiles, replica_damage,
            stream_window_agg, stream_dedup, stream_log_to_windows, stream_late_counts, stream_open_windows, log_append_repeated, lost_records_damaged):
        named[function.__name__] = function
    return named

"""Streams: emission, late rows, restarts, repeated batches, unreadable rows, agreement with batch."""

import os
import random
import time
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.payload import decoded_events
from tidemark.operators import append, audit, windows
from tidemark.schemas import ATTEMPT, SENSOR_EVENT, SENSOR_EVENT_ARRIVAL, STORED_LOG
from tidemark.sources import log_table
from tidemark.streaming import appender
from tidemark.streaming import windows as stream


class Feed:
    """An input folder and a draining query over it; each ``send`` is one arrival followed by one run."""

    def __init__(self, spark, tmp_path, schema, build, **sink):
        self.spark, self.schema, self.build = spark, schema, build
        self.inbox, self.out, self.ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
        self.sink = sink or {"path": self.out}

    def send(self, rows):
        df = rows if hasattr(rows, "columns") else self.spark.createDataFrame(rows, self.schema)
        df.coalesce(1).write.mode("append").parquet(self.inbox)
        frame = self.build(self.spark.readStream.schema(self.schema).parquet(self.inbox))
        self.result = frame.schema
        query = stream.start(frame, self.ckpt, drain=True, **self.sink)
        query.awaitTermination()
        return query

    def rows(self):
        return sorted(map(tuple, self.spark.read.schema(self.result).parquet(self.out).collect()))


def test_windows_are_emitted_once_when_complete(spark, tmp_path):
    feed = Feed(spark, tmp_path, SENSOR_EVENT, lambda df: stream.window_stream(df, grace_ms=5_000))
    feed.send([("device-A", t, 1_000) for t in (20.0, 24.0, 22.0)])
    assert feed.rows() == []                            # open: stays in the state
    feed.send([("device-B", 1.0, 14_999)])
    assert feed.rows() == []                            # one millisecond short of end + grace
    feed.send([("device-B", 1.0, 15_000)])
    assert feed.rows() == [("device-A", 0, 10_000, 3, 66.0, 22.0, 24.0)]
    feed.send([("device-A", 99.0, 2_000), ("device-B", 1.0, 15_001)])   # too late, and no second emission
    assert len(feed.rows()) == 1


def test_stream_equals_batch_at_the_final_watermark(spark, tmp_path):
    feed = Feed(spark, tmp_path, SENSOR_EVENT, lambda df: stream.window_stream(df, 10_000, 3_000))
    events = spark.range(0, 3_000).select(
        F.concat(F.lit("device-"), (F.col("id") % 5).cast("string")).alias("device_id"),
        (F.col("id") % 50).cast("double").alias("temperature"), (F.col("id") * 97).alias("event_ms"))
    for lo in (0, 1_000, 2_000):
        feed.send(events.where((F.col("event_ms") >= lo * 97) & (F.col("event_ms") < (lo + 1_000) * 97)))
    last = events.agg(F.max("event_ms")).first()[0]
    assert feed.rows() == sorted(map(tuple, windows.windows_completed(events, last, 10_000, 3_000).collect()))


def test_late_rows_are_counted_one_by_one(spark, tmp_path):
    feed = Feed(spark, tmp_path, SENSOR_EVENT_ARRIVAL,
                lambda df: stream.window_stream(stream.counted(df, grace_ms=1_000), grace_ms=1_000))
    query = feed.send([("d", 1.0, 50_000, 50_000), ("d", 1.0, 1_000, 50_000), ("d", 1.0, 1_001, 50_000)])
    assert stream.run_report(query) == {"processed": 1, "late": 2, "active_windows": 1, "flushed_windows": 0}
    query = feed.send([("d", 1.0, 70_000, 70_000), ("d", 1.0, 50_001, 70_000)])
    assert stream.run_report(query) == {"processed": 1, "late": 1, "active_windows": 1, "flushed_windows": 1}


def test_arrival_stamp(spark, tmp_path):
    feed = Feed(spark, tmp_path, SENSOR_EVENT, lambda df: windows.late_rejects(stream.stamp_arrival(df)))
    feed.send([("d", 1.0, 1_000), ("d", 2.0, 4_000_000_000_000)])
    assert [r[:3] for r in feed.rows()] == [("d", 1.0, 1_000)]


def test_handler_receives_each_completed_window(spark, tmp_path):
    got = []
    feed = Feed(spark, tmp_path, SENSOR_EVENT, lambda df: stream.window_stream(df, grace_ms=0),
                handler=lambda frame, batch: got.extend(map(tuple, frame.select("device_id", "count").collect())))
    feed.send([("a", 1.0, 1), ("a", 2.0, 2), ("b", 1.0, 30_000)])
    assert got == [("a", 2)]


def test_start_needs_one_sink(spark):
    with pytest.raises(ValueError):
        stream.start(None, "x")


def attempt_rows(spark, first, last, repeat=()):
    rows = [(s % 2, f"device-{s}", f"reading-{s}", "p", s, 0, 1_000 + s, s) for s in range(first, last)]
    rows += [(s % 2, f"device-{s}", f"reading-{s}", "p", s, 1, 5_000 + s, s) for s in repeat]
    return spark.createDataFrame(rows, ATTEMPT)


@pytest.mark.parametrize("form", [False, True])
def test_appending_across_batches_equals_one_batch(spark, tmp_path, form):
    log = str(tmp_path / "log")
    feed = Feed(spark, tmp_path, ATTEMPT, lambda df: df, handler=appender.append_handler(log, form))
    parts = [attempt_rows(spark, 0, 80), attempt_rows(spark, 80, 140, repeat=range(75, 85)),
             attempt_rows(spark, 140, 200, repeat=[3, 139])]
    for part in parts:
        feed.send(part)
    stored = log_table.read_log(spark, log, STORED_LOG)
    whole = append.log_records(parts[0].union(parts[1]).union(parts[2]))
    key = ["partition", "offset", "key", "value", "producer_id", "seq"]
    assert stored.count() == 200 and audit.offset_audit(stored).where("NOT contiguous").isEmpty()
    assert sorted(map(tuple, stored.select(key).collect())) == sorted(map(tuple, whole.select(key).collect()))


def test_repeating_a_batch_changes_nothing(spark, tmp_path):
    log = str(tmp_path / "log")
    handle = appender.append_handler(log, query="by hand")
    handle(attempt_rows(spark, 0, 50), 0)
    handle(attempt_rows(spark, 50, 90), 1)
    before = sorted(map(tuple, log_table.read_log(spark, log).collect()))
    handle(attempt_rows(spark, 50, 90), 1)
    assert sorted(map(tuple, log_table.read_log(spark, log).collect())) == before
    handle(attempt_rows(spark, 90, 100, repeat=[89]), 2)
    assert log_table.read_log(spark, log).count() == 100
    assert log_table.last_state(spark, log, 3).agg(F.max("last_seq")).first()[0] == 99


def test_failure_before_a_batch_is_published(spark, tmp_path, monkeypatch):
    """The batch dies after its records are written; readers do not see it, and the restarted query stores it once."""
    log = str(tmp_path / "log")
    feed = Feed(spark, tmp_path, ATTEMPT, lambda df: df, handler=appender.append_handler(log))
    feed.send(attempt_rows(spark, 0, 40))

    def broken(_):
        raise RuntimeError("lost")
    with monkeypatch.context() as patch:
        patch.setattr(append, "producer_state", broken)
        with pytest.raises(Exception):
            feed.send(attempt_rows(spark, 40, 70))
    assert log_table.read_log(spark, log).count() == 40
    feed.send(attempt_rows(spark, 70, 90, repeat=[40, 69]))
    stored = log_table.read_log(spark, log, STORED_LOG)
    assert stored.count() == 90 and audit.offset_audit(stored).where("NOT contiguous").isEmpty()


def test_a_second_query_is_refused(spark, tmp_path):
    log = str(tmp_path / "log")
    appender.append_handler(log, query="a")(attempt_rows(spark, 0, 10), 0)
    with pytest.raises(ValueError):
        appender.append_handler(log, query="b")(attempt_rows(spark, 10, 17), 0)
    with pytest.raises(ValueError):
        appender.append_handler(log)(attempt_rows(spark, 10, 17), 0)
    assert log_table.read_log(spark, log).count() == 10


def test_counts_over_the_life_of_a_query(spark, tmp_path):
    out = str(tmp_path / "counts")
    feed = Feed(spark, tmp_path, SENSOR_EVENT_ARRIVAL, lambda df: stream.count_stream(df, grace_ms=1_000),
                handler=stream.keep_last(out), mode="complete")
    feed.send([("d", 1.0, 50_000, 50_000), ("d", 1.0, 1_000, 50_000)])
    feed.send([("d", 1.0, 60_000, 60_000), ("d", 1.0, 1_000, None), ("d", 1.0, 1_000, 90_000)])
    assert [tuple(r) for r in spark.read.schema("processed long, late long").parquet(out).select("processed", "late").collect()] == [(2, 3)]


def test_tail_continues_where_it_stopped(spark, tmp_path):
    log = str(tmp_path / "log")
    records = append.log_records(attempt_rows(spark, 0, 100))
    log_table.write_log(records.where("offset < 30"), log)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")

    def run():
        stream.start(log_table.tail(spark, log, 1), ckpt, path=out, drain=True).awaitTermination()
        return spark.read.parquet(out).count()
    assert run() == 60
    log_table.write_log(records.where("offset >= 30"), log)
    assert run() == 100
    assert run() == 100


def test_unreadable_rows_go_to_their_own_folder(spark, tmp_path):
    good, dead = str(tmp_path / "good"), str(tmp_path / "dead")
    feed = Feed(spark, tmp_path, "value string", lambda df: df, handler=stream.split_unreadable(good, dead))
    feed.send([('{"deviceId":"d","temperature":1.5,"timestamp":7}',), ("poison",)])
    feed.send([('{"deviceId":"e","temperature":2.5,"timestamp":8}',)])
    assert sorted(r.device_id for r in spark.read.parquet(good).collect()) == ["d", "e"]
    assert [r.value for r in spark.read.parquet(dead).collect()] == ["poison"]


def test_strict_stream_fails_on_poison(spark, tmp_path):
    feed = Feed(spark, tmp_path, "value string", lambda df: stream.strict_events(df).drop("value"))
    with pytest.raises(Exception):
        feed.send([("poison",)])


@pytest.mark.parametrize("text", ["junk", "{}", '{"deviceId":"d"}', '{"deviceId":"d","temperature":1.0}', None])
def test_strict_decode_fails_on_every_unusable_payload(spark, text):
    good = '{"deviceId":"d","temperature":1.5,"timestamp":7}'
    assert stream.strict_events(spark.createDataFrame([(good,)], "value string")).collect()[0].event_ms == 7
    with pytest.raises(Exception, match="unreadable event"):
        stream.strict_events(spark.createDataFrame([(good,), (text,)], "value string")).collect()


def test_whole_path_from_attempts_to_windows(spark, tmp_path):
    log = str(tmp_path / "log")
    text = F.format_string('{"deviceId":"device-%d","temperature":%d.0,"timestamp":%d}',
                           F.col("tie") % 3, F.col("tie") % 10, F.col("tie") * 500)
    sent = attempt_rows(spark, 0, 120, repeat=range(0, 120, 7)).withColumn("value", text)
    Feed(spark, tmp_path / "a", ATTEMPT, lambda df: df, handler=appender.append_handler(log)).send(sent)
    out = str(tmp_path / "w")
    result = stream.window_stream(decoded_events(log_table.tail(spark, log)), 10_000, 5_000)
    stream.start(result, str(tmp_path / "c"), path=out, drain=True).awaitTermination()
    counts = spark.read.schema(result.schema).parquet(out).groupBy("window_start_ms").agg(F.sum("count").alias("n"))
    assert {r.window_start_ms: r.n for r in counts.collect()} == {s: 20 for s in range(0, 50_000, 10_000)}


def ledger_run(spark, tmp_path, batches, schema=SENSOR_EVENT_ARRIVAL, size_ms=10_000, grace_ms=5_000):
    """Feeds batches one by one to the accounted windows; (emitted, open, report)."""
    ledger = stream.Ledger(spark, str(tmp_path / "ledger"))
    spark.streams.addListener(ledger)
    try:
        feed = Feed(spark, tmp_path, schema, lambda df: stream.window_stream(stream.accounted(df, "rows", size_ms, grace_ms), size_ms, grace_ms))
        for rows in batches:
            assert ledger.wait(feed.send(rows))
    finally:
        spark.streams.removeListener(ledger)
    return feed.rows(), sorted(map(tuple, stream.open_windows(spark, feed.ckpt).collect())), stream.ledger_report(spark, ledger.path).first()


def test_every_row_of_an_out_of_order_stream_is_accounted_for(spark, tmp_path):
    rng = random.Random(13)
    batches, marks, top = [], [], 0
    for n in range(4):
        rows = []
        for i in range(120):
            arrival = max(0, n - rng.choice([0, 0, 0, 1])) * 40_000 + rng.randrange(40_000)     # some are delivered late
            event = None if rng.random() < .02 else max(0, arrival - rng.choice([0, 0, 0, 3_000, 9_000, 25_000]))
            rows.append((rng.choice("abc"), float(i), event, arrival))
        batches.append(rows)
        marks.append(max(0, top - 5_000))
        top = max([top, *[r[2] for r in rows if r[2] is not None]])
    want = Counter()
    for rows, mark in zip(batches, marks):
        for _, _, event, arrival in rows:
            end = None if event is None else event // 10_000 * 10_000 + 10_000
            want["late" if end is None or end + 5_000 < arrival else "dropped" if end <= mark else "processed"] += 1
    emitted, held, report = ledger_run(spark, tmp_path, batches)
    assert {k: report[k] for k in ("processed", "late", "dropped")} == dict(want) and min(want.values()) > 0
    assert report.input_rows == 480 and report.missing == 0
    assert sum(r[3] for r in emitted) + sum(r[3] for r in held) == want["processed"]
    assert all(r[2] <= top - 5_000 for r in emitted) and held and all(r[2] > top - 5_000 for r in held)
    assert (report.active_windows, report.flushed_windows) == (len(held), len(emitted))


def test_judged_rows_keep_their_values(spark, tmp_path):
    schema = "device_id string, event_ms bigint, temperature double, n bigint, at timestamp, ok boolean, note string"
    rows = [("a", 5, float("nan"), 2**62 + 1, datetime(2024, 3, 1, 2, 3, 4, 5), True, None),
            (None, 7, None, None, None, None, "é 日本"), ("b", None, -0.1, -1, datetime(1960, 1, 1), False, "")]
    feed = Feed(spark, tmp_path, schema, stream.judge)
    feed.send(rows)
    got = spark.read.schema(feed.result).parquet(feed.out).collect()
    assert sorted(map(repr, (tuple(r)[:-1] for r in got))) == sorted(map(repr, rows))
    assert {r.device_id: r.verdict for r in got} == {"a": "processed", None: "processed", "b": "late"}
    with pytest.raises(TypeError):
        stream.judge(spark.readStream.schema("device_id string, event_ms bigint, x array<int>").parquet(feed.inbox))


def test_a_ledger_counts_more_batches_than_spark_reports(spark, tmp_path):
    """105 micro-batches, of which Spark keeps 100; files of the ledger are merged on the way."""
    inbox = str(tmp_path / "in")
    spark.range(0, 1_050, 1, 105).select(F.lit("d").alias("device_id"), F.col("id").cast("double").alias("temperature"),
                                         F.col("id").alias("event_ms"), (F.col("id") % 7 * 4_000).alias("arrival_ms")).write.parquet(inbox)
    frame = spark.readStream.schema(SENSOR_EVENT_ARRIVAL).option("maxFilesPerTrigger", 1).parquet(inbox)
    ledger = stream.Ledger(spark, str(tmp_path / "ledger"))
    spark.streams.addListener(ledger)
    try:
        query = stream.start(stream.counted(frame, "rows"), str(tmp_path / "ckpt"), handler=lambda df, n: df.count(), drain=True)
        query.awaitTermination()
        assert ledger.wait(query)
    finally:
        spark.streams.removeListener(ledger)
    report = stream.ledger_report(spark, ledger.path).first()
    late = sum(i // 10_000 * 10_000 + 15_000 < i % 7 * 4_000 for i in range(1_050))
    assert (report.input_rows, report.processed, report.late, report.missing) == (1_050, 1_050 - late, late, 0)
    assert report.batches >= 105 and len(query.recentProgress) <= 100
    assert len([n for n in os.listdir(ledger.path) if n.endswith(".json")]) < 20


def test_a_repeated_batch_is_counted_once(spark, tmp_path):
    ledger = stream.Ledger(spark, str(tmp_path))
    row = {"query": "q", "batch_id": 0, "input_rows": 5, "processed": 3, "late": 2, "dropped": 0, "active_windows": 1, "flushed_windows": 0}
    ledger._store([row], "q-0")
    ledger._store([row], "q-0")
    ledger._store([row, {**row, "batch_id": 2}], "q-0-to-2")
    report = stream.ledger_report(spark, str(tmp_path)).first()
    assert (report.processed, report.batches, report.missing) == (6, 2, 1)


def test_state_partitions_are_bounded(spark, tmp_path):
    """What tasks report of the state grows with the square of its partitions; the session's own number stays."""
    inbox, ckpt, name = str(tmp_path / "in"), str(tmp_path / "ckpt"), "spark.sql.shuffle.partitions"
    spark.createDataFrame([("d", 1.0, 1_000), ("d", 3.0, 20_000)], SENSOR_EVENT).coalesce(1).write.parquet(inbox)
    given = spark.conf.get(name)
    spark.conf.set(name, 80)
    try:
        result = stream.window_stream(spark.readStream.schema(SENSOR_EVENT).parquet(inbox))
        stream.start(result, ckpt, path=str(tmp_path / "out"), drain=True).awaitTermination()
        assert spark.conf.get(name) == "80"
    finally:
        spark.conf.set(name, given)
    made = spark.read.format("state-metadata").load(ckpt).select("numPartitions").distinct().collect()
    assert [r[0] for r in made] == [stream.STATE_PARTITIONS] and spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_flush_timer(spark, tmp_path):
    """The timer emits windows without a drain: rows arrive while the query runs."""
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    def send(*rows):
        spark.createDataFrame(rows, SENSOR_EVENT).coalesce(1).write.mode("append").parquet(inbox)
    send(("d", 1.0, 1_000), ("d", 3.0, 2_000))
    result = stream.window_stream(spark.readStream.schema(SENSOR_EVENT).parquet(inbox))
    query = stream.start(result, str(tmp_path / "ckpt"), path=out)
    try:
        deadline, held = time.time() + 60, 0
        sent = False
        while time.time() < deadline and not held:
            if not sent and query.lastProgress and query.lastProgress["batchId"] >= 0:
                send(("e", 1.0, 16_000))
                sent = True
            held = spark.read.schema(result.schema).parquet(out).count() if os.path.isdir(f"{out}/_spark_metadata") else 0
            time.sleep(0.5)
        assert query.isActive and [tuple(r)[:4] for r in spark.read.schema(result.schema).parquet(out).collect()] == [("d", 0, 10_000, 2)]
        assert stream.FLUSH_INTERVAL_MS == 2_000
    finally:
        query.stop()

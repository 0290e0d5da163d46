"""Tumbling windows over a stream: watermark, one emission per window, exact late counts, sinks."""

import json
import threading

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.functions.payload import decode
from tidemark.functions.scalar import average, event_time, is_late
from tidemark.operators.windows import RESULT, late_accept
from tidemark.schemas import FLUSH_INTERVAL_MS, GRACE_MS, RESULT_SCHEMA, STRING, WINDOW_MS
from tidemark.session import folders, remove, rename, write_text

COUNTED = ("processed", "late", "dropped")
STATE_PARTITIONS = 64  # of a new query's state, at most


def window_stream(events: DataFrame, size_ms=WINDOW_MS, grace_ms=GRACE_MS) -> DataFrame:
    """Windows per device in append mode: each is emitted once, when the watermark reaches its end.

    The watermark is the largest event time less the grace period, so a window leaves the state when
    ``end + grace <= largest event time``.
    """
    return (events
            .withColumn("event_ts", event_time("event_ms"))
            .withWatermark("event_ts", f"{grace_ms} milliseconds")
            .groupBy("device_id", F.window("event_ts", f"{size_ms} milliseconds"))
            .agg(F.count("*").alias("count"), F.sum("temperature").alias("sum"),
                 F.max("temperature").alias("max"))
            .withColumn("window_start_ms", F.unix_millis("window.start"))
            .withColumn("window_end_ms", F.unix_millis("window.end"))
            .withColumn("avg", average())
            .select(*RESULT))


def counted(events: DataFrame, name="late", size_ms=WINDOW_MS, grace_ms=GRACE_MS) -> DataFrame:
    """The accepted events, with exact processed and late counts as an observed metric of each micro-batch.

    Counted per row before the aggregate: the engine's own dropped-rows figure counts pre-aggregated rows.
    """
    late = is_late(size_ms=size_ms, grace_ms=grace_ms)
    seen = events.observe(name, F.count_if(~late).alias("processed"), F.count_if(late).alias("late"))
    return late_accept(seen, size_ms, grace_ms)


def judge(events: DataFrame, size_ms=WINDOW_MS, grace_ms=GRACE_MS, lanes=None) -> DataFrame:
    """Adds ``verdict`` to each row of a stream: ``processed``, ``late`` or ``dropped``.

    ``late`` is decided by the row's own ``arrival_ms``, where it has one; a row without an event time is late. ``dropped`` is
    decided by the watermark in force in the row's micro-batch: the row's window has been emitted, so a window aggregate could
    no longer take it in. All others are ``processed``, and ``window_stream`` after this step drops nothing.

    The watermark of a batch is known to stateful operators alone, so rows pass through one, which keeps no state. It deals them
    out by a hash of device and time, so that a hot device is split. Columns must be of atomic types; their values go as text.
    """
    size = F.lit(size_ms).cast("long")
    late = F.col("event_ms").isNull()
    if "arrival_ms" in events.columns:
        late = late | F.coalesce(is_late(size_ms=size_ms, grace_ms=grace_ms), F.lit(True))
    lanes = lanes or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = (events.withColumn("_event_ts", event_time("event_ms")).withWatermark("_event_ts", f"{grace_ms} milliseconds")
              .select(F.pmod(F.xxhash64("device_id", "event_ms"), F.lit(lanes)).cast("int").alias("_lane"), "_event_ts",
                      late.alias("_late"), F.coalesce(F.col("event_ms") - F.pmod("event_ms", size) + size, F.lit(0)).alias("_end"),
                      *[_as_text(f).alias(f"_c{i}") for i, f in enumerate(events.schema.fields)]))
    texts = [f"_c{i}" for i in range(len(events.columns))]
    judged = T.StructType([T.StructField(c, STRING) for c in [*texts, "verdict"]])

    def decide(key, frames, state):
        watermark = state.getCurrentWatermarkMs()
        for frame in frames:
            out = frame[texts].copy()
            behind = (frame["_end"] <= watermark).map({True: "dropped", False: "processed"})
            out["verdict"] = behind.where(~frame["_late"].astype(bool), "late")
            yield out

    rows = marked.groupBy("_lane").applyInPandasWithState(decide, judged, "unused boolean", "append", "NoTimeout")
    return rows.select(*[_from_text(F.col(t), f).alias(f.name) for t, f in zip(texts, events.schema.fields)], "verdict")


def _as_text(field):
    name = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.TimestampType):
        return F.unix_micros(name).cast("string")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        raise TypeError(f"column {field.name} is not of an atomic type")
    return name.cast("string")


def _from_text(text, field):
    if isinstance(field.dataType, T.TimestampType):
        return F.timestamp_micros(text.cast("long"))
    return text.cast(field.dataType)


def accounted(events: DataFrame, name="rows", size_ms=WINDOW_MS, grace_ms=GRACE_MS) -> DataFrame:
    """The processed rows, with exact counts of processed, late and dropped ones as an observed metric of each micro-batch.

    Every row read is one of the three, and every processed row is a reading of one window: emitted, or open in the state.
    """
    is_ = lambda verdict: F.count_if(F.col("verdict") == verdict).alias(verdict)
    seen = judge(events, size_ms, grace_ms).observe(name, is_("processed"), is_("late"), is_("dropped"))
    return seen.where("verdict = 'processed'").drop("verdict")


def open_windows(spark, checkpoint: str) -> DataFrame:
    """The windows that a query of ``window_stream`` still holds open, read from the state in its checkpoint; no query need run."""
    held = spark.read.format("state-metadata").load(checkpoint).where("operatorName = 'stateStoreSave'").select("operatorId").distinct()
    operator = held.first()
    if operator is None:
        return spark.createDataFrame([], RESULT_SCHEMA)
    state = spark.read.format("statestore").option("operatorId", operator[0]).load(checkpoint)
    return (state.select(F.col("key.device_id"), F.unix_millis("key.window.start").alias("window_start_ms"),
                         F.unix_millis("key.window.end").alias("window_end_ms"), "value.*")
            .withColumn("avg", average()).select(*RESULT))


def count_stream(events: DataFrame, size_ms=WINDOW_MS, grace_ms=GRACE_MS) -> DataFrame:
    """``processed, late``: exact counts over the whole life of a query, kept in its state (mode ``complete``)."""
    late = ~F.coalesce(~is_late(size_ms=size_ms, grace_ms=grace_ms), F.lit(False))
    return events.groupBy().agg(F.count_if(~late).alias("processed"), F.count_if(late).alias("late"))


def keep_last(path: str):
    """A handler that stores the result of the last batch; readers see a batch only once it is whole."""
    def handle(frame: DataFrame, batch_id: int):
        spark, staged = frame.sparkSession, f"{path}/_staged"
        remove(spark, staged)
        frame.write.parquet(staged)
        remove(spark, f"{path}/batch_id={batch_id}")
        rename(spark, staged, f"{path}/batch_id={batch_id}")
        for name in folders(spark, path):
            if name.startswith("batch_id=") and name != f"batch_id={batch_id}":
                remove(spark, f"{path}/{name}")
    return handle


def stamp_arrival(events: DataFrame) -> DataFrame:
    """Adds ``arrival_ms``, the time the micro-batch began; a repeated batch gets the same time again."""
    return events.withColumn("arrival_ms", F.unix_millis(F.current_timestamp()))


class Ledger(StreamingQueryListener):
    """Stores what each micro-batch of a query reports, by batch id, so that counters cover the query's whole life.

    Spark itself keeps only recent reports. A small file per batch is published by rename; every ``MERGE`` files are merged into
    one. A batch that is repeated after a failure is stored again under its own id and counted once. Register it with
    ``spark.streams.addListener`` before the query starts; ``ledger_report`` reads it at any time.
    """

    MERGE = 100

    def __init__(self, spark, path: str, name="rows"):
        self.spark, self.path, self.name = spark, path, name
        self._ended, self._loose = {}, []
        self._change = threading.Condition()

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        progress = event.progress
        metric = progress.observedMetrics.get(self.name)
        windows = [s for s in progress.stateOperators if s.operatorName == "stateStoreSave"]
        row = {"query": str(progress.id), "batch_id": progress.batchId, "input_rows": progress.numInputRows,
               **{k: 0 for k in COUNTED}, **({k: v or 0 for k, v in metric.asDict().items() if k in COUNTED} if metric else {}),
               "active_windows": sum(s.numRowsTotal for s in windows), "flushed_windows": sum(s.numRowsRemoved for s in windows)}
        self._loose.append(row)
        self._store([row], f"{row['query']}-{row['batch_id']}")
        if len(self._loose) >= self.MERGE:
            merged, self._loose = self._loose, []
            self._store(merged, f"{merged[0]['query']}-{merged[0]['batch_id']}-to-{merged[-1]['batch_id']}")
            for one in merged:  # a reader that meets both counts a batch once
                remove(self.spark, f"{self.path}/{one['query']}-{one['batch_id']}.json")

    def onQueryTerminated(self, event):
        with self._change:
            self._ended[str(event.runId)] = True
            self._change.notify_all()

    def _store(self, rows, name):
        staged, final = f"{self.path}/_{name}.json", f"{self.path}/{name}.json"
        write_text(self.spark, staged, "".join(json.dumps(r) + "\n" for r in rows))
        remove(self.spark, final)
        rename(self.spark, staged, final)

    def wait(self, query, seconds=60) -> bool:
        """Waits until everything that an ended query has reported is stored; false if that takes too long."""
        with self._change:
            return self._change.wait_for(lambda: str(query.runId) in self._ended, seconds)


def ledger_rows(spark, path: str) -> DataFrame:
    """One row for each query and micro-batch."""
    schema = T.StructType([T.StructField("query", STRING), *[T.StructField(c, T.LongType()) for c in
                          ("batch_id", "input_rows", *COUNTED, "active_windows", "flushed_windows")]])
    return spark.read.schema(schema).json(path).dropDuplicates(["query", "batch_id"])


def ledger_report(spark, path: str) -> DataFrame:
    """Per query of a ledger: rows read, processed, late and dropped, windows flushed, windows still active after the last batch,
    micro-batches stored, and ``missing``, those that ran but left no report because the driver died."""
    sums = [F.sum(c).alias(c) for c in ("input_rows", *COUNTED, "flushed_windows")]
    return ledger_rows(spark, path).groupBy("query").agg(
        *sums, F.max_by("active_windows", "batch_id").alias("active_windows"), F.count("*").alias("batches"),
        (F.max("batch_id") + 1 - F.count("*")).alias("missing"))


def run_report(query, name="late") -> dict:
    """Recent counters of a windowed query: processed and late events, windows still active, windows flushed.

    For a glance at a running query: summed over the micro-batches that it still reports (see
    ``spark.sql.streaming.numRecentProgressUpdates``). A ``Ledger`` covers a query's whole life.
    """
    report = {"processed": 0, "late": 0, "active_windows": 0, "flushed_windows": 0}
    for progress in query.recentProgress:
        metric = progress.observedMetrics.get(name)
        for key, value in (metric.asDict() if metric else {}).items():
            report[key] += value or 0
        for state in progress.stateOperators:
            report["active_windows"] = state.numRowsTotal
            report["flushed_windows"] += state.numRowsRemoved
    return report


def start(df: DataFrame, checkpoint: str, *, path=None, handler=None, drain=False,
          interval_ms=FLUSH_INTERVAL_MS, mode="append", state_partitions=None):
    """Starts a query that appends to a parquet folder, or hands every batch to ``handler(frame, batch_id)``.

    Every task of a stateful step reports a metric for each partition of the state, so what reaches the driver in a batch grows
    with the square of their number. A new query therefore gets the session's shuffle partitions, but at most ``state_partitions``
    (``STATE_PARTITIONS``, or with a handler, whose own shuffles they would also bound, no limit); one with a checkpoint keeps
    those it has.

    It runs every ``interval_ms``, or with ``drain`` handles what is there and stops; windows that are still
    open then stay in the checkpointed state and are finished by a later run.
    """
    if (path is None) == (handler is None):
        raise ValueError("give either a path or a handler")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = (writer.trigger(availableNow=True) if drain
              else writer.trigger(processingTime=f"{interval_ms} milliseconds"))
    writer = writer.format("parquet").option("path", path) if handler is None else writer.foreachBatch(handler)
    conf, name = df.sparkSession.conf, "spark.sql.shuffle.partitions"
    given = conf.get(name)
    most = state_partitions or (STATE_PARTITIONS if handler is None else int(given))
    conf.set(name, min(int(given), most))
    try:
        return writer.start()  # the query keeps the settings of this moment
    finally:
        conf.set(name, given)


def split_unreadable(good_path: str, dead_path: str):
    """A batch handler that stores decoded rows and unreadable rows apart, each batch in its own folder.

    Replaying a batch overwrites its own folders, so nothing is stored twice.
    """
    def handle(frame: DataFrame, batch_id: int):
        marked = decode(frame).persist()
        try:
            (marked.where("readable").drop("readable")
             .write.mode("overwrite").parquet(f"{good_path}/batch_id={batch_id}"))
            (marked.where("NOT readable").select(*frame.columns)
             .write.mode("overwrite").parquet(f"{dead_path}/batch_id={batch_id}"))
        finally:
            marked.unpersist()
    return handle


def strict_events(df: DataFrame, value="value") -> DataFrame:
    """Decodes a stream or table and fails the query at the first row that is malformed or lacks a field."""
    marked = decode(df, value)
    broken = F.raise_error(F.concat(F.lit("unreadable event: "), F.coalesce(F.col(value), F.lit("null"))))
    checked = [F.when(F.col("readable"), F.col(c)).otherwise(broken.cast(marked.schema[c].dataType)).alias(c)
               for c in ("device_id", "temperature", "event_ms")]
    return marked.select(*df.columns, *checked)

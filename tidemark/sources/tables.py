"""Adapters from the given tables to the inputs the operators take."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.payload import event_to_json
from tidemark.functions.routing import key_partition
from tidemark.functions.scalar import backdated
from tidemark.plans.ordered import number_rows
from tidemark.schemas import ATTEMPT
from tidemark.session import is_folder

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])

SHIPMENTS = T.StructType([
    T.StructField("l_suppkey", T.LongType()), T.StructField("l_quantity", T.DoubleType()),
    T.StructField("l_shipdate", T.TimestampNTZType())])

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS


def epoch_ms(ts: str):
    """Epoch milliseconds of a zone-free timestamp, read as UTC whatever the session's time zone."""
    since = F.expr(f"{ts} - TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    hours = F.extract(F.lit("DAY"), since).cast("long") * 24 + F.extract(F.lit("HOUR"), since)
    minutes = hours * 60 + F.extract(F.lit("MINUTE"), since)
    return minutes * 60_000 + F.floor(F.extract(F.lit("SECOND"), since) * 1000).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table, one file or a folder of files, read as a stream of files."""
    path = f"{sf_dir}/events.parquet"
    if is_folder(spark, path):
        return spark.readStream.schema(EVENTS).parquet(path)
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def as_sensor_events(rows: DataFrame) -> DataFrame:
    """``event_id, event_type, device_id, temperature, event_ms`` of a batch or streaming frame of events."""
    return rows.select("event_id", "event_type",
                       F.concat(F.lit("device-"), F.col("user_id").cast("string")).alias("device_id"),
                       F.col("value").alias("temperature"), epoch_ms("ts").alias("event_ms"))


def at_ms(ms):
    """A time in epoch milliseconds as a zone-free timestamp in UTC, for comparison with a stored one."""
    return (F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=F.lit(ms) / 1000)).cast("timestamp_ntz")


def sensor_events(spark: SparkSession, sf_dir: str, from_ms=None, before_ms=None) -> DataFrame:
    """Events as readings; the optional bounds on the event time reach the scan, where ``ts`` is stored."""
    rows = events(spark, sf_dir)
    rows = rows if from_ms is None else rows.where(F.col("ts") >= at_ms(from_ms))
    return as_sensor_events(rows if before_ms is None else rows.where(F.col("ts") < at_ms(before_ms)))


def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor events with an arrival time; every 33rd one is moved 1 to 8 hours into the past."""
    return late_variant(sensor_events(spark, sf_dir))


def late_variant(readings: DataFrame) -> DataFrame:
    """The same of any batch or streaming frame of sensor events."""
    rows = readings.withColumnRenamed("event_ms", "arrival_ms")
    return rows.withColumn("event_ms", backdated("arrival_ms", "event_id", every=33, step_ms=HOUR_MS))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest table as sensor events: supplier as device, quantity as reading, ship date as event time."""
    rows = spark.read.schema(SHIPMENTS).parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(F.concat(F.lit("device-"), F.col("l_suppkey").cast("string")).alias("device_id"),
                       F.col("l_quantity").alias("temperature"), epoch_ms("l_shipdate").alias("event_ms"))


def append_attempts(spark: SparkSession, sf_dir: str, partitions=4, direct=False) -> DataFrame:
    """One first attempt per event, and for every 50th event a retry one second later with the same sequence.

    The event type plays the producer; its sequence counter runs over all partitions.
    """
    numbered = number_rows(sensor_events(spark, sf_dir), ["event_type"], ["event_id"], "seq", direct)
    first = numbered.select(
        key_partition("device_id", partitions).alias("partition"), F.col("device_id").alias("key"),
        event_to_json().alias("value"), F.col("event_type").alias("producer_id"), "seq",
        F.lit(0).alias("attempt"), F.col("event_ms").alias("arrival_ms"), F.col("event_id").alias("tie"))
    # One row per attempt from a single read of the events: 0 for all of them, and 1 for the retried ones.
    tries = F.when(F.col("tie") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (first.withColumn("attempt", F.explode(tries))
            .withColumn("arrival_ms", F.col("arrival_ms") + F.col("attempt").cast("long") * 1000)
            .select(*ATTEMPT.names))


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One device per customer; many of them never sent an event."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customers.select(F.concat(F.lit("device-"), F.col("c_custkey").cast("string")).alias("device_id"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency samples from the events: value as milliseconds times ten, errors as failures."""
    return events(spark, sf_dir).select(
        F.lit(0).cast("long").alias("start_ns"),
        (F.round(F.col("value") * 100).cast("long") * 10_000_000).alias("end_ns"),
        (F.col("event_type") != "error").alias("success"), "event_type", "user_id")

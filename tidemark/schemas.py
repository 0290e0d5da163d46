"""Explicit schemas and the fixed parameters every operator shares. Nothing is ever inferred."""

from pyspark.sql import types as T

# Fixed values that results depend on.
WINDOW_MS = 10_000
GRACE_MS = 5_000
FLUSH_INTERVAL_MS = 2_000
LATE_FLAG_MS = 500
LIVENESS_TIMEOUT_MS = 5 * 1_000
MAX_FAILED_WRITES = 10
PERCENTILES = (50, 95, 99)

LONG, DOUBLE, STRING, INT, BOOLEAN = (
    T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType(), T.BooleanType())


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# JSON payload of a record: these names and this order are the wire format.
EVENT_JSON = _struct(("deviceId", STRING), ("temperature", DOUBLE), ("timestamp", LONG))

SENSOR_EVENT = _struct(("device_id", STRING), ("temperature", DOUBLE), ("event_ms", LONG))
SENSOR_EVENT_ARRIVAL = T.StructType(SENSOR_EVENT.fields + [T.StructField("arrival_ms", LONG, True)])

# What a producer sends. (arrival_ms, attempt, tie) is a total order: `tie` is unique per attempt number.
ATTEMPT = _struct(("partition", INT), ("key", STRING), ("value", STRING), ("producer_id", STRING),
                  ("seq", LONG), ("attempt", INT), ("arrival_ms", LONG), ("tie", LONG))

# One log record; `partition` is the directory column of the stored table.
LOG = _struct(("partition", INT), ("offset", LONG), ("key", STRING), ("value", STRING), ("timestamp", LONG))

# The stored log also keeps who wrote the record, so producer state can be rebuilt from it.
STORED_LOG = T.StructType(LOG.fields + [T.StructField("producer_id", STRING, True),
                                        T.StructField("seq", LONG, True)])

SAMPLE = _struct(("start_ns", LONG), ("end_ns", LONG), ("success", BOOLEAN))

PRODUCER_STATE = _struct(("partition", INT), ("producer_id", STRING),
                         ("last_seq", LONG), ("last_offset", LONG))

# A window and its result.
RESULT_SCHEMA = _struct(("device_id", STRING), ("window_start_ms", LONG), ("window_end_ms", LONG), ("count", LONG),
                        ("sum", DOUBLE), ("avg", DOUBLE), ("max", DOUBLE))

"""JSON payload of a record: encode, decode, and the split between good and unreadable rows."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.schemas import EVENT_JSON, STRING

CORRUPT = "_unreadable"


def event_to_json(device="device_id", temperature="temperature", timestamp="event_ms") -> Column:
    return F.to_json(F.struct(F.col(device).alias("deviceId"),
                              F.col(temperature).alias("temperature"),
                              F.col(timestamp).alias("timestamp")))


def event_from_json(value="value", strict=False) -> Column:
    """STRUCT<deviceId, temperature, timestamp>. ``strict`` fails the query on the first malformed text."""
    if strict:
        return F.from_json(F.col(value), EVENT_JSON, {"mode": "FAILFAST"})
    schema = T.StructType(EVENT_JSON.fields + [T.StructField(CORRUPT, STRING, True)])
    return F.from_json(F.col(value), schema,
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def _unpacked(event: Column) -> Column:
    ok = (event[CORRUPT].isNull() & event["deviceId"].isNotNull()
          & event["temperature"].isNotNull() & event["timestamp"].isNotNull())
    return F.struct(ok.alias("readable"),
                    F.when(ok, event["deviceId"]).alias("device_id"),
                    F.when(ok, event["temperature"]).alias("temperature"),
                    F.when(ok, event["timestamp"]).alias("event_ms"))


def decode(df: DataFrame, value="value") -> DataFrame:
    """Adds ``readable, device_id, temperature, event_ms``; works on batch and streaming frames alike.

    A row whose text is malformed or lacks a field keeps its raw value and has ``readable = false``. The
    columns come out of a one-element generator: the optimizer cannot copy the parser into later filters, so
    every text is parsed once.
    """
    parsed = F.transform(F.array(event_from_json(value)), _unpacked)
    return df.select("*", F.inline(parsed))


def decoded_events(df: DataFrame, value="value") -> DataFrame:
    return decode(df, value).where("readable").drop("readable")


def dead_letters(df: DataFrame, value="value") -> DataFrame:
    """Rows that cannot be decoded, as they came: a side output instead of an endless retry."""
    return decode(df, value).where("NOT readable").select(*df.columns)

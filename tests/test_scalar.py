"""Scalar rules on literal fixtures."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import payload, scalar
from tidemark.functions.routing import key_hash, key_partition
from tidemark.operators.windows import lateness_profile
from tidemark.sources.tables import epoch_ms


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("ms, start", [(0, 0), (1, 0), (9_999, 0), (10_000, 10_000), (15_300, 10_000),
                                       (-1, -10_000), (-10_000, -10_000)])
def test_window_start(spark, ms, start):
    at = F.lit(ms).cast("long")
    row = one(spark, s=scalar.window_start(at), e=scalar.window_end(scalar.window_start(at)))
    assert (row.s, row.e) == (start, start + 10_000)


def test_window_start_equals_time_window(spark):
    rows = spark.range(0, 100_000, 777).select((F.col("id") * 13).alias("event_ms"))
    both = rows.select(scalar.window_start().alias("a"),
                       F.unix_millis(F.window(scalar.event_time(), "10 seconds")["start"]).alias("b"))
    assert both.where("a <> b").isEmpty()


def utf16_hash(text):
    h = 0
    data = text.encode("utf-16-be")
    for i in range(0, len(data), 2):
        h = (h * 31 + int.from_bytes(data[i:i + 2], "big")) & 0xFFFFFFFF
    return h & 0x7FFFFFFF


def test_key_hash_of_known_key(spark):
    row = one(spark, h=key_hash(F.lit("device-X")), p=key_partition(F.lit("device-X"), 4))
    assert (row.h, row.p) == (1_109_190_305, 1)


def test_key_hash_equals_model(spark):
    keys = ["", "a", "device-0", "é", "日本", "\U0001F600x", "x\U0001F600", "￿", "ÅngströmÅ", "z" * 300,
            "polygenelubricants", "\U0010FFFF", "a.b|c*", " lead", "tail "] + [f"device-{i}" for i in range(500)]
    rows = (spark.createDataFrame([(k,) for k in keys], "k string")
            .select("k", key_hash("k").alias("h"), key_partition("k", 7).alias("p")).collect())
    assert {r.k: (r.h, r.p) for r in rows} == {k: (utf16_hash(k), utf16_hash(k) % 7) for k in keys}


def test_key_hash_keeps_null_and_needs_a_partition(spark):
    assert one(spark, h=key_hash(F.lit(None).cast("string"))).h is None
    with pytest.raises(ValueError):
        key_partition("k", 0)


def test_rounding_and_latency(spark):
    rows = (spark.createDataFrame([(22.25, 0, 1_999_999), (22.24, 5, 1_000_004)], "x double, start_ns long, end_ns long")
            .select(scalar.round_half_up_1dp("x").alias("r"), scalar.latency_ms().alias("l")).collect())
    assert [(r.r, r.l) for r in rows] == [(22.3, 1), (22.2, 0)]


def test_latency_is_exact_for_long_spans(spark):
    big = 9_007_199_254_740_993 * 100
    row = spark.createDataFrame([(0, big)], "start_ns long, end_ns long").select(scalar.latency_ms().alias("l")).first()
    assert row.l == big // 1_000_000


def test_window_text(spark):
    df = spark.createDataFrame([("device-A", 10_000, 20_000, 4, 22.25, 24.0)],
                               "device_id string, window_start_ms long, window_end_ms long, count long, avg double, max double")
    assert df.select(scalar.window_line().alias("t")).first().t == \
        "Window[device-A@[10000,20000)] -> count=4, avg=22.3, max=24.0"


def test_window_report_line(spark):
    df = spark.createDataFrame([("d", 0, 10_000, 4, 22.25, 104.0)],
                               "device_id string, window_start_ms long, window_end_ms long, count long, avg double, max double")
    assert df.select(scalar.window_report().alias("t")).first().t == \
        "[WINDOW] d@[0,10000)          | count=   4 | avg= 22.3°C | max=104.0°C"


def test_average_guard(spark):
    rows = spark.createDataFrame([(0.0, 0), (66.0, 3)], "sum double, count long").select(scalar.average().alias("a"))
    assert [r.a for r in rows.collect()] == [0.0, 22.0]


def test_json_text_and_round_trip(spark):
    df = spark.createDataFrame([("device-1", 20.0, 5)], "device_id string, temperature double, event_ms long")
    text = df.select(payload.event_to_json().alias("value"))
    assert text.first().value == '{"deviceId":"device-1","temperature":20.0,"timestamp":5}'
    back = payload.decoded_events(text).select("device_id", "temperature", "event_ms").first()
    assert tuple(back) == ("device-1", 20.0, 5)


JSON_ROWS = [('{"deviceId":"d","temperature":1.5,"timestamp":7}',), ('{"deviceId":"d"}',), ("not json",),
             ('{"deviceId":"d","temperature":1.5,"timestamp":7,"unit":"C"}',), (None,), ("",)]


def test_json_dead_letters(spark):
    df = spark.createDataFrame(JSON_ROWS, "value string")
    good = payload.decoded_events(df)
    assert good.count() == 2 and {r.event_ms for r in good.collect()} == {7}
    assert sorted(r.value or "" for r in payload.dead_letters(df).collect()) == \
        sorted(["", "", "not json", '{"deviceId":"d"}'])


def test_json_strict_fails(spark):
    df = spark.createDataFrame(JSON_ROWS[2:3], "value string")
    with pytest.raises(Exception):
        df.select(payload.event_from_json(strict=True)).collect()


def test_lateness(spark):
    df = spark.createDataFrame([(0, 500), (0, 501), (10, 10)], "event_ms long, arrival_ms long")
    row = lateness_profile(df, 500).first()
    assert (row.events, row.late, row.on_time, row.max_lateness_ms) == (3, 1, 2, 501)


def test_backdating(spark):
    rows = spark.range(0, 70).select("id", scalar.backdated(F.lit(100_000), "id").alias("t")).collect()
    assert {r.id: r.t for r in rows if r.t != 100_000} == {
        n: 100_000 - (1 + n % 8) * 1_000 for n in (0, 33, 66)}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_epoch_ms_ignores_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("""SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-03-10 02:30:00.123999'),
                          (TIMESTAMP_NTZ'1969-12-31 23:59:59.9985'), (TIMESTAMP_NTZ'2024-11-03 01:30:00') t(ts)""")
        assert [r.m for r in df.select(epoch_ms("ts").alias("m")).collect()] == [1710037800123, -2, 1730597400000]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")

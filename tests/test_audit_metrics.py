"""Audits, percentiles and run summaries."""

import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, metrics, windows
from tidemark.schemas import SENSOR_EVENT

OFFSETS = "partition int, offset long"


@pytest.mark.parametrize("offsets, want", [
    ([0, 1, 2, 3], (4, 0, 3, 0, 0, True)),
    ([0, 1, 3, 3, 4], (5, 0, 4, 1, 1, False)),
    ([1, 2], (2, 1, 2, 0, 1, False)),
    ([0, 0, 0], (3, 0, 0, 2, 0, False)),
    ([0, 40_000], (2, 0, 40_000, 0, 39_999, False)),
    (list(range(70_000)), (70_000, 0, 69_999, 0, 0, True)),
])
def test_offset_audit(spark, offsets, want):
    df = spark.createDataFrame([(0, o) for o in offsets], OFFSETS).repartition(3)
    row = audit.offset_audit(df).first()
    assert (row.records, row.first_offset, row.last_offset, row.duplicates, row.missing, row.contiguous) == want


def test_offset_duplicates(spark):
    df = spark.createDataFrame([(0, o) for o in (0, 1, 3, 3, 4)] + [(1, 3)], OFFSETS)
    assert [tuple(r) for r in audit.offset_duplicates(df).collect()] == [(0, 3, 2)]


RECORD = "partition int, offset long, key string, value string, timestamp long"


def test_replica_diff_classes(spark):
    left = spark.createDataFrame([(0, 0, "a", "x", 1), (0, 1, "b", None, 2), (0, 2, "c", "z", 3), (0, 3, "d", "w", 4),
                                  (0, 4, "e", "v", 5), (0, 4, "e", "v", 5)], RECORD)
    right = spark.createDataFrame([(0, 0, "a", "x", 1), (0, 1, "b", None, 2), (0, 2, "c", "CHANGED", 3), (1, 3, "d", "w", 4),
                                   (0, 4, "e", "v", 5)], RECORD)
    got = {(r.partition, r.offset): r.status for r in audit.replica_diff(left, right).collect()}
    assert got == {(0, 0): "same", (0, 1): "same", (0, 2): "differs", (0, 3): "missing_right",
                   (1, 3): "missing_left", (0, 4): "differs"}


def test_replica_diff_with_one_offset_on_a_third_of_the_rows(spark):
    base = spark.range(0, 3_000, 1, 4).select(
        F.lit(0).alias("partition"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("long").alias("offset"),
        F.lit("k").alias("key"), F.col("id").cast("string").alias("value"), F.col("id").alias("timestamp"))
    assert audit.replica_diff(base, base).where("status <> 'same'").isEmpty()


def test_loss(spark):
    produced = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], OFFSETS)
    consumed = spark.createDataFrame([(0, 0), (0, 1), (0, 1), (1, 1), (2, 5)], OFFSETS)
    got = {r.partition: (r.produced, r.consumed, r.difference, r.lost)
           for r in audit.reconcile_loss(produced, consumed).collect()}
    assert got == {0: (2, 3, -1, 0), 1: (2, 1, 1, 1), 2: (0, 1, -1, 0)}
    assert [tuple(r) for r in audit.lost_records(produced, consumed).collect()] == [(1, 0)]


def test_lost_records_with_null_keys(spark):
    produced = spark.createDataFrame([(0, 0), (0, 1), (0, None), (None, 5), (None, None)], OFFSETS)
    consumed = spark.createDataFrame([(0, 0), (None, None)], OFFSETS)
    got = {tuple(r) for r in audit.lost_records(produced, consumed).collect()}
    assert got == {(0, 1), (0, None), (None, 5)}


def test_lost_records_over_many_blocks(spark):
    produced = spark.range(0, 300_000, 1, 4).select((F.col("id") % 2).cast("int").alias("partition"),
                                                    F.expr("id div 2").alias("offset"), F.lit("v").alias("value"))
    gone = (F.col("offset") == 0) | (F.col("offset") == 149_999) & (F.col("partition") == 1)
    got = audit.lost_records(produced, produced.where(~gone)).collect()
    assert sorted((r.partition, r.offset) for r in got) == [(0, 0), (1, 0), (1, 149_999)]
    plan = audit.lost_records(produced, produced.where(~gone))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "LeftAnti" in plan


def test_liveness(spark):
    roster = spark.createDataFrame([("on",), ("over",), ("never",)], "device_id string")
    seen = spark.createDataFrame([("on", 1.0, 95_000), ("on", 1.0, 10), ("over", 1.0, 94_999)],
                                 "device_id string, temperature double, event_ms long")
    got = {r.device_id: (r.last_seen_ms, r.alive) for r in audit.device_liveness(roster, seen, 100_000).collect()}
    assert got == {"on": (95_000, True), "over": (94_999, False), "never": (None, False)}


LOG = "partition int, offset long, key string, producer_id string, seq long"


@pytest.mark.parametrize("form", [None, 0])
def test_order_audit(spark, form):
    rows = [(1, 0, "device-X", "p", 0), (1, 1, "device-X", "p", 2), (1, 2, "device-X", "p", 1),
            (1, 3, "device-X", "q", 0), (0, 0, "device-X", "p", 3)]
    got = {r.partition: (r.records, r.out_of_order, r.misrouted)
           for r in audit.order_audit(spark.createDataFrame(rows, LOG), 4, form).collect()}
    assert got == {1: (4, 1, 0), 0: (1, 0, 1)}
    assert tuple(audit.key_placement(spark.createDataFrame(rows, LOG)).first()) == (1, 1)


SAMPLES = "start_ns long, end_ns long, success boolean"


def test_verdict(spark):
    log = spark.createDataFrame([(0, o) for o in range(5)], OFFSETS)
    def run(failures, consumed):
        s = spark.createDataFrame([(0, 1, False)] * failures + [(0, 1, True)], SAMPLES)
        return tuple(audit.run_verdict(s, log, consumed).first())
    assert run(10, log) == (10, 0, True)
    assert run(11, log) == (11, 0, False)
    assert run(0, log.where("offset > 0")) == (0, 1, False)
    assert run(0, log.union(log)) == (0, 0, True)


def nearest(values, p):
    ordered = sorted(values)
    return ordered[max(0, math.ceil(p / 100 * len(ordered)) - 1)]


def ranked(df, **options):
    return metrics.nearest_rank(df, "x", (0, 1, 50, 95, 99, 100), **options)


def test_percentiles_of_one_to_a_hundred(spark):
    df = spark.range(1, 101).select(F.col("id").alias("x"))
    assert tuple(metrics.nearest_rank(df, "x").first()) == (50, 95, 99)
    assert tuple(metrics.nearest_rank(df.limit(0), "x").first()) == (0, 0, 0)


def test_percentiles_equal_the_sorted_list(spark):
    rng = random.Random(5)
    groups = {n: [rng.choice([rng.randrange(5), rng.randrange(10 ** 6), -rng.randrange(10 ** 9), 7]) for _ in range(n)]
              for n in list(range(1, 20)) + [63, 500]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, x long").repartition(6)
    for row in ranked(df, by=["g"]).collect():
        assert tuple(row)[1:] == tuple(nearest(groups[row.g], p) for p in (0, 1, 50, 95, 99, 100))
    everything = [v for vs in groups.values() for v in vs]
    assert tuple(ranked(df).first()) == tuple(nearest(everything, p) for p in (0, 1, 50, 95, 99, 100))


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(None, n, True) for n in range(1, 101)] + [("a", 7, True), (None, 5, False)],
                               "run string, ms long, success boolean")
    got = {r.run: (r.p50, r.p99) for r in metrics.nearest_rank(df.where("success"), "ms", by=["run"]).collect()}
    assert got == {None: (50, 99), "a": (7, 7)}
    timed = df.selectExpr("run", "0L AS start_ns", "ms * 1000000 AS end_ns", "success")
    got = {r.run: (r.succeeded, r.failed, r.p95) for r in metrics.latency_summary(timed, by=["run"]).collect()}
    assert got == {None: (100, 1, 95), "a": (1, 0, 7)}


def test_summary(spark):
    rows = [(0, n * 1_000_000 + 999_999, True) for n in range(1, 101)] + [(0, 10 ** 15, False)] * 3
    summary = metrics.latency_summary(spark.createDataFrame(rows, SAMPLES))
    assert tuple(summary.first()) == (100, 3, 50, 95, 99)
    assert metrics.summary_text(summary).first().summary == "total=100 failed=3 p50=50ms p95=95ms p99=99ms"
    failed = spark.createDataFrame(rows[-3:], SAMPLES)
    assert tuple(metrics.latency_summary(failed).first()) == (0, 3, 0, 0, 0)
    by = metrics.latency_summary(failed.withColumn("run", F.lit("r")), by=["run"]).first()
    assert tuple(by) == ("r", 0, 3, 0, 0, 0)


def test_approximate_percentiles(spark):
    row = metrics.approx_percentiles(spark.range(1, 1_001), "id").first()
    assert abs(row.p50 - 500) <= 2 and abs(row.p99 - 990) <= 2


def test_throughput(spark):
    df = spark.range(0, 16_999).select(F.col("id").alias("event_ms"))
    row = metrics.throughput(df, 15).first()
    assert (row.events, row.whole_per_sec) == (16_999, 1_133) and row.per_sec == pytest.approx(1133.2667, abs=1e-3)
    got = {r.bucket_start_ms: (r.events, r.whole_per_sec) for r in metrics.throughput_by_bucket(df, 10_000).collect()}
    assert got == {0: (10_000, 1_000), 10_000: (6_999, 699)}


# --- ranks of wide values, sketches, digests ---------------------------------------------------------------

@pytest.mark.parametrize("span", [10, 2**17, 2**40, 2**62])
def test_radix_ranks_equal_sorted_ranks(spark, span):
    rng = random.Random(span)
    rows = [(rng.choice("aab") if i % 50 else None, rng.randrange(-span, span) if i % 9 else None) for i in range(700)]
    rows += [("a", 7)] * 200 + [("one", -span)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(5)
    for by in ([], ["g"]):
        want = {}
        for g in {g for g, _ in rows} if by else {None}:
            values = sorted(v for own, v in rows if v is not None and (own == g or not by))
            if values:
                want[g] = tuple(values[max(1, math.ceil(p / 100.0 * len(values))) - 1] for p in (50, 95, 99))
        got = {r["g"] if by else None: (r.p50, r.p95, r.p99) for r in metrics.radix_rank(df, "v", by=by).collect()}
        assert got == want


def test_radix_ranks_of_nothing_and_of_extremes(spark):
    none = spark.createDataFrame([(None,)], "v long")
    assert tuple(metrics.radix_rank(none, "v").first()) == (0, 0, 0)
    ends = spark.createDataFrame([(-2**63,), (2**63 - 1,), (0,)], "v long")
    assert tuple(metrics.radix_rank(ends, "v").first()) == (0, 2**63 - 1, 2**63 - 1)


def test_radix_tasks_hold_few_bins(spark):
    """Values far apart: the bins of each level, not the distinct values, are what is shuffled."""
    df = spark.range(0, 200_000, 1, 8).select((F.col("id") * 4_398_046_511_104).alias("v"))
    row = metrics.radix_rank(df, "v").first()
    assert row.p50 == 99_999 * 4_398_046_511_104
    bins = df.groupBy(F.shiftright("v", 48)).count().count()
    assert bins <= 2 ** metrics.BIN_BITS


def test_sketches_survive_rollup(spark):
    """Windows of hours merged to a day and to four days: rank errors stay within the bound; small windows are exact."""
    rng = random.Random(2)
    rows = [("d", rng.gauss(0, 1) ** 3, rng.randrange(4 * 86_400_000)) for _ in range(60_000)] + [("e", float(i), i) for i in range(99)]
    events = spark.createDataFrame(rows + [("n", None, 5)], SENSOR_EVENT).repartition(6)
    hours = windows.window_sketches(events, 3_600_000)
    for size in (86_400_000, 4 * 86_400_000):
        for r in windows.sketched_quantiles(windows.rollup_sketches(hours, size, 3_600_000)).collect():
            own = sorted(v for d, v, t in rows if d == r.device_id and t // size * size == r.window_start_ms)
            assert r["count"] == len(own)
            for p in (50, 95, 99):
                value = r[f"p{p}"]
                if not own:
                    assert value is None
                elif len(own) <= windows.SKETCH_SIZE:
                    assert value == own[math.ceil(p / 100 * len(own)) - 1]
                else:
                    low, high = bisect.bisect_left(own, value), bisect.bisect_right(own, value)
                    error = max(low - p / 100 * len(own), p / 100 * len(own) - high, 0) / len(own)
                    assert error <= 2.6 / windows.SKETCH_SIZE
    with pytest.raises(ValueError):
        windows.rollup_sketches(hours, 5, 3)


def copy_of(spark, n, **changes):
    rows = [(p, o, f"k{o}", changes.get("value", {}).get((p, o), f"v{o}"), o) for p in range(2) for o in range(n)
            if (p, o) not in changes.get("gone", ())] + list(changes.get("more", ()))
    return spark.createDataFrame(rows, "partition int, offset long, key string, value string, timestamp long").repartition(4)


def test_damage_equals_the_full_comparison(spark):
    left = copy_of(spark, 500, more=[(0, 3, "k3", "v3", 3), (1, None, "k", None, 1)])
    right = copy_of(spark, 500, value={(1, 9): "changed", (1, 10): None}, gone={(0, 7)}, more=[(1, 700, "k", "v", 1), (0, None, "a", "b", 2)])
    want = sorted(map(repr, audit.replica_diff(left, right).where("status <> 'same'").collect()))
    assert sorted(map(repr, audit.replica_damage(left, right).collect())) == want and len(want) == 7
    summary = {(r.partition, r.status): r.offsets for r in audit.replica_summary(left, right).collect()}
    assert summary == {(r.partition, r.status): r.n for r in audit.replica_diff(left, right).groupBy("partition", "status")
                       .agg(F.count("*").alias("n")).collect()}
    assert audit.replica_damage(left, left.where("NOT (partition = 0 AND offset = 3)").unionByName(
        left.where("partition = 0 AND offset = 3"))).count() == 0


def test_payload_that_is_compared_follows_the_damage(spark):
    """Of 10 blocks one is damaged: only its rows reach the comparison."""
    def log(changed):
        offset = F.col("id")
        return spark.range(0, 10 * 32_768, 1, 6).select(
            F.lit(0).alias("partition"), offset.alias("offset"), offset.cast("string").alias("key"),
            F.when(offset == changed, "x").otherwise(F.repeat(F.lit("payload "), 4)).alias("value"), offset.alias("timestamp"))
    left, right = log(-1), log(100_000)
    blocks = audit.block_digests(left, right)
    assert blocks.where("NOT clean").count() == 1
    assert [x.count() for x in audit._in_damaged(left, right, blocks)] == [32_768, 32_768]
    assert [tuple(r) for r in audit.replica_damage(left, right).collect()] == [(0, 100_000, "differs")]

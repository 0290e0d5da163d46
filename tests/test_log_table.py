"""The stored log: write, scan, bounded reads, ordered replay."""

import pytest
from pyspark.sql import functions as F

from tidemark.schemas import LOG, STORED_LOG
from tidemark.sources import log_table


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "t")
    records = spark.range(0, 40_000, 1, 6).select(
        (F.col("id") % 4).cast("int").alias("partition"), F.expr("id div 4").alias("offset"),
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit("v").alias("value"),
        F.col("id").alias("timestamp"), F.lit("p").alias("producer_id"), F.col("id").alias("seq"))
    log_table.write_log(records, path)
    return path


def test_scan(spark, log):
    df = log_table.read_log(spark, log)
    assert df.schema == LOG and df.count() == 40_000
    assert log_table.read_log(spark, log, STORED_LOG).columns == STORED_LOG.names


def test_fetch_from_the_middle(spark, tmp_path):
    path = str(tmp_path / "t")
    ten = spark.range(10).select(F.lit(0).alias("partition"), F.col("id").alias("offset"), F.lit("k").alias("key"),
                                 F.lit("v").alias("value"), F.col("id").alias("timestamp"),
                                 F.lit("p").alias("producer_id"), F.col("id").alias("seq"))
    log_table.write_log(ten, path)
    got = log_table.fetch(spark, path, 0, 5, 1).orderBy("offset").collect()
    assert [r.offset for r in got] == [5, 6, 7, 8, 9]
    assert log_table.fetch(spark, path, 0, 100, 1).count() == 0
    assert log_table.fetch(spark, path, 0, -7, 1).count() == 10
    for bad in (-1, 1):
        with pytest.raises(ValueError):
            log_table.fetch(spark, path, bad, 0, 1)


def test_fetch_prunes_and_pushes_down(spark, log):
    plan = log_table.fetch(spark, log, 2, 9_000, 4).select("key")._jdf.queryExecution().toString()
    scan = plan[plan.index("== Physical Plan =="):]
    assert "PartitionFilters: [isnotnull(partition" in scan
    assert "GreaterThanOrEqual(offset,9000)" in scan
    assert "ReadSchema: struct<offset:bigint,key:string>" in scan


def test_append_adds_records(spark, log, tmp_path):
    path = str(tmp_path / "t")
    rows = log_table.read_log(spark, log, STORED_LOG)
    log_table.write_log(rows, path)
    log_table.write_log(rows.withColumn("offset", F.col("offset") + 10_000), path)
    assert log_table.read_log(spark, path).count() == 80_000


def test_fan_in_and_replay_order(spark, log):
    parts = [log_table.fetch(spark, log, p, 0, 4) for p in range(4)]
    merged = log_table.fan_in(*parts)
    assert merged.count() == 40_000
    runs = (log_table.in_replay_order(merged, 6).withColumn("task", F.spark_partition_id())
            .withColumn("at", F.monotonically_increasing_id()).collect())
    assert len({r.task for r in runs}) > 4  # a log partition is not tied to one task
    last = {}
    for r in sorted(runs, key=lambda r: r["at"]):
        assert last.get(r.partition, -1) + 1 == r.offset
        last[r.partition] = r.offset

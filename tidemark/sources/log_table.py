"""The stored log: a parquet table with one directory per partition; order is the ``offset`` column.

A log that grows by batches has one folder per batch around these. A batch is written into a folder whose name
begins with an underscore, which no reader lists, and published by renaming that folder: one step on a file system
with atomic renames (HDFS, local); an object store needs a table format instead. The producer state after the batch
lies inside, so records and state appear together. The state is kept in buckets, and a batch holds only those it changed.
"""

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.schemas import LOG, PRODUCER_STATE, STORED_LOG
from tidemark.session import folders, path_exists, read_text, remove, rename, write_text


BLOCK = 1_000_000  # offsets that are written by one task


def write_log(records: DataFrame, path: str, mode="append") -> None:
    """Appends records that already carry offsets.

    Blocks of consecutive offsets are dealt to tasks, so a large partition spreads over many files, and each file is sorted, so
    a bounded read can skip files and row groups by their statistics. Blocks are told by the offset itself: no sampling for
    ranges, which would compute the records twice.
    """
    (records.select(*STORED_LOG.names)
     .repartition("partition", F.expr(f"offset div {BLOCK}")).sortWithinPartitions("partition", "offset")
     .write.partitionBy("partition").mode(mode).parquet(path))


def _batch(path: str, batch: int) -> str:
    return f"{path}/batch_id={batch}"


def is_published(spark: SparkSession, path: str, batch: int) -> bool:
    return path_exists(spark, _batch(path, batch))


STATE_BUCKETS = 64


@dataclass(frozen=True)
class Index:
    """What a batch knows of all before it: which batch last wrote each bucket of the producer state, and the next offset of each
    partition. No larger than the numbers of buckets and partitions."""

    buckets: int = STATE_BUCKETS
    written: dict = field(default_factory=dict)
    ends: dict = field(default_factory=dict)

    def after(self, batch: int, changed, ends: dict) -> "Index":
        return Index(self.buckets, {**self.written, **{b: batch for b in changed}}, {**self.ends, **ends})

    def to_json(self) -> str:
        return json.dumps([self.buckets, list(self.written.items()), list(self.ends.items())])

    @classmethod
    def from_json(cls, text: str) -> "Index":
        buckets, written, ends = json.loads(text)
        return cls(buckets, dict(map(tuple, written)), dict(map(tuple, ends)))


def last_index(spark: SparkSession, path: str, batch: int) -> Index:
    """The index before ``batch``; the batches before it must be there, and none after."""
    names = [n for n in folders(spark, path) if n.startswith("batch_id=")]
    known = sorted(int(n.partition("=")[2]) for n in names)
    if batch not in known and known and known[-1] != batch - 1 or batch and not known:
        raise ValueError(f"batch {batch} does not follow the batches in the log, of which the last is "
                         f"{known[-1] if known else None}")
    return Index.from_json(read_text(spark, f"{_batch(path, batch - 1)}/_index/index.json")) if batch else Index()


def read_state(spark: SparkSession, path: str, index: Index, buckets) -> DataFrame:
    """Producer state of some buckets, each from the batch that last wrote it."""
    paths = [f"{_batch(path, index.written[b])}/_state/bucket={b}" for b in sorted(set(buckets) & index.written.keys())]
    return spark.read.schema(PRODUCER_STATE).parquet(*paths) if paths else spark.createDataFrame([], PRODUCER_STATE)


def last_state(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """Producer state before ``batch``, of all producers."""
    index = last_index(spark, path, batch)
    return read_state(spark, path, index, index.written)


def publish(spark: SparkSession, path: str, batch: int, fill) -> bool:
    """``fill(folder)`` writes the records and the changed state, and returns the index; then the folder becomes the batch."""
    staged = f"{path}/_staged_{batch}"
    remove(spark, staged)  # what a writer that died may have left
    write_text(spark, f"{staged}/_index/index.json", fill(staged).to_json())
    return rename(spark, staged, _batch(path, batch))


def read_log(spark: SparkSession, path: str, schema=LOG) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def fetch(spark: SparkSession, path: str, partition: int, from_offset: int, partitions: int,
          ordered=False) -> DataFrame:
    """Records of one partition from an offset to the end. Below zero means zero; past the end is empty.

    ``ordered`` returns them in the order of their offsets.
    """
    if not 0 <= partition < partitions:
        raise ValueError(f"this log has no partition {partition}")
    start = max(0, from_offset)
    rows = read_log(spark, path).where((F.col("partition") == partition) & (F.col("offset") >= start))
    return rows.orderBy("offset") if ordered else rows


def fan_in(*logs: DataFrame) -> DataFrame:
    """One frame over several logs. Partitions of one log need no union: reading its path covers them all."""
    merged = logs[0]
    for log in logs[1:]:
        merged = merged.unionByName(log)
    return merged


def tail(spark: SparkSession, path: str, max_files_per_trigger=None, schema=LOG) -> DataFrame:
    """The log as a stream. Progress lives in the query's checkpoint, so a restart continues where it stopped."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path).select(*schema.names)


def in_replay_order(log: DataFrame, tasks=None) -> DataFrame:
    """For per-record consumers: each task gets one ordered run of offsets.

    Ranges instead of one task per partition, so a large partition is split while order inside a run is kept.
    """
    ranged = (log.repartitionByRange(tasks, "partition", "offset") if tasks
              else log.repartitionByRange("partition", "offset"))
    return ranged.sortWithinPartitions("partition", "offset")

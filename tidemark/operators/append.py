"""From append attempts to log records: drop retries, number what is left, acknowledge every attempt."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.plans.ordered import join_carried, number_rows, same_keys, sliced
from tidemark.schemas import ATTEMPT, STORED_LOG
from tidemark.session import scratch_scope
from tidemark.sources import log_table

STREAM = ["partition", "producer_id"]
ARRIVAL = ["arrival_ms", "attempt", "tie"]
KEY = ["partition", *ARRIVAL]  # unique for each attempt


def _judged(rows: DataFrame, high_water) -> DataFrame:
    """Adds ``high_water`` and ``accepted``; rows that only remind of earlier batches are never accepted."""
    newer = F.col("high_water").isNull() | (F.col("seq") > F.col("high_water"))
    return rows.withColumn("high_water", high_water).withColumn("accepted", F.col("_fresh") & F.coalesce(newer, F.lit(False)))


def _one(accepted="accepted"):
    return F.col(accepted).cast("long")


def decisions(attempts: DataFrame, remembered=None, direct=False, numbered=True) -> DataFrame:
    """What becomes of each attempt: its ``KEY`` columns, ``producer_id, seq, high_water, accepted``, and if ``numbered``, ``offset``
    (null if it is not accepted) and ``ack_offset``.

    An attempt is a duplicate when its sequence is not above the high water, the largest earlier sequence of its producer in the
    partition, even if that number was never seen before; it is answered with the producer's latest accepted offset. An attempt
    without a sequence cannot be told from a retry: it is accepted only as its producer's first.

    One range sort of narrow rows by partition and arrival, and a parallel scan over its slices. A slice hands on the
    highest sequence of each producer in it, which settles what is accepted; then how many rows each slice stores gives where its
    part of each partition begins, and with that the last offset of each producer. ``remembered`` rows come from earlier batches and
    only set the high water. ``direct`` uses plain windows, for groups that are known to be small.
    """
    rows = attempts.select(*KEY, "producer_id", "seq", F.lit(True).alias("_fresh"))
    if remembered is not None:
        rows = rows.unionByName(remembered.select(*KEY, "producer_id", "seq", F.lit(False).alias("_fresh")))
    before = Window.unboundedPreceding, -1
    if direct:
        mine = Window.partitionBy(*STREAM).orderBy(*ARRIVAL).rowsBetween(*before)
        all_ = Window.partitionBy("partition").orderBy(*ARRIVAL).rowsBetween(*before)
        judged = _judged(rows, F.max("seq").over(mine))
        if not numbered:
            return judged.where("_fresh").drop("_fresh")
        placed = judged.withColumn("_at", F.coalesce(F.sum(_one()).over(all_), F.lit(0)))
        return _decided(placed, F.col("_at"), F.max(F.when(F.col("accepted"), F.col("_at"))).over(mine))

    slices = sliced(rows, KEY, "attempts")
    lane, earlier = ["_slice", *STREAM], Window.partitionBy(*STREAM).orderBy("_slice").rowsBetween(*before)
    tops = slices.groupBy(*lane).agg(F.max("seq").alias("_top"))
    known = tops.count()  # at most one row per slice and producer in it, here and below
    # From here on the rows of a slice stay together; both windows below fit that, so narrow rows move once.
    mine = Window.partitionBy(*lane).orderBy("_pos").rowsBetween(*before)
    all_ = Window.partitionBy("_slice", "partition").orderBy("_pos").rowsBetween(*before)
    carried = tops.select(*lane, F.max("_top").over(earlier).alias("_carry"))
    judged = _judged(join_carried(slices.repartition("_slice"), carried, lane, known),
                     F.greatest(F.max("seq").over(mine), F.col("_carry")))
    if not numbered:
        return judged.where("_fresh").select(*KEY, "producer_id", "seq", "high_water", "accepted")
    placed = judged.withColumn("_rank", F.coalesce(F.sum(_one()).over(all_), F.lit(0)))
    held = placed.groupBy(*lane).agg(F.sum(_one()).alias("_n"), F.max(F.when(F.col("accepted"), F.col("_rank"))).alias("_last"))
    parts = held.groupBy("_slice", "partition").agg(F.sum("_n").alias("_stored")).select(
        "_slice", "partition", F.coalesce(F.sum("_stored").over(
            Window.partitionBy("partition").orderBy("_slice").rowsBetween(*before)), F.lit(0)).alias("_base"))
    based = join_carried(held, parts, ["_slice", "partition"], known)
    ends = based.select(*lane, "_base", F.max(F.col("_base") + F.col("_last")).over(earlier).alias("_from"))
    complete = join_carried(placed.withColumn("_recent", F.max(F.when(F.col("accepted"), F.col("_rank"))).over(mine)),
                            ends, lane, known)
    return _decided(complete, F.col("_base") + F.col("_rank"), F.coalesce(F.col("_base") + F.col("_recent"), F.col("_from")))


def _decided(rows: DataFrame, place, latest) -> DataFrame:
    offset = F.when(F.col("accepted"), place)
    return rows.where("_fresh").select(*KEY, "producer_id", "seq", "high_water", "accepted", offset.alias("offset"),
                                       F.coalesce(offset, latest).alias("ack_offset"))


def _with(attempts: DataFrame, decided: DataFrame, *columns) -> DataFrame:
    """The attempts, payload and all, with columns of their decisions: the one join that moves the payload."""
    return (attempts.alias("a").join(decided.select(*KEY, *columns).alias("d"), same_keys(KEY, "a", "d"))
            .select("a.*", *[F.col(f"d.{c}") for c in columns]))


def with_acceptance(attempts: DataFrame, direct=False) -> DataFrame:
    """Adds ``high_water`` and ``accepted``."""
    return _with(attempts, decisions(attempts, direct=direct, numbered=False), "high_water", "accepted")


def idempotent_dedup(attempts: DataFrame, direct=False) -> DataFrame:
    kept = decisions(attempts, direct=direct, numbered=False).where("accepted")
    return attempts.alias("a").join(kept.select(*KEY).alias("d"), same_keys(KEY, "a", "d"), "left_semi")


def with_offsets(accepted: DataFrame, direct=False) -> DataFrame:
    """Adds the dense zero-based ``offset`` of each record in its partition, in arrival order; nothing is dropped."""
    return _with(accepted, number_rows(accepted.select(*KEY), ["partition"], ARRIVAL, "offset", direct), "offset")


def log_records(attempts: DataFrame, direct=False) -> DataFrame:
    """Attempts to stored records: retries dropped, offsets assigned, arrival time as the record's timestamp."""
    return _as_records(_with(attempts, decisions(attempts, direct=direct).where("accepted"), "offset"))


def _as_records(numbered: DataFrame) -> DataFrame:
    return numbered.withColumnRenamed("arrival_ms", "timestamp").select(*STORED_LOG.names)


def append_plain(attempts: DataFrame, direct=False) -> DataFrame:
    """Appends every attempt, retries included."""
    return _as_records(with_offsets(attempts, direct))


def append_acks(attempts: DataFrame, direct=False) -> DataFrame:
    """Every attempt with ``accepted`` and ``ack_offset``."""
    return _with(attempts, decisions(attempts, direct=direct), "accepted", "ack_offset")


def _remembered(state: DataFrame) -> DataFrame:
    """State rows in the shape of attempts that arrived before anything else."""
    known = {"partition": F.col("partition"), "producer_id": F.col("producer_id"), "seq": F.col("last_seq"),
             "arrival_ms": F.lit(-(2 ** 62)), "tie": F.lit(-1)}
    return state.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ATTEMPT])


def accept_batch(attempts: DataFrame, state: DataFrame, ends=None, direct=False) -> DataFrame:
    """Records of a batch that follows what ``state`` (see ``producer_state``) remembers of earlier ones.

    Retries of records stored earlier are dropped too, and offsets continue at ``ends``, the next offset by partition; by default
    they follow the state. Of the state, only the producers of the batch join its rows.
    """
    fresh = attempts.select(*ATTEMPT.names)
    here = fresh.select(*STREAM).distinct()
    touched = state.alias("s").join(here.alias("h"), same_keys(STREAM, "s", "h"), "left_semi")
    decided = decisions(fresh, _remembered(touched), direct).where("accepted")
    if ends is None:
        ends = {r.partition: r.next for r in state.groupBy("partition").agg((F.max("last_offset") + 1).alias("next")).collect()}
    based = decided
    if ends:  # one entry per partition of the log
        base = F.lit(0).cast("long")
        for partition, first in ends.items():
            base = F.when(F.col("partition").eqNullSafe(F.lit(partition)), F.lit(first)).otherwise(base)
        based = decided.withColumn("offset", F.col("offset") + base)
    return _as_records(_with(fresh, based, "offset"))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(*STREAM), F.lit(buckets)).cast("int").alias("bucket")


def append_to_log(spark: SparkSession, attempts: DataFrame, path: str, batch: int, direct=False) -> bool:
    """Appends a batch of attempts to a stored log, new or existing; false if that batch is stored already.

    ``batch`` numbers the batches of a log from 0; they are appended in order. A batch is written apart, with the
    producer state that it changes, and published by one rename (see ``log_table.publish``), so a writer that dies leaves
    nothing that readers or later appends take for stored, and repeating a batch is safe.

    Producers fall into hashed buckets. Of the state, the buckets of the batch's producers are read, and those in which
    something was accepted are written again; all others stay where the batch that last changed them put them.
    """
    if log_table.is_published(spark, path, batch):
        return False
    index = log_table.last_index(spark, path, batch)
    with scratch_scope(spark):
        rows = attempts.select(*ATTEMPT.names)
        touched = [r.bucket for r in rows.select(_bucket(index.buckets)).distinct().collect()]  # no more than there are buckets
        state = log_table.read_state(spark, path, index, touched)

        def fill(folder):
            log_table.write_log(accept_batch(rows, state, index.ends, direct), folder, mode="overwrite")
            written = spark.read.schema(STORED_LOG).parquet(folder)
            fresh = producer_state(written).withColumn("bucket", _bucket(index.buckets))
            changed = [r.bucket for r in fresh.select("bucket").distinct().collect()]
            ends = {r.partition: r.next_offset for r in log_end_offsets(written).collect()}
            if changed:
                kept = log_table.read_state(spark, path, index, changed).withColumn("bucket", _bucket(index.buckets))
                (fresh.unionByName(kept).groupBy("bucket", *STREAM)
                 .agg(F.max("last_seq").alias("last_seq"), F.max("last_offset").alias("last_offset"))
                 .repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/_state"))
            return index.after(batch, changed, ends)
        return log_table.publish(spark, path, batch, fill)


def producer_state(log: DataFrame) -> DataFrame:
    """Last sequence and last offset per (partition, producer)."""
    return log.groupBy(*STREAM).agg(F.max("seq").alias("last_seq"),
                                    F.max_by("offset", "seq").alias("last_offset"))


def log_end_offsets(log: DataFrame) -> DataFrame:
    return log.groupBy("partition").agg(F.count("*").alias("records"),
                                        (F.max("offset") + 1).alias("next_offset"))


def consumer_progress(log: DataFrame, from_offset=0) -> DataFrame:
    """Events processed and next position per partition, for a consumer that started at ``from_offset``."""
    read = log.where(F.col("offset") >= max(0, from_offset))
    return read.groupBy("partition").agg(F.count("*").alias("events_processed"),
                                         (F.max("offset") + 1).alias("next_offset"))

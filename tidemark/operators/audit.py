"""Checks over stored logs: gaps, copies, order, loss, silence, and the verdict of a run."""

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.routing import key_partition
from tidemark.plans.ordered import max_before, same_keys
from tidemark.schemas import LIVENESS_TIMEOUT_MS, MAX_FAILED_WRITES
from tidemark.session import materialize


def offset_bitmaps(log: DataFrame) -> DataFrame:
    """One bitmap per (partition, 32,768 consecutive offsets) and the number of rows behind it.

    Tasks build partial bitmaps before the shuffle, so what moves is 4 KiB per 32,768 offsets, and copies of
    one offset collapse at once.
    """
    return (log.groupBy("partition", F.bitmap_bucket_number("offset").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("offset")).alias("bits"),
                 F.count("*").alias("records"), F.min("offset").alias("first"), F.max("offset").alias("last")))


def offset_audit(log: DataFrame) -> DataFrame:
    """Per partition: records, first and last offset, duplicates, missing offsets, and ``contiguous``."""
    parts = offset_bitmaps(log).withColumn("distinct", F.bitmap_count("bits"))
    return (parts.groupBy("partition")
            .agg(F.sum("records").alias("records"), F.min("first").alias("first_offset"),
                 F.max("last").alias("last_offset"), F.sum("distinct").alias("distinct_offsets"))
            .withColumn("duplicates", F.col("records") - F.col("distinct_offsets"))
            .withColumn("missing", F.col("last_offset") + 1 - F.col("distinct_offsets"))
            .withColumn("contiguous", (F.col("first_offset") == 0) & (F.col("duplicates") == 0)
                        & (F.col("missing") == 0)))


def offset_duplicates(log: DataFrame) -> DataFrame:
    return (log.groupBy("partition", "offset").agg(F.count("*").alias("copies"))
            .where("copies > 1"))


def replica_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Class of every (partition, offset): same, differs, missing_left or missing_right. Nulls compare equal.

    Both copies are counted together per exact record, then per offset. Nothing is paired up, so an offset
    stored many times costs no more than one stored once.
    """
    record = ["partition", "offset", "key", "value", "timestamp"]
    sides = (left.select(*record, F.lit(1).alias("_left"))
             .unionByName(right.select(*record, F.lit(0).alias("_left"))))
    copies = sides.groupBy(*record).agg(F.sum("_left").alias("_l"), F.count("*").alias("_n"))
    l, r = F.col("_l"), F.col("_n") - F.col("_l")
    totals = copies.groupBy("partition", "offset").agg(
        F.sum(l).alias("_l"), F.sum(r).alias("_r"), F.count_if(l != r).alias("_unequal"))
    kind = (F.when(F.col("_l") == 0, "missing_left").when(F.col("_r") == 0, "missing_right")
            .when(F.col("_unequal") > 0, "differs").otherwise("same"))
    return totals.select("partition", "offset", kind.alias("status"))


def block_digests(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per (partition, 32,768 consecutive offsets): records on both sides, and whether the block is ``clean``.

    Each side's records are hashed, and the hashes added up, which does not depend on order, so tasks add up what they read and a
    block costs one row and a bitmap per task. A block is clean if both sides agree in number and sums and no offset occurs twice
    on a side; two independent sums of 64-bit hashes tell different records apart.
    """
    def hashed(log, side):
        return log.select("partition", F.bitmap_bucket_number("offset").alias("bucket"), "offset", F.lit(side).alias("_l"),
                          *[F.xxhash64(F.lit(seed), "offset", "key", "value", "timestamp").alias(f"_h{seed}") for seed in (1, 2)])

    both = hashed(left, 1).unionByName(hashed(right, 0))
    own = F.col("_l") == 1
    sums = [F.sum(F.when(own, F.col(h)).otherwise(-F.col(h).cast("decimal(38,0)"))).alias(h) for h in ("_h1", "_h2")]
    bits = [F.bitmap_count(F.bitmap_construct_agg(F.when(c, F.bitmap_bit_position("offset")))).alias(n)
            for n, c in (("_dl", own), ("_dr", ~own))]
    blocks = both.groupBy("partition", "bucket").agg(
        F.sum("_l").alias("left_records"), F.sum(1 - F.col("_l")).alias("right_records"), *sums, *bits)
    clean = ((F.col("left_records") == F.col("right_records")) & (F.col("_h1") == 0) & (F.col("_h2") == 0)
             & (F.col("_dl") == F.col("left_records")) & (F.col("_dr") == F.col("right_records")) & F.col("bucket").isNotNull())
    return blocks.select("partition", "bucket", "left_records", "right_records", F.coalesce(clean, F.lit(False)).alias("clean"))


def _in_damaged(left: DataFrame, right: DataFrame, blocks: DataFrame):
    """The rows of both sides that lie in blocks that are not clean: only these are compared with their payload."""
    damaged = blocks.where("NOT clean").select("partition", "bucket")

    def narrowed(log):
        marked = log.withColumn("bucket", F.bitmap_bucket_number("offset"))
        return marked.alias("r").join(damaged.alias("d"), same_keys(["partition", "bucket"], "r", "d"), "left_semi").drop("bucket")

    return narrowed(left), narrowed(right)


def replica_damage(left: DataFrame, right: DataFrame) -> DataFrame:
    """``replica_diff`` without the offsets that are the same: what is shuffled with payload follows the damage."""
    blocks = materialize(block_digests(left, right), "digests")
    return replica_diff(*_in_damaged(left, right, blocks)).where("status <> 'same'")


def replica_summary(left: DataFrame, right: DataFrame) -> DataFrame:
    """Offsets by partition and status; clean blocks are counted from their digests alone."""
    blocks = materialize(block_digests(left, right), "digests")
    whole = blocks.where("clean").select("partition", F.lit("same").alias("status"), F.col("left_records").alias("offsets"))
    compared = replica_diff(*_in_damaged(left, right, blocks)).groupBy("partition", "status").agg(F.count("*").alias("offsets"))
    return whole.unionByName(compared).groupBy("partition", "status").agg(F.sum("offsets").alias("offsets"))


def lost_records(produced: DataFrame, consumed: DataFrame) -> DataFrame:
    """Produced records whose (partition, offset) was never consumed; NULL keys are keys like any other.

    Blocks of offsets whose bitmaps agree on both sides hold no loss and are left out before the join, so that a
    large log with few losses is scanned and little of it is joined.
    """
    block, key = ["partition", "bucket"], ["partition", "offset"]
    there, here = offset_bitmaps(produced).alias("p"), offset_bitmaps(consumed).alias("c")
    # Rows without an offset set no bit, so their blocks are always compared row by row.
    differ = ~F.col("p.bits").eqNullSafe(F.col("c.bits")) | F.col("p.bucket").isNull()
    damaged = there.join(here, same_keys(block, "p", "c"), "left").where(differ).select("p.partition", "p.bucket")

    def narrowed(rows):
        marked = rows.withColumn("bucket", F.bitmap_bucket_number("offset"))
        return marked.alias("r").join(damaged.alias("d"), same_keys(block, "r", "d"), "left_semi").drop("bucket")

    seen = narrowed(consumed.select(*key)).alias("s")
    return narrowed(produced).alias("m").join(seen, same_keys(key, "m", "s"), "left_anti")


def reconcile_loss(produced: DataFrame, consumed: DataFrame) -> DataFrame:
    """Per partition: produced, consumed, their difference, and the loss (the difference, at least 0)."""
    tagged = (produced.select("partition", F.lit(1).alias("_p"))
              .unionByName(consumed.select("partition", F.lit(0).alias("_p"))))
    return (tagged.groupBy("partition")
            .agg(F.sum("_p").alias("produced"), (F.count("*") - F.sum("_p")).alias("consumed"))
            .withColumn("difference", F.col("produced") - F.col("consumed"))
            .withColumn("lost", F.greatest(F.lit(0), F.col("difference"))))


def device_liveness(roster: DataFrame, events: DataFrame, asof_ms, timeout_ms=LIVENESS_TIMEOUT_MS) -> DataFrame:
    """Alive iff last seen at most ``timeout_ms`` before ``asof_ms``; a device never seen is not alive."""
    seen = events.groupBy("device_id").agg(F.max("event_ms").alias("last_seen_ms"))
    silence = F.lit(asof_ms) - F.col("last_seen_ms")
    return (roster.join(seen, "device_id", "left")
            .withColumn("alive", F.coalesce(silence <= timeout_ms, F.lit(False))))


def order_audit(log: DataFrame, partitions: int, direct=False) -> DataFrame:
    """Per partition: records, records written after a later one of their producer, and misrouted records."""
    seen = max_before(log.select("partition", "offset", "key", "producer_id", "seq"),
                      ["partition", "producer_id"], ["offset"], "seq", "_before", direct)
    return seen.groupBy("partition").agg(
        F.count("*").alias("records"),
        F.count_if(F.col("seq") <= F.col("_before")).alias("out_of_order"),
        F.count_if(key_partition("key", partitions) != F.col("partition")).alias("misrouted"))


def key_placement(log: DataFrame) -> DataFrame:
    """One row: number of keys, and of keys found in more than one partition."""
    keys = log.groupBy("key").agg(F.min("partition").alias("_low"), F.max("partition").alias("_high"))
    return keys.agg(F.count("*").alias("keys"), F.count_if(F.col("_low") != F.col("_high")).alias("split_keys"))


def run_verdict(samples: DataFrame, produced: DataFrame, consumed: DataFrame,
                max_failed=MAX_FAILED_WRITES) -> DataFrame:
    """One row: failed writes, lost records over the whole run, and whether the run passes."""
    failed = samples.agg(F.count_if(~F.col("success")).alias("failed"))
    total = consumed.agg(F.count("*")).scalar()
    lost = produced.agg(F.count("*").alias("n")).select(F.greatest(F.lit(0), F.col("n") - total).alias("lost"))
    return (failed.withColumn("lost", lost.scalar())
            .withColumn("passed", (F.col("failed") <= max_failed) & (F.col("lost") == 0)))

"""Latency percentiles, throughput and run summaries."""

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.scalar import latency_ms, window_start
from tidemark.plans.ordered import join_carried, same_keys
from tidemark.schemas import PERCENTILES
from tidemark.session import materialize

# Values are ranked in bins of this many consecutive integers.
BIN_BITS = 16


def _targets(counts: DataFrame, by, value, percents):
    """The bin that holds each wanted rank, with the number of values in the bins before it."""
    bins = (counts.groupBy(*by, F.shiftright(value, BIN_BITS).alias("_bin"))
            .agg(F.sum("_n").alias("_bin_n")))
    group = Window.partitionBy(*by)
    upto = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = (bins.withColumn("_upto", F.sum("_bin_n").over(upto))
              .withColumn("_total", F.sum("_bin_n").over(group))
              .withColumn("_before", F.col("_upto") - F.col("_bin_n"))
              .withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in percents])))
              .withColumn("_rank", F.greatest(F.ceil(F.col("_p") / 100.0 * F.col("_total")), F.lit(1))))
    hit = (F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_upto"))
    return placed.where(hit).select(*by, "_bin", "_p", "_rank", "_before")


def nearest_rank(df: DataFrame, value: str, percents=PERCENTILES, by=()) -> DataFrame:
    """Exact percentiles of a LONG column: the value at rank ``ceil(p / 100 * n)`` of the sorted values.

    The rows are first reduced to counts per distinct value. The wanted rank is then found by bin, and only
    the one bin that holds it is ordered: no task sees more than 2**BIN_BITS distinct values of a group, or
    more than (range >> BIN_BITS) bins. Without ``by`` the result is one row, 0 where there are no values.
    """
    by = list(by)
    keys = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    targets = _targets(counts, keys, value, percents)
    # Null-safe on every key, so a NULL group is kept and both uses of `counts` stay one shared shuffle.
    inside = (counts.withColumn("_bin", F.shiftright(value, BIN_BITS)).alias("c")
              .join(targets.alias("t"), same_keys([*keys, "_bin"], "c", "t"))
              .select("c.*", "_p", "_rank", "_before"))
    upto = (Window.partitionBy(*keys, "_bin", "_p").orderBy(value)
            .rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.withColumn("_upto", F.col("_before") + F.sum("_n").over(upto))
    reached = ranked.where(F.col("_upto") >= F.col("_rank"))
    picks = [F.min(F.when(F.col("_p") == float(p), F.col(value))) for p in percents]
    names = [f"p{p:g}" for p in percents]
    if by:
        return reached.groupBy(*by).agg(*[c.alias(n) for c, n in zip(picks, names)])
    return reached.agg(*[F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(picks, names)])


def radix_rank(df: DataFrame, value: str, percents=PERCENTILES, by=()) -> DataFrame:
    """The same for values of any range, nanoseconds for instance: radix selection, ``BIN_BITS`` bits a level from the top.

    A level counts how many values of a group fall into each bin of the prefix that holds the wanted rank, partially aggregated
    before the shuffle, and ranks those bins: no task holds more than 2**BIN_BITS of them for a group and prefix, however the
    values lie. The first level is the highest at which the values of the table differ. Without ``by`` the result is one row, 0
    where there are no values; a group without values has no row.
    """
    by, last = list(by), 64 // BIN_BITS - 1
    keys, names = by or ["_all"], [f"p{p:g}" for p in percents]
    rows = (df if by else df.withColumn("_all", F.lit(0))).select(*keys, F.col(value).cast("long").alias("_v")).where("_v IS NOT NULL")
    low, high = rows.agg(F.min("_v"), F.max("_v")).first()
    level = max((i for i in range(last + 1) if low is not None and low >> BIN_BITS * i != high >> BIN_BITS * i), default=0)
    upto = Window.unboundedPreceding, 0
    # Every value begins in the one prefix above the first level.
    bins = rows.groupBy(*keys, F.shiftright("_v", BIN_BITS * level).alias("_bin")).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    ranked = (bins.withColumn("_upto", F.sum("_n").over(group.orderBy("_bin").rowsBetween(*upto)))
              .withColumn("_total", F.sum("_n").over(group))
              .withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in percents])))
              .withColumn("_rank", F.greatest(F.ceil(F.col("_p") / 100.0 * F.col("_total")), F.lit(1))))
    targets = materialize(_reached(ranked, keys), "ranks")
    while level:
        level -= 1
        known = targets.count()  # a row per group and percentile
        inside = join_carried(rows.withColumn("_prefix", F.shiftright("_v", BIN_BITS * (level + 1))),
                              targets.select(*keys, "_prefix").distinct(), [*keys, "_prefix"], known)
        bins = inside.groupBy(*keys, "_prefix", F.shiftright("_v", BIN_BITS * level).alias("_bin")).agg(F.count("*").alias("_n"))
        joined = join_carried(bins, targets, [*keys, "_prefix"], known)
        order = Window.partitionBy(*keys, "_prefix", "_p").orderBy("_bin").rowsBetween(*upto)
        targets = materialize(_reached(joined.withColumn("_upto", F.sum("_n").over(order)), keys), "ranks")
    picks = [F.min(F.when(F.col("_p") == float(p), F.col("_prefix"))) for p in percents]
    if by:
        return targets.groupBy(*by).agg(*[c.alias(n) for c, n in zip(picks, names)])
    return targets.agg(*[F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(picks, names)])


def _reached(ranked: DataFrame, keys) -> DataFrame:
    """The bin of each wanted rank, as the prefix of the next level, and the rank that is left inside of it."""
    before = F.col("_upto") - F.col("_n")
    return (ranked.where((before < F.col("_rank")) & (F.col("_rank") <= F.col("_upto")))
            .select(*keys, "_p", F.col("_bin").alias("_prefix"), (F.col("_rank") - before).alias("_rank")))


def approx_percentiles(df: DataFrame, value: str, percents=PERCENTILES, by=(), accuracy=10_000) -> DataFrame:
    """One-pass approximation with bounded memory, for data where an exact rank is not needed."""
    return df.groupBy(*by).agg(*[F.percentile_approx(value, p / 100.0, accuracy).alias(f"p{p:g}")
                                 for p in percents])


def with_latency(samples: DataFrame) -> DataFrame:
    return samples.withColumn("latency_ms", latency_ms())


def latency_summary(samples: DataFrame, by=()) -> DataFrame:
    """Succeeded and failed counts, and percentiles over the successes only."""
    by = list(by)
    timed = with_latency(samples)
    base = timed.groupBy(*by).agg(F.count_if("success").alias("succeeded"),
                                  F.count_if(~F.col("success")).alias("failed"))
    ranks = nearest_rank(timed.where("success"), "latency_ms", by=by)
    names = [f"p{p:g}" for p in PERCENTILES]
    if by:
        joined = base.alias("b").join(ranks.alias("r"), same_keys(by, "b", "r"), "left")
        return joined.select("b.*", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    packed = ranks.select(F.struct(*names).alias("ranks")).scalar()
    return (base.withColumn("ranks", packed)
            .select("succeeded", "failed", *[F.col(f"ranks.{n}").alias(n) for n in names]))


def summary_text(summary: DataFrame) -> DataFrame:
    return summary.withColumn("summary", F.format_string(
        "total=%d failed=%d p50=%dms p95=%dms p99=%dms", "succeeded", "failed", "p50", "p95", "p99"))


def throughput(events: DataFrame, seconds: int, by=()) -> DataFrame:
    """Events per second over a run of ``seconds``, whole and fractional."""
    return (events.groupBy(*by).agg(F.count("*").alias("events"))
            .withColumn("whole_per_sec", F.expr(f"events div {int(seconds)}"))
            .withColumn("per_sec", F.col("events") / F.lit(float(seconds))))


def throughput_by_bucket(events: DataFrame, bucket_ms: int, ts_ms="event_ms") -> DataFrame:
    keyed = events.withColumn("bucket_start_ms", window_start(ts_ms, bucket_ms))
    return (keyed.groupBy("bucket_start_ms").agg(F.count("*").alias("events"))
            .withColumn("whole_per_sec", F.expr(f"events * 1000 div {int(bucket_ms)}"))
            .withColumn("per_sec", F.col("events") * 1000.0 / F.lit(float(bucket_ms))))

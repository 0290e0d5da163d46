"""Ordered computations over groups of any size.

A window function sorts each group in one task, which is a dead end once one group holds a large share of the
rows. So the rows are range-sorted by (group, order), which is unique per row: the range partitions come out even
however the groups are distributed, and a hot group simply spans many of them. Each row is stamped with its
position, the result is written once to the shared folder, and what a slice needs from the slices before it is a
table of at most one row per slice, since only the first group of a slice can have begun earlier.

The written cut matters: the stamps depend on where Spark put the range bounds, so they must never be computed
twice. A caller who knows that all groups are small can ask for the plain window with ``direct``; it is never chosen
by size.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import materialize

MAX_CARRIED = 500_000  # rows that are broadcast between slices, of a few numbers each
_SLICE_SHIFT = 33  # monotonically_increasing_id: slice number in the high bits, position in the low 33


def sliced(df: DataFrame, keys, label="sliced") -> DataFrame:
    """Globally sorted by ``keys`` (unique per row), stamped with ``_pos`` and ``_slice``, written once."""
    stamped = df.orderBy(*keys).withColumn("_pos", F.monotonically_increasing_id())
    return materialize(stamped, label).withColumn("_slice", F.shiftright("_pos", _SLICE_SHIFT))


def same_keys(columns, left, right):
    """Join condition on equal keys of two aliased frames; NULL keys are equal."""
    return reduce(lambda a, b: a & b,
                  [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def join_carried(rows: DataFrame, carried: DataFrame, keys, known_rows: int, how="inner") -> DataFrame:
    """Joins what slices hand on, at most ``known_rows`` rows: broadcast while few, else left to Spark."""
    small = F.broadcast(carried) if known_rows <= MAX_CARRIED else carried
    others = [c for c in carried.columns if c not in keys]
    return (rows.alias("l").join(small.alias("c"), same_keys(keys, "l", "c"), how)
            .select("l.*", *[F.col(f"c.{c}") for c in others]))


# What a running value is made of: the aggregate over rows, and how two partial results become one.
_RUNNING = {
    "max": (F.max, F.greatest),
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
}


def _before(df, group, order, value, into, how, direct):
    aggregate, combine = _RUNNING[how]
    upto = Window.unboundedPreceding, -1
    if direct:
        window = Window.partitionBy(*group).orderBy(*order).rowsBetween(*upto)
        return df.withColumn(into, aggregate(value).over(window))
    rows = sliced(df, [*group, *order], f"{how}-before")
    per_slice = rows.groupBy("_slice", *group).agg(aggregate(value).alias("_part"))
    # At most one row per slice and group in each of these windows.
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(*upto)
    # Only the first group of a slice can have begun in an earlier one, so this keeps at most one row per slice.
    carried = (per_slice.withColumn("_carry", aggregate("_part").over(earlier))
               .where("_carry IS NOT NULL").select("_slice", *group, "_carry"))
    keys = ["_slice", *group]
    here = Window.partitionBy(*keys).orderBy("_pos").rowsBetween(*upto)
    local = rows.withColumn("_local", aggregate(value).over(here))
    return (local.alias("l").join(F.broadcast(carried).alias("c"), same_keys(keys, "l", "c"), "left")
            .select(*[F.col(f"l.{c}") for c in df.columns],
                    combine(F.col("_local"), F.col("_carry")).alias(into)))


def max_before(df: DataFrame, group, order, value, into, direct=False) -> DataFrame:
    """Adds the largest ``value`` among the earlier rows of the same group, NULL where there is none.

    ``order`` must be unique within a group.
    """
    return _before(df, group, order, value, into, "max", direct)


def sum_before(df: DataFrame, group, order, value, into, direct=False) -> DataFrame:
    """The same with the sum of the earlier values."""
    return _before(df, group, order, value, into, "sum", direct)


def number_rows(df: DataFrame, group, order, into, direct=False) -> DataFrame:
    """Adds dense numbers 0..n-1 per group in ``order`` (unique within the group)."""
    if direct:
        window = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn(into, (F.row_number().over(window) - 1).cast("long"))
    rows = sliced(df, [*group, *order], "numbers")
    spans = rows.groupBy("_slice", *group).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (spans.withColumn("_carry", F.sum("_rows").over(earlier))
               .where("_carry IS NOT NULL").select("_slice", *group, "_carry"))
    keys = ["_slice", *group]
    here = Window.partitionBy(*keys).orderBy("_pos")
    local = rows.withColumn("_local", (F.row_number().over(here) - 1).cast("long"))
    return (local.alias("l").join(F.broadcast(carried).alias("c"), same_keys(keys, "l", "c"), "left")
            .select(*[F.col(f"l.{c}") for c in df.columns],
                    (F.col("_local") + F.coalesce("_carry", F.lit(0))).alias(into)))

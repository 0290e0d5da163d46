"""Sharding by proportional stratified interleaving.

The rows of each source are put in a seeded random order; row ``r`` (from 0) of a source of ``n`` rows gets the
fractional rank ``(r + 1/2) / n``. In the order of fractional ranks every stretch holds the sources in their overall
proportion, and cutting it into equal stretches gives shards whose row counts differ by one at most.

Both orders are range sorts whose keys differ in almost all rows, so a source of any size spans many tasks; what one
slice needs of the earlier ones is a number per slice, or per slice and source for the first source in it.

Only DataFrame functions are used. Null texts have no bytes and the checksum of an empty one; rows without a source are
a source of their own. Equal ids go by checksum and size; rows equal in all of these are interchangeable. An empty
table has no rows; with fewer rows than shards, some shards are empty.
"""

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.rows import join_small, others
from tidemark.plans.ordered import sliced

SHARDS = 40
SEED = 7
ROW_BYTES = 16  # of a row, beside its text


def measures(text="text"):
    """Size and checksum of a text; take them before the text is left out of the rows that are sorted."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")


def interleave(rows: DataFrame, shards=SHARDS, source="source", key="doc_id", seed=SEED) -> DataFrame:
    """Adds ``shard`` and ``slot`` (from 0 in each shard) to rows that hold ``size, text_crc32``; other columns go
    along, ones named like the added are replaced."""
    keep = others(rows, ["shard", "slot"])
    mixed = rows.select(*[f"`{c}`" for c in keep], F.col(source).alias("__source"),
                        F.xxhash64(F.col(key), F.lit(seed)).alias("__mix"))
    counts = mixed.groupBy("__source").agg(F.count("*").alias("__n"))
    ties = ["__mix", key, "text_crc32", "size"]
    ordered = sliced(mixed, ["__source", *ties], "shard-sources")
    # The number of a row in its source: its place among the source's rows in the slice, and those of earlier slices.
    spans = ordered.groupBy("_slice", "__source").agg(F.min("_pos").alias("__first"), F.count("*").alias("__rows"))
    earlier = Window.partitionBy("__source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("_slice", F.col("__source").alias("__of"), "__first",
                         F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    same = (ordered["_slice"] == spans["_slice"]) & ordered["__source"].eqNullSafe(spans["__of"])
    ranked = _join(ordered, spans, same).withColumn("__rank", F.col("_pos") - F.col("__first") + F.col("__before"))
    ranked = ranked.select(*[f"`{c}`" for c in keep], "__source", "__mix", "__rank")
    sized = _join(ranked, counts.withColumnRenamed("__source", "__of"), F.col("__source").eqNullSafe(F.col("__of")))
    mixture = sized.withColumn("__at", (F.col("__rank") + 0.5) / F.col("__n")).drop("__of", "__n", "__rank")
    ordered = sliced(mixture, ["__at", "__source", *ties], "shard-mixture")
    parts = ordered.groupBy("_slice").agg(F.min("_pos").alias("__first"), F.count("*").alias("__rows"))
    everything = Window.partitionBy(F.lit(0)).orderBy("_slice")  # one row per slice
    parts = parts.select(F.col("_slice").alias("__in"), "__first",
                         (F.sum("__rows").over(everything) - F.col("__rows")).alias("__before"))
    total = rows.count()
    placed = _join(ordered, parts, F.col("_slice") == F.col("__in")).withColumn(
        "__place", F.col("_pos") - F.col("__first") + F.col("__before"))
    shard = F.expr(f"CAST(__place * {shards} DIV {max(total, 1)} AS INT)")
    return placed.withColumn("shard", shard).withColumn(
        "slot", F.col("__place") - F.expr(f"(shard * {total}L + {shards - 1}) DIV {shards}")).select(
        *[f"`{c}`" for c in keep], "shard", "slot")


def _join(rows, small, condition):
    return join_small(rows, small, condition, row_bytes=64)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows in the order of their slots; a large shard is several files."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

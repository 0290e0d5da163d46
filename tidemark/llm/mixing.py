"""Mixing sources to target weights by Sainte-Laguë apportionment.

The target of a source is its weight's share of all tokens, at most ``REPEATS`` times the source's own size; what is beyond goes to the
others by weight, until none is above. Blocks of equal token counts are allocated to sources by highest quotients,
``target / (2 k + 1)`` for a source that holds ``k`` of them, ties by source; a source takes no more blocks than ``REPEATS`` times its
tokens fill. As every allocation begins with the smaller ones, the blocks of shard ``h`` are those between the allocations for ``h`` and
``h + 1`` shards: integer quotas per shard, each shard near the mixture.

The block selection is seeded: the documents of a source stand in an order given by hashes of the seed and their content, their
tokens in that order are cut into blocks, and a source hands its blocks out one after the other, beginning again at its end. So
every token is taken equally often, give or take one time, and most documents stay whole.

Nothing whole is gathered. The quotas come from a search for the divisor at which every source's rounded quotient adds up to the
wanted number of blocks, a few small aggregates over one row per source; places in the seeded order are sums over range-sorted
slices, so that a hot source spans many tasks. Blocks have the largest power of two of tokens, up to ``LARGEST_BLOCK``, that puts
``BLOCKS`` blocks into the smallest target, so a source takes within some 1 / ``BLOCKS`` of its target.

Only DataFrame functions are used. Null texts have no tokens. Rows without a source are a source of their own, the last. Sources go by
code point. Ids may be null or repeat; rows equal in id and text are interchangeable. Sources without tokens have target 0.
"""

import json

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.rows import join_small, others
from tidemark.plans.ordered import number_rows, sum_before
from tidemark.session import materialize

WEIGHTS = (5, 2, 1)
REPEATS = 3
SHARDS = 40
SEED = 13
BLOCKS = 256
LARGEST_BLOCK = 4_096
PROBES = 16  # divisors that one aggregate tries, for each shard
FEW = 10_000  # blocks that are allocated one by one at the end, for each shard
NEAR = 1e-9
_TOGETHER = 64  # shards whose divisors are searched in one job
_SOURCE_BYTES = 64


def measures(text="text", key="doc_id", seed=SEED):
    """``size``, the number of words, and ``mix_key``, which orders the rows of a source; take them before the text is left out."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    size = F.size(F.array_remove(F.split(content, "[\\x20\\x09-\\x0D]+"), "")).cast("long").alias("size")
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    return size, F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), content).cast("binary")).alias("mix_key")


def targets(rows: DataFrame, source="source", weights=WEIGHTS, repeats=REPEATS) -> DataFrame:
    """``source, source_size, place, target`` of each source of rows that hold ``size``; ``place`` numbers them. Written."""
    sizes = rows.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum("size").alias("source_size"))
    # Null sorts first in Spark, here it is last.
    ordered = sizes.withColumns({"_all": F.lit(0), "_none": F.col("source").isNull()})
    numbered = number_rows(ordered, ["_all"], ["_none", "source"], "place")
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % len(weights)).cast("int"))
    known = materialize(numbered.select("source", "source_size", "place", weight.alias("weight")), "mix-sources")
    total = known.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    each, full = 0.0, -1
    while True:  # what a weight of one gets; it only grows, so a source at its bound stays there
        at_bound, most = _at_bound(each, repeats)
        now, beyond, left = known.agg(
            F.count_if(at_bound), F.coalesce(F.sum(F.when(at_bound, most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~at_bound, F.col("weight"))), F.lit(0))).first()
        if now == full or not left:
            break
        each, full = (total - beyond) / left, now
    at_bound, most = _at_bound(each, repeats)
    target = F.when(at_bound, most.cast("double")).otherwise(F.col("weight") * F.lit(each))
    return known.select("source", "source_size", "place", target.alias("target"))


def _at_bound(each: float, repeats: int):
    most = F.col("source_size") * repeats
    return F.col("weight") * F.lit(each) > most, most


def _seats(bound, ideal, x):
    """Blocks of a source at a divisor: its quotient rounded to the nearest, up to what it can give."""
    return F.least(bound, F.floor(ideal * x + 0.5).cast("long"))


def _table(rows: list, fields: str):
    """A few rows as one constant."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")


def block_size(sources: DataFrame) -> int:
    least = sources.where("target > 0").agg(F.min("target")).first()[0] or 0
    return max([1] + [2**i for i in range(LARGEST_BLOCK.bit_length()) if 2**i * BLOCKS <= least])


def quotas(sources: DataFrame, block: int, shards=SHARDS, repeats=REPEATS) -> DataFrame:
    """Adds ``until``: for each shard, the number of blocks of the source in this shard and all before it."""
    known = sources.withColumns({"_bound": F.expr(f"source_size * {repeats} div {block}"), "_ideal": F.col("target") / block})
    total, room, far = known.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_bound"), F.lit(0)),
                                 F.max(F.when(F.col("_ideal") > 0, (F.col("_bound") + 1) / F.col("_ideal")))).first()
    whole = min((2 * total + block) // (2 * block), room)
    houses = [whole * (h + 1) // shards for h in range(shards)]
    # A divisor that allocates at most the wanted number of blocks, and one that allocates more.
    low, high = [0.0] * shards, [far or 0.0] * shards
    for begin in range(0, shards, _TOGETHER):
        _narrow(known, houses, low, high, range(begin, min(begin + _TOGETHER, shards)))
    shares = _table([{"low": a, "high": b, "house": n} for a, b, n in zip(low, high, houses)], "low: double, high: double, house: bigint")
    allotted = known.select("*", F.posexplode(shares).alias("shard", "d"))
    bound, ideal = F.col("_bound"), F.col("_ideal")
    allotted = materialize(allotted.select(
        "place", "shard", "_ideal", F.col("d.house").alias("house"),
        _seats(bound, ideal, F.col("d.low")).alias("base"), _seats(bound, ideal, F.col("d.high")).alias("more")), "mix-seats")
    short = allotted.groupBy("shard").agg((F.first("house") - F.sum("base")).alias("missing"))  # a row per shard
    # The last few blocks of a shard go one by one to the highest quotients: some FEW rows in each of these windows.
    steps = allotted.where("more > base").select("place", "shard", "_ideal", F.explode(F.expr("sequence(base + 1, more)")).alias("seat"))
    best = Window.partitionBy("shard").orderBy((F.col("seat") - 0.5) / F.col("_ideal"), "place")
    extra = steps.withColumn("rank", F.row_number().over(best)).join(F.broadcast(short), "shard").where("rank <= missing")
    counted = allotted.select("place", "shard", F.col("base").alias("n")).unionByName(
        extra.groupBy("place", "shard").agg(F.count("*").alias("n")))
    until = counted.groupBy("place", "shard").agg(F.sum("n").alias("n")).groupBy("place").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("shard", "n"))), lambda x: x["n"]).alias("until"))
    return sources.join(until, "place")


def _narrow(known: DataFrame, houses: list, low: list, high: list, shards) -> None:
    """Narrows the divisors of some shards until few blocks lie between them."""
    open_ = list(shards)
    while open_:
        probes = {h: [low[h] + (high[h] - low[h]) * i / PROBES for i in range(1, PROBES)] for h in open_}
        tried = _table([{"h": h, "x": x} for h in open_ for x in [low[h], *probes[h], high[h]]], "h: int, x: double")
        at = known.select("_bound", "_ideal", F.explode(tried).alias("p"))
        found = at.groupBy("p.h", "p.x").agg(F.sum(_seats(F.col("_bound"), F.col("_ideal"), F.col("p.x"))).alias("n")).collect()
        for h in list(open_):
            n = {r.x: r.n for r in found if r.h == h}
            low[h] = max((x for x in n if n[x] <= houses[h]), default=low[h])
            beyond = [x for x in n if n[x] > houses[h]]
            if not beyond:  # all that there is
                low[h] = high[h]
                open_.remove(h)
                continue
            high[h] = min(beyond)
            # Equal quotients are not told apart here: nearer than this, rounding would.
            if n[high[h]] - n[low[h]] <= FEW or high[h] - low[h] <= NEAR * high[h]:
                open_.remove(h)


ADDED = ["size", "source_size", "target", "spans", "taken"]


def mix(rows: DataFrame, source="source", key="doc_id", keep=None, weights=WEIGHTS, repeats=REPEATS, shards=SHARDS) -> DataFrame:
    """Adds ``size, source_size, target``, ``spans`` and ``taken``; columns so named are replaced.

    ``rows`` hold what ``measures`` gives. A span ``shard, at, first, until`` puts the words from ``first`` (from 0) up to ``until`` into
    the shard, ``at`` words after the beginning of its source's part; ``taken`` is the number of words in all spans of a row.
    """
    names = others(rows.select(*[f"`{c}`" for c in (keep if keep is not None else rows.columns)]), [*ADDED, "mix_key"])
    narrow = rows.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)], F.col(f"`{source}`").alias("__source"),
                         F.col(f"`{key}`").alias("__key"), "size", F.col("mix_key").alias("__order"))
    narrow = materialize(narrow, "mix-rows")
    sources = targets(narrow, "__source", weights, repeats)
    block = block_size(sources)
    table = materialize(quotas(sources, block, shards, repeats), "mix-quotas").select(
        F.col("source").alias("__of"), "source_size", "target", "until")
    placed = sum_before(narrow, ["__source"], ["__order", "__key", "size"], "size", "__begin")
    joined = join_small(placed, table, F.col("__source").eqNullSafe(F.col("__of")), row_bytes=_SOURCE_BYTES + 8 * shards)
    begin = F.coalesce("__begin", F.lit(0))

    def in_round(number):
        at = begin + number * F.col("source_size")  # the document's place when the source has begun again so often

        def in_shard(until, h):
            since = F.when(h > 0, F.get("until", h - 1)).otherwise(F.lit(0)) * block
            first = F.greatest(since - at, F.lit(0).cast("long"))
            last = F.least(until * block - at, F.col("size"))
            return F.struct(h.cast("int").alias("shard"), (at + first - since).alias("at"), first.alias("first"), last.alias("until"))

        return F.filter(F.transform("until", in_shard), lambda s: s["first"] < s["until"])

    spans = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long")), in_round))
    spread = joined.withColumn("spans", spans)
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["until"] - s["first"])
    return spread.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)], "size", "source_size", "target", "spans",
                         taken.alias("taken"))


def span_texts(docs: DataFrame, mixed: DataFrame, text="text", key="doc_id") -> DataFrame:
    """``shard, source-ordered at, key, words``: the texts of all spans, one row each, joined by the id, which must be unique here."""
    words = F.array_remove(F.split(F.col("_text"), "[\x20\x09-\x0D]+"), "")
    spans = mixed.select(F.col(f"`{key}`").alias("_id"), F.explode("spans").alias("s"))
    texts = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    return spans.join(texts, "_id").select(
        "s.shard", "s.at", F.col("_id").alias(key),
        F.array_join(F.slice(words, (F.col("s.first") + 1).cast("int"), (F.col("s.until") - F.col("s.first")).cast("int")), " ").alias("words"))

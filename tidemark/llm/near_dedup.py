"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A document's set holds its distinct shingles of ``SHINGLE`` words. A sketch has ``COORDINATES`` bins. Round by round
every shingle is hashed into one bin with a value of that round, and a bin keeps its smallest value; a round's values
are below all later ones, so a filled bin no longer changes, and sets of many shingles need one round only. The
second half of the rounds aims at one bin each, so every bin fills. Two sets agree in a bin with a chance equal to
their similarity, concentrated as for independent hashes.

* ``BANDS`` bands of ``ROWS`` bins each give buckets: a pair of similarity 0.8 misses all of them with a chance of
  1e-7.
* One bit of each bin makes a 256-bit summary; pairs with a smallest class or pivot that differ in more than ``MAX_BITS``
  bits, six standard deviations off the mean at similarity 0.8, or whose sizes alone rule out the similarity, are not
  verified then.
* Documents with equal sets are one class, of which the smallest id goes on.
* In each bucket, every class is verified against the smallest one, on full sets, and verified links are joined to
  components. Only buckets that still hold several components can hide a link. There, in up to ``PIVOTS`` rounds,
  every class meets one random class of the bucket if that is of another component; in a large group of copies, most
  of whose pairs are alike, that joins nearly all. Last, in the buckets that are still open, classes are told by their
  differences from the usual set; an exact prefix filter on the rarest differences finds the candidates, which are
  verified. No pair of different components that could be linked is left out, and none is formed that shares no
  rare difference.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; a text of fewer words than a shingle has its whole
sequence as one. Shingles are 64-bit hashes. Null and empty texts, and those without words, have empty sets and
are linked with nothing; so is a row without an id, whose component is null. Rows that share an id are one document.
"""

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.components import components
from tidemark.llm.rows import SMALL_BYTES, extend, fields, join_small, lower_words, remember
from tidemark.session import materialize

SHINGLE = 5
SIMILARITY = 80  # per cent
COORDINATES = 256
BANDS, ROWS = 40, 5
MAX_BITS = 54
PIVOTS = 2  # rounds at most

_MEMORY = 100_000  # word hashes kept by a worker
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MULTIPLIERS = np.random.default_rng(8).integers(1, 2**63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(z):
    z = (z ^ (z >> np.uint64(30))) * _B
    z = (z ^ (z >> np.uint64(27))) * _C
    return z ^ (z >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word):
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()
remember(__name__, _hashes.clear)


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words."""
    words = lower_words(text)
    if len(_hashes) > _MEMORY:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    if not width:
        return h
    z = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        z = _mix(z * _A + h[i:len(h) - width + 1 + i])
    return np.unique(z)


def sketch(elements: np.ndarray, bins=COORDINATES) -> np.ndarray:
    """The bins' values; ``elements`` is not empty. Extra rounds in a block change no filled bin."""
    empty = np.uint64(2**64 - 1)
    values = np.full(bins, empty)
    n, at = len(elements), 0
    block = max(1, -(-bins * 7 // n))
    while at < 2 * bins:
        rounds = np.arange(at, min(at + block, 2 * bins), dtype=np.uint64)
        z = _mix(_mix(elements[None, :] + (rounds[:, None] + np.uint64(1)) * _A) + _A)
        where = (z >> np.uint64(40)) % np.uint64(bins)
        second = rounds >= bins
        if second.any():
            where[second] = (rounds[second] - np.uint64(bins))[:, None]
        np.minimum.at(values, where.ravel().astype(np.int64),
                      ((rounds << np.uint64(40))[:, None] | (z & np.uint64(2**40 - 1))).ravel())
        at += block
        if (values != empty).all():
            break
    return values


def describe(texts: list, size: int):
    """(set sizes, digests of the sets, band keys, bit summaries) of UTF-8 texts; keys are None for empty sets."""
    sets = [shingles(t, size) for t in texts]
    full = [i for i, s in enumerate(sets) if len(s)]
    digest, keys, bits = [None] * len(sets), [None] * len(sets), [None] * len(sets)
    if full:
        values = np.array([sketch(sets[i]) for i in full])
        banded = values[:, :BANDS * ROWS].reshape(len(full), BANDS, ROWS)
        key = _mix((_mix(banded) * _MULTIPLIERS).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _A)
        summary = np.packbits((values & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
        for row, i in enumerate(full):
            digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
            keys[i], bits[i] = key[row].view(np.int64), summary[row]
    return [list(map(len, sets)), digest, keys, bits]


DESCRIBED = fields(n_shingles="bigint", digest="binary", keys="array<bigint>", bits="array<bigint>")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, similarity: int) -> DataFrame:
    """The pairs ``a, b`` of classes whose full sets are similar enough; ``docs`` has ``id, text``."""
    ids = materialize(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(),
                      "near-ids")
    # Rows that share an id: the set of any of them stands for it, the same in every run.
    sets = materialize(_sets(docs, ids, size), "near-sets")
    sides = pairs.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b").join(
        sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    return sides.where(100 * common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b").distinct()


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """``id, elements``: full sets of the rows with these ids."""
    return extend(join_small(docs, ids, "id", "left_semi"), fields(elements="array<bigint>"),
                  lambda found: [[shingles(t, size).view(np.int64) for t in found]], keep=["id"])


def _plausible(similarity: int):
    """On columns ``n, bits`` and ``n2, bits2``: could the sets be similar enough?"""
    apart = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("bits2")[i])) for i in range(COORDINATES // 64)), F.lit(0))
    return ((100 * F.least("n", "n2") >= similarity * F.greatest("n", "n2")) & (apart <= MAX_BITS))


def group(docs: DataFrame, text="text", key="doc_id", shingle=SHINGLE, similarity=SIMILARITY) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for each row: the smallest id that links lead to, and whether it is
    the row's own (``kept``; true also where the id is null)."""
    source = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = materialize(extend(source, DESCRIBED, lambda texts: describe(texts, shingle), keep=["id"]), "near-rows")
    linked = rows.where("id IS NOT NULL AND n_shingles > 0")
    classes = materialize(
        linked.groupBy("digest").agg(F.min(F.struct("id", F.col("n_shingles").alias("n"), "bits", "keys")).alias("c"))
        .select("digest", "c.*"), "near-classes")
    members = classes.select("id", "n", "bits", F.explode("keys").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("id").alias("first"), F.count("*").alias("size")).where("size > 1")
    shared = materialize(members.select("id", "bucket").join(buckets.select("bucket", "first"), "bucket"), "near-shared")
    about = classes.select("id", "n", "bits")
    links = _links(shared.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(),
                   about, source, shingle, similarity)
    found, members = components(links), shared.select("bucket", "id")
    for seed in range(PIVOTS):
        members = _open(members, found)
        more = _links(_to_pivots(members, seed), about, source, shingle, similarity)
        if more.isEmpty():
            break
        found = _joined(found, more)
    members = _open(members, found)
    if not members.isEmpty():
        certain, candidates = _around(members, source, shingle, similarity)
        more = certain.unionByName(_verified(candidates, source, shingle, similarity))
        if not more.isEmpty():
            found = _joined(found, more)
    found = classes.select("digest", F.col("id").alias("node")).join(found, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("of"))
    result = rows.join(found, "digest", "left").select(
        F.col("id").alias(key), "n_shingles",
        F.when(F.col("n_shingles") > 0, F.when(F.col("id").isNotNull(), F.col("of"))).otherwise(F.col("id"))
        .alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def _links(pairs: DataFrame, about: DataFrame, source: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """The links among pairs ``a, b``: plausible by their summaries, then verified on full sets; written."""
    other = about.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))
    near = pairs.join(about.withColumnRenamed("id", "a"), "a").join(other, "b").where(_plausible(similarity))
    near = materialize(near.select("a", "b"), "near-pairs")
    return materialize(_verified(near, source, shingle, similarity), "near-links")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links; the ones so far are stars already, so few rounds are needed."""
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """``bucket, id, component`` of the buckets that hold several components; written."""
    named = members.select("bucket", "id").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    several = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(
        "low < high")
    return materialize(named.join(several.select("bucket"), "bucket", "left_semi"), "near-open")


def _to_pivots(members: DataFrame, seed: int) -> DataFrame:
    """Each class with its bucket's pivot, a random class, unless they are of one component."""
    pivots = members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id", F.lit(seed)).alias("h"), F.col("id").alias("p"),
                                                          F.col("component").alias("c"))).alias("pivot"))
    met = members.join(pivots.select("bucket", "pivot.p", "pivot.c"), "bucket").where("component <> c")
    return met.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()


def _around(members: DataFrame, source: DataFrame, shingle: int, similarity: int):
    """(links, candidates): pairs ``a, b`` of different components in one bucket, certain ones and those to verify.

    Buckets with the same random class of their commonest component make a group. Its centre is the set of what more
    than half of its classes hold, and a class is told by its ``d`` differences from the centre. With
    ``far = (100 + similarity) d - (100 - similarity) n`` two classes

    * are linked for certain if their ``far`` add up to 0 or less: one link to the class of the least ``far`` stands for
      all of these;
    * else are linked if and only if they share at least ``(far + far') / (2 (100 + similarity))`` differences, one or more.
      By the prefix principle they then share one of their rarest, in one order of all; how many count follows
      from both ``far``. Classes are dealt to strata by octaves of ``far``, and each meets those of its stratum and below,
      so a difference stands in one row, and in one more for each stratum that is asked.

    So copies that differ from the centre in places of their own never meet, and no link is left out.
    """
    weight, slack = 100 + similarity, 100 - similarity
    sizes = members.groupBy("bucket", "component").agg(
        F.count("*").alias("size"), F.min(F.struct(F.xxhash64("id", F.lit(PIVOTS)).alias("h"), "id")).alias("least"))
    pivots = sizes.groupBy("bucket").agg(F.max(F.struct("size", "component", "least")).alias("most")).select(
        "bucket", F.col("most.least.id").alias("p"))
    near = materialize(members.join(pivots, "bucket").select("p", "id", "component").distinct(), "near-around")
    sets = materialize(_sets(source, near.select("id").distinct(), shingle), "near-sets")
    apart = near.join(sets.withColumnRenamed("elements", "x"), "id").join(
        sets.select(F.col("id").alias("p"), F.col("elements").alias("y")), "p").select(
        "p", "id", "component", F.size("x").cast("long").alias("n"), _difference("x", "y").alias("e"))
    apart = materialize(apart, "near-apart")
    # from the pivot to the centre: what more than half of the group has otherwise
    times = apart.select("p", F.explode("e").alias("e")).groupBy("p", "e").agg(F.count("*").alias("times"))
    usual = join_small(times, near.groupBy("p").agg(F.count("*").alias("size")), "p").where("2 * times > size")
    usual = materialize(usual.select("p", "e"), "near-usual")
    centres = usual.groupBy("p").agg(F.collect_list("e").alias("u"))
    few = usual.count() * 16 <= SMALL_BYTES
    apart = apart.join(F.broadcast(centres) if few else centres, "p", "left").withColumn(
        "e", F.when(F.col("u").isNull(), F.col("e")).otherwise(_difference("e", "u")))
    far = weight * F.size("e").cast("long") - slack * F.col("n")
    octave = F.floor(F.log2(1 + F.col("far") / (4 * weight))).cast("int") + 1
    apart = apart.drop("u").withColumn("far", far).withColumn("k", F.when(F.col("far") <= 0, 0).otherwise(octave))
    apart = materialize(apart, "near-told")

    least = apart.groupBy("p").agg(F.min(F.struct("far", "id", "component")).alias("o"))
    certain = join_small(apart, least, "p", row_bytes=64).where("far + o.far <= 0 AND id <> o.id AND component <> o.component").select(
        F.least("id", "o.id").alias("a"), F.greatest("id", "o.id").alias("b")).distinct()

    each = apart.select("p", "id", F.explode("e").alias("e"))
    shared = each.groupBy("p", "e").agg(F.count("*").alias("times")).where("times > 1")
    found = each.join(shared, ["p", "e"]).groupBy("p", "id").agg(F.array_sort(F.collect_list(F.struct("times", "e")))["e"].alias("found"))
    strata = apart.groupBy("p", "k").agg(F.min("far").alias("least")).groupBy("p").agg(
        F.array_sort(F.collect_list(F.struct("k", "least"))).alias("strata"))
    ranked = join_small(apart.select("p", "id", "component", "far", "k").join(found, ["p", "id"]), strata, "p", row_bytes=512)
    # The place of a difference serves for the partners whose ``far`` is at most its reach: all that come later in the order, itself
    # included, are then as many as the two have to share. Differences of one class alone come first: they meet nothing.
    places = F.transform("found", lambda e, i: F.struct(e.alias("e"), (2 * weight * (F.size("found") - i) - F.col("far")).alias("reach")))
    ranked = ranked.withColumn("places", F.filter(places, lambda at: at["reach"] >= F.col("strata")[0]["least"])).select(
        "p", "id", "component", "far", "k", "strata", F.explode("places").alias("at")).select(
        "p", "id", "component", "far", "k", "strata", "at.e", "at.reach")
    ranked = materialize(ranked, "near-ranked")
    # each class asks the strata up to its own
    lower = F.filter("strata", lambda other: (other["k"] <= F.col("k")) & (other["least"] <= F.col("reach")))
    asks = ranked.where("k > 0").select("p", "e", F.explode(lower["k"]).alias("l"), "id", "component", "far", "reach", "k")
    asked = ranked.select("p", "e", F.col("k").alias("l"), F.col("id").alias("b"), F.col("component").alias("c"),
                          F.col("far").alias("far2"), F.col("reach").alias("reach2"))
    met = asks.join(asked, ["p", "e", "l"]).where("component <> c AND (l < k OR id < b) AND far2 <= reach AND far <= reach2")
    return certain, materialize(met.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct(), "near-candidates")


def _difference(one: str, other: str):
    """What only one of two arrays holds."""
    return F.concat(F.array_except(one, other), F.array_except(other, one))


def drop_copies(docs: DataFrame, text="text", key="doc_id", shingle=SHINGLE, similarity=SIMILARITY) -> DataFrame:
    """One row of each group: that of its smallest id.

    Of rows that repeat with an id one stays, chosen by a hash of its text. Rows without an id are documents of their own,
    grouped with all others, and go before one with an id does. Rows without words are grouped with nothing and all stay.
    Ids are whole numbers below 2^62.
    """
    keys = docs.select(F.col(f"`{key}`").alias("k"), _worded(F.col(f"`{text}`")).alias("worded")).where("worded").groupBy("k").agg(
        F.count("*").alias("rows")).agg(F.max("k"), F.max("rows"), F.max(F.col("k").isNull()))
    top, rows, nameless = keys.first()
    if rows is None:
        return docs
    if rows == 1 and not nameless:
        gone = group(docs, text, key, shingle, similarity).where(~F.col("kept")).select(F.col(key))
        return _without(docs, gone, key)
    # rows are numbered once and read many times
    whole = materialize(docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("__row"),
                                    F.monotonically_increasing_id().alias("__place")), "near-numbered")
    given = F.col("__row").getField(key)
    marked = whole.withColumn("__text", F.col("__row").getField(text))
    marked = marked.withColumn("__key", F.when(_worded(F.col("__text")), F.coalesce(given, F.col("__place") + F.lit((top or 0) + 1))))
    first = F.min(F.struct(F.xxhash64("__text").alias("h"), F.col("__place").alias("first"))).alias("least")
    several = marked.where("__key IS NOT NULL").groupBy("__key").agg(first, F.count("*").alias("rows")).where("rows > 1")
    several = materialize(several.select("__key", "least.first"), "near-doubled")
    spare = materialize(join_small(marked, several, "__key").where("__place <> first").select("__place"), "near-spare")
    single = join_small(marked, spare, "__place", "left_anti")
    gone = group(single, "__text", "__key", shingle, similarity).where("NOT kept").select("__key")
    return _without(single, gone, "__key").select("__row.*")


def _worded(text):
    """Does a text hold a word?"""
    return F.coalesce(text.rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))


def _without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return join_small(docs, materialize(gone.distinct(), "near-gone"), key, "left_anti")

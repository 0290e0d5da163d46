"""Language-model scores from a log-frequency Bloom filter.

The training texts give counts of words and of neighbouring pairs, over all of them. A count ``c`` is quantised to a
level, ``1 + floor(log c)`` to base ``BASE``, and the filter holds the n-gram once with each number up to its level;
so its count comes back by probing with 1, 2, ... until a probe fails, and an error can only raise it. The filter
holds levels of all words and of all pairs, also of those met once.

A token's probability interpolates the two orders: of the mass of a context that was met, all but a discount goes to
the pairs in proportion to their counts, all else to the smoothed word probability ``(c + 1) / (N + V + 1)``. As no
pair is left out, the counts of a context's pairs add up to its own.

N-grams are placed by the upper bits of their hashes, about ``PLACE_BYTES`` of text to a place, and go there in
one shuffle, sorted and packed. The place's task adds up their counts and fills the place's part of the filter, ``BITS_PER_ENTRY``
bits an entry however many there are. Up to ``MAX_BYTES`` the filter is broadcast. Where the training texts are so large that it
would be beyond, the texts are written in chunks of ``LOOKED_BYTES``, and the distinct n-grams of each chunk go to their places once, as
counts and as questions together; the place's task fills its bits, probes them, and gives back to the chunk levels, one byte each in the order
asked, and exact counts of words. Both ways probe the same bits, so scores do not depend on the way. A foreign n-gram is found
with a chance of about 4e-5, and no pair counts for more than either of its words.

``base_score`` takes exact counts of words. Beside a broadcast filter, up to ``MAX_WORDS`` distinct words they are a broadcast of
16 bytes each; beyond, the words of all texts are joined with them. Words and pairs are told by 64-bit hashes.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased, and one end. Null and empty texts are an end
alone. Without training texts N and V are 0, every count is 0 and every score is 0. Repeated rows count once each.
"""

import hashlib
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.rows import arrow_arrays, chunks, extend, fields, forget_others, hand_back, limit_batches, lower_words, others, remember
from tidemark.session import materialize

BASE = 1.5
DISCOUNT = 0.3
PROBES = 8
BITS_PER_ENTRY = 24
SEGMENT_BITS = 19
PLACE_BYTES = 16 << 20
PACKED = 1_024  # n-grams in one row on their way to a place
MAX_BYTES = 64 << 20
LOOKED_BYTES = 12 << 20  # texts whose n-grams are asked for together
MAX_WORDS = 6_000_000

WORD, PAIR = 1, 2
_END = xxhash.xxh64_intdigest(b" end")  # no word holds a space
_MEMORY = 400_000
_HELD = 2_000_000  # n-grams that a counting task holds before it sums them up
_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(z):
    z = (z ^ (z >> _U(30))) * _M2
    z = (z ^ (z >> _U(27))) * _M3
    return z ^ (z >> _U(31))


class _Hashes(dict):
    def __missing__(self, word):
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()
remember(__name__, lambda: (_hashes.clear(), _loaded.clear()))


def tokens(texts: list):
    """(hashes of all tokens, hashes of what stands before them, first token of each text)."""
    if len(_hashes) > _MEMORY:
        _hashes.clear()
    words = [lower_words(t) for t in texts]
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    ends = np.cumsum(sizes)
    now = np.full(ends[-1] if len(ends) else 0, _END, np.uint64)
    for end, own in zip(ends.tolist(), words):
        now[end - 1 - len(own):end - 1] = np.fromiter(map(_hashes.__getitem__, own), np.uint64, len(own))
    before = np.roll(now, 1)  # an end stands before the first word, too
    return now, before, ends - sizes


def _pair(before, now):
    """64 bits from all bits of both hashes."""
    return _mix(_mix(before + _M1) ^ now)


def _place(gram, bits: int):
    """The upper ``bits`` bits."""
    return (gram >> _U(64 - bits)).astype(np.int32) if bits else np.zeros(len(gram), np.int32)


def _packed(numbers) -> bytes:
    """Eight planes of bytes: those that are all zero vanish in a compressed shuffle."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(body: bytes):
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _pieces(gram, bits: int):
    """(place, begin, end, packed differences) of at most ``PACKED`` of the sorted n-grams, all of one place."""
    place = _place(gram, bits)
    begins = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place)).tolist()
    for begin, end in zip(begins, begins[1:]):
        for lo in range(begin, end, PACKED):
            hi = min(lo + PACKED, end)
            yield int(place[lo]), lo, hi, _packed(np.diff(gram[lo:hi], prepend=_U(0)))


def _grams_of(body: bytes):
    return np.cumsum(_unpacked(body), dtype=np.uint64)


def text_bytes(docs: DataFrame, text="text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def _bits_for(size: int) -> int:
    return max(0, (-(-size // PLACE_BYTES) - 1).bit_length())


def place_bits(docs: DataFrame, text="text") -> int:
    """Bits that tell places, from the size of the texts."""
    return _bits_for(text_bytes(docs, text))


def _total(held: list):
    """(sorted distinct n-grams, their summed counts, where each given one stands among them) of packed n-grams and counts."""
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    gram, n = np.concatenate([_grams_of(g) for g, _ in held]), np.concatenate([_unpacked(c).view(np.int64) for _, c in held])
    order = np.argsort(gram, kind="stable")
    gram, n = gram[order], n[order]
    first = np.append(True, gram[1:] != gram[:-1])
    begins, where = np.flatnonzero(first), np.zeros(len(gram), np.int32)
    where[order] = np.cumsum(first) - 1
    return gram[begins], np.add.reduceat(n, begins), where


MADE = fields(place="int", segment="int", segments="int", bits="binary", grams="binary", counts="binary", total="bigint", distinct="bigint")


def gather(docs: DataFrame, bits: int, text="text") -> DataFrame:
    """One row for each segment of the filter; a place's first one also holds exact counts of its words. Written."""
    schema = pa.schema([("place", pa.int32()), ("kind", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])

    def summed(kind, held):
        gram, n = np.unique(np.concatenate(held), return_counts=True)
        found = [(place, kind, body, _packed(n[lo:hi])) for place, lo, hi, body in _pieces(gram, bits)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    def run(batches):
        held, size = ([], []), 0
        for batch in batches:
            for part in chunks(batch, 0):
                now, before, _ = tokens(part.column(0).to_pylist())
                held[0].append(now)
                held[1].append(_pair(before, now))
                size += len(now)
                if size >= _HELD:
                    yield summed(WORD, held[0])
                    yield summed(PAIR, held[1])
                    held, size = ([], []), 0
        if size:
            yield summed(WORD, held[0])
            yield summed(PAIR, held[1])

    def finished(place, held):
        (words, times, _), (pairs, met, _) = _total(held[WORD]), _total(held[PAIR])
        found = fill(np.repeat([WORD, PAIR], [len(words), len(pairs)]), np.append(words, pairs), _level(np.append(times, met)))
        width = 2 ** (SEGMENT_BITS - 3)
        for segment in range(len(found) // width):
            first = segment == 0
            yield (place, segment, len(found) // width, found[segment * width:(segment + 1) * width], words.tobytes() if first else None,
                   times.tobytes() if first else None, int(times.sum()) if first else 0, len(words) if first else 0)

    made_schema = pa.schema([(f.name, a) for f, a in zip(MADE.fields, [pa.int32()] * 3 + [pa.binary()] * 3 + [pa.int64()] * 2)])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), made_schema)], schema=made_schema)

    def build(batches):
        place, held = None, {WORD: [], PAIR: []}
        for batch in batches:
            for at, kind, grams, times in zip(*[c.to_pylist() for c in batch.columns]):
                if at != place:
                    if place is not None:
                        yield batch_of(list(finished(place, held)))
                    place, held = at, {WORD: [], PAIR: []}
                held[kind].append((grams, times))
        if place is not None:
            yield batch_of(list(finished(place, held)))

    limit_batches(docs.sparkSession)
    texts = docs.select(F.col(text).cast("binary").alias("text"))
    sent = texts.mapInArrow(run, fields(place="int", kind="int", grams="binary", counts="binary"))
    return materialize(sent.repartition("place").sortWithinPartitions("place").mapInArrow(build, MADE), "lm-filter")


def _level(n):
    """Quantised count."""
    return (np.floor(np.log(n) / np.log(BASE) + 1e-9) + 1).astype(np.int64)


def _count_of(level):
    return np.where(level > 0, BASE ** (level - 1.0) * (1 + BASE) / 2 - (BASE - 1) / 2 * (level == 1), 0.0)


def _key(kind, gram: np.ndarray):
    return _mix(gram + np.atleast_1d(np.asarray(kind, np.uint64)) * _M1)


def _bit(key, level, probe):
    return _mix(key + _U((level * PROBES + probe) * int(_M2) % 2**64)) & _U(2**SEGMENT_BITS - 1)


def fill(kind, gram, level) -> bytes:
    """The filter's bits for n-grams of one place, in whole segments."""
    segments = -(-int(level.sum()) * BITS_PER_ENTRY >> SEGMENT_BITS)
    bits = np.zeros(segments << SEGMENT_BITS, np.uint8)
    key = _key(kind, gram)
    base = (key % _U(max(1, segments))) << _U(SEGMENT_BITS)
    for own in range(1, int(level.max(initial=0)) + 1):
        among = level >= own
        base, key, level = base[among], key[among], level[among]
        for probe in range(PROBES):
            bits[base | _bit(key, own, probe)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """Probes of places that follow one another; ``starts`` has each one's first segment, and the end."""

    exact = None

    def __init__(self, bits, starts=None, place_bits=0):
        self.bits = np.frombuffer(bits, np.uint8)
        self.starts = np.array([0, len(bits) >> (SEGMENT_BITS - 3)] if starts is None else starts, np.uint64)
        self.place_bits = place_bits

    def level(self, kind: int, grams: np.ndarray) -> np.ndarray:
        found = np.zeros(len(grams), np.int64)
        key, place = _key(kind, grams), _place(grams, self.place_bits)
        own = self.starts[place + 1] - self.starts[place]
        base = (self.starts[place] + key % np.maximum(own, _U(1))) << _U(SEGMENT_BITS)
        alive, level = np.flatnonzero(own), 0
        while len(alive):
            level += 1
            for probe in range(PROBES):
                at = base[alive] | _bit(key[alive], level, probe)
                alive = alive[(self.bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1]
            found[alive] = level
        return found


def _whole(made: DataFrame, bits: int) -> tuple:
    """What a ``Filter`` of all places is made of."""
    found = {(r.place, r.segment): bytes(r.bits) for r in made.select("place", "segment", "bits").toLocalIterator()}
    sizes = np.bincount([place for place, _ in found], minlength=2**bits) if found else np.zeros(2**bits, np.int64)
    return b"".join(found[at] for at in sorted(found)), np.append(0, np.cumsum(sizes)), bits


def _exact(made: DataFrame):
    """Sorted hashes and counts of words, as bytes."""
    rows = [(bytes(r.grams), bytes(r.counts)) for r in made.where("segment = 0").select("grams", "counts").toLocalIterator()]
    gram, n = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*rows), (np.uint64, np.int64)))
    order = np.argsort(gram)
    return gram[order].tobytes(), n[order].tobytes()


def _words(made: DataFrame) -> DataFrame:
    """``gram, n`` of all words."""
    def run(batches):
        for batch in batches:
            for gram, n in zip(*[c.to_pylist() for c in batch.columns]):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(gram, np.int64)), pa.array(np.frombuffer(n, np.int64))],
                                                 names=["gram", "n"])

    return made.where("segment = 0").select("grams", "counts").mapInArrow(run, fields(gram="bigint", n="bigint"))


class Model:
    """What the workers need: totals, the filter if it is broadcast, and exact counts of words if they are few enough."""

    def __init__(self, total, distinct, bits, exact):
        self.total, self.distinct = total, distinct
        self.filter = bits and Filter(*bits)
        self.exact = exact and (np.frombuffer(exact[0], np.uint64), np.frombuffer(exact[1], np.int64))

    def score(self, texts: list, found=None, split=None):
        """(tokens, known tokens, base score, score) of each text; without exact counts the middle two are 0.
        ``found`` has the levels of the texts' n-grams if the filter is not here, ``split`` their tokens if those are known."""
        found = found or self.filter
        exact = self.exact or found.exact
        now, before, begins = split or tokens(texts)
        if not len(begins):
            return [], [], [], []
        sizes = np.diff(np.append(begins, len(now)))
        if not self.total:
            zero = np.zeros(len(sizes))
            return sizes, zero.astype(np.int64), zero, zero
        mass = self.total + self.distinct + 1
        words, where = np.unique(now, return_inverse=True)
        known, base = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
        if exact:
            at = np.minimum(np.searchsorted(exact[0], words), len(exact[0]) - 1)
            n = np.where(exact[0][at] == words, exact[1][at], 0)
            known = np.add.reduceat((n > 0)[where].astype(np.int64), begins)
            base = np.add.reduceat(np.log10((n + 1) / mass)[where], begins)
        top = found.level(WORD, words)
        uses, before_top = _count_of(top), top[np.roll(where, 1)]
        context = _count_of(before_top)
        share = np.where(context > 0, 1 - DISCOUNT, 0.0)
        seen = np.flatnonzero(context > 0)
        met = np.zeros(len(now))
        if len(seen):
            pairs, back = np.unique(_pair(before[seen], now[seen]), return_inverse=True)
            most = np.minimum(top[where[seen]], before_top[seen])
            met[seen] = _count_of(np.minimum(found.level(PAIR, pairs)[back], most))
        paired = np.minimum((1 - DISCOUNT) * met / np.maximum(context, 1), share)
        chance = paired + (1 - share) * ((uses + 1) / mass)[where]
        return sizes, known, base, np.add.reduceat(np.log10(np.minimum(chance, 1)), begins)


_loaded: dict = {}


def _model(key, shared) -> Model:
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Model(*shared.value)
    return _loaded[key]


SCORED = fields(n_tokens="bigint", n_known="bigint", base_score="double", score="double")


def score(docs: DataFrame, training, text="text", keep=None, max_bytes=MAX_BYTES, max_words=MAX_WORDS):
    """Adds ``n_tokens, n_known, base_score, score, train_tokens``; columns so named are replaced.

    ``training``: a frame with texts to learn from, or a condition on the rows of ``docs``, which then are read once for both.
    """
    spark = docs.sparkSession
    keep = others(docs.select(*[f"`{c}`" for c in (keep if keep is not None else docs.columns)]), ["train_tokens"])
    learnt = training if isinstance(training, DataFrame) else docs.where(training)
    size = text_bytes(learnt, text)
    if size > 2 * max_bytes:  # two bytes of text make about one of the filter
        return _looked_up(docs, training, size, text, keep)
    bits = _bits_for(size)
    made = gather(learnt, bits, text)
    total, distinct, segments = made.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("total", "distinct")], F.count("*")).first()
    if segments << (SEGMENT_BITS - 3) > max_bytes:
        return _looked_up(docs, training, size, text, keep)
    exact = _exact(made) if 0 < distinct <= max_words else None
    shared = spark.sparkContext.broadcast((total, distinct, _whole(made, bits), exact))
    name = uuid.uuid4().hex
    compute = lambda texts: list(_model(name, shared).score(texts))
    if exact or not total:
        scored = extend(docs, SCORED, compute, text, keep)
    else:
        scored = _joined(docs, _words(made), total + distinct + 1, compute, text, keep)
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))


class Levels:
    """What the filter's places found for the sorted n-grams of one run of texts: levels, and exact counts of words."""

    def __init__(self, grams: dict, levels: dict, counts: np.ndarray):
        self.grams, self.levels, self.exact = grams, levels, (grams[WORD], counts)

    def level(self, kind: int, grams: np.ndarray) -> np.ndarray:
        return self.levels[kind][np.searchsorted(self.grams[kind], grams)].astype(np.int64)


def _arrow_schema(kinds: T.StructType):
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(f.name, types[f.dataType.simpleString()]) for f in kinds.fields])


ASKED = fields(place="int", chunk="bigint", first="bigint", size="bigint", kind="int", begin="bigint", grams="binary", counts="binary")
ANSWER = fields(chunk="bigint", first="bigint", size="bigint", kind="int", begin="bigint", levels="binary", counts="binary", total="bigint",
                distinct="bigint")


def _asking(bits: int):
    """From ``text, learn, chunk, at`` to the distinct n-grams of each run with their counts in the texts to learn from.

    A run is the part of a chunk that a task meets in one go. Texts of chunk -1 are learnt from and not asked for.
    """
    schema = _arrow_schema(ASKED)

    def rows(run, held):
        chunk, first, size = run
        now, before, among = map(np.concatenate, zip(*held))
        for kind in (WORD, PAIR):
            every = now if kind == WORD else _pair(before, now)
            gram, n = np.unique(every, return_counts=True)
            if not among.all():
                foreign, times = np.unique(every[~among], return_counts=True)
                n[np.searchsorted(gram, foreign)] -= times
            found = [(place, chunk, first, size, kind, lo, body, _packed(n[lo:hi])) for place, lo, hi, body in _pieces(gram, bits)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    def run(batches):
        forget_others(__name__)
        own, held, size = None, [], 0  # of the open run: chunk, first row and number of rows; tokens; number of tokens
        for batch in batches:
            for part in chunks(batch, 0):
                learn, chunk, at = (c.to_numpy(zero_copy_only=False) for c in part.columns[1:])
                cuts = np.flatnonzero((np.diff(chunk) != 0) | (np.diff(at) != 1) & (chunk[1:] >= 0)) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunk)]):
                    new = int(chunk[lo]), int(at[lo])
                    if own and (own[0] != new[0] or (size >= _HELD if new[0] < 0 else own[1] + own[2] != new[1])):
                        yield from rows(own, held)
                        own = None
                    if not own:
                        own, held, size = (*new, 0), [], 0
                    now, before, begins = tokens(part.column(0).slice(lo, hi - lo).to_pylist())
                    held.append((now, before, np.repeat(learn[lo:hi], np.diff(np.append(begins, len(now))))))
                    own, size = (*new[:1], own[1], own[2] + hi - lo), size + len(now)
        if own:
            yield from rows(own, held)
        held = None
        hand_back()

    return run


def _answering(batches):
    """The n-grams of whole places, one after the other, to what the runs asked for, and a row of totals for each place."""
    schema = _arrow_schema(ANSWER)

    def rows(held):
        asked, summed = {k: [r for r in held if r[3] == k] for k in (WORD, PAIR)}, {}
        for kind, own in asked.items():
            summed[kind] = _total([r[5:7] for r in own])
        learnt = {k: n > 0 for k, (_, n, _) in summed.items()}
        kinds = np.repeat([WORD, PAIR], [learnt[k].sum() for k in (WORD, PAIR)])
        gram, n = (np.concatenate([summed[k][i][learnt[k]] for k in (WORD, PAIR)]) for i in (0, 1))
        probes = Filter(fill(kinds, gram, _level(n)))
        yield [(None, None, None, None, None, None, None, int(summed[WORD][1].sum()), int(learnt[WORD].sum()))]
        for kind, own in asked.items():
            gram, n, where = summed[kind]
            level = np.minimum(probes.level(kind, gram), 255).astype(np.uint8)
            ends = np.cumsum([len(r[5]) // 8 for r in own]).tolist()
            found = []
            for (chunk, first, size, _, begin, _, _), lo, hi in zip(own, [0, *ends], ends):
                if chunk >= 0:
                    at = where[lo:hi]
                    found.append((chunk, first, size, kind, begin, level[at].tobytes(), _packed(n[at]) if kind == WORD else None, None, None))
            if found:
                yield found

    def batches_of(held):
        for found in rows(held):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    open_place, held = None, []
    for batch in batches:
        for place, *row in zip(*[c.to_pylist() for c in batch.columns]):
            if place != open_place:
                if held:
                    yield from batches_of(held)
                open_place, held = place, []
            held.append(row)
    if held:
        yield from batches_of(held)
    held = None
    hand_back()


def _looked_up(docs, training, size: int, text, keep):
    """Scores by a filter that is not broadcast: its places answer for the n-grams of runs of texts.

    What comes back is told by the run's first row and number of rows, and by the place in its sorted n-grams, which are
    found again from its texts.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    keep = others(docs.select(*[f"`{c}`" for c in keep]), SCORED.names)
    given = [f"__k{i}" for i in range(len(keep))]
    apart = isinstance(training, DataFrame)
    learn = F.lit(False) if apart else F.coalesce(training.cast("boolean"), F.lit(False))
    source = docs.select(*[F.col(f"`{c}`").alias(g) for c, g in zip(keep, given)], F.col(text).cast("binary").alias("__text"),
                         learn.alias("__learn"))

    def chunked(batches):
        chunk, at, held = 0, 0, None
        for batch in batches:
            for part in chunks(batch, len(keep)):
                own = pc.sum(pc.binary_length(part.column(len(keep)))).as_py() or 0
                if held is None or held + own > LOOKED_BYTES:
                    chunk, at, held = int.from_bytes(os.urandom(8)) >> 1, 0, 0
                rows = part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(rows, chunk)), pa.array(np.arange(at, at + rows))],
                                                 names=[*given, "__text", "__learn", "__chunk", "__at"])
                at, held = at + rows, held + own

    # chunks are numbered at random, so they are written once and read twice
    rows = materialize(source.mapInArrow(chunked, T.StructType([*source.schema.fields, *fields(__chunk="bigint", __at="bigint")])), "lm-texts")
    given_texts = rows.select("__text", "__learn", "__chunk", "__at")
    bits = _bits_for(max(size, text_bytes(docs, text)))
    sent = given_texts.mapInArrow(_asking(bits), ASKED)
    if apart:
        more = training.select(F.col(text).cast("binary"), F.lit(True), F.lit(-1).cast("long"), F.lit(0).cast("long"))
        sent = sent.union(more.toDF(*given_texts.columns).mapInArrow(_asking(bits), ASKED))
    found = materialize(sent.repartition("place").sortWithinPartitions("place").mapInArrow(_answering, ANSWER), "lm-levels")
    total, distinct = found.where("chunk IS NULL").agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("total", "distinct")]).first()
    schema = T.StructType([*source.schema.fields[:-2], *SCORED.fields])

    def finished(own, answers):
        own, answers = own.sort_by("__at"), answers.sort_by([("first", "ascending"), ("kind", "ascending"), ("begin", "ascending")])
        first, size, kind, levels, counts = (answers[c].to_pylist() for c in ("first", "size", "kind", "levels", "counts"))
        model, parts = Model(total, distinct, None, None), []
        for begin, rows in sorted(set(zip(first, size))):
            of_run = [p for b in own.slice(begin, rows).to_batches() for p in chunks(b, b.schema.get_field_index("__text"))]
            split = [tokens(p.column("__text").to_pylist()) for p in of_run]
            grams = {WORD: np.unique(np.concatenate([now for now, _, _ in split])),
                     PAIR: np.unique(np.concatenate([_pair(before, now) for now, before, _ in split]))}
            body = lambda values, k: [x for at, of, x in zip(first, kind, values) if (at, of) == (begin, k)]
            here = Levels(grams, {k: np.frombuffer(b"".join(body(levels, k)), np.uint8) for k in (WORD, PAIR)},
                          np.concatenate([_unpacked(x).view(np.int64) for x in body(counts, WORD)]))
            for part, tokens_of in zip(of_run, split):
                arrays = [*[part.column(c) for c in given], *arrow_arrays(model.score(None, here, tokens_of), SCORED)]
                parts.append(pa.RecordBatch.from_arrays(arrays, names=schema.names))
        hand_back()
        return pa.Table.from_batches(parts)

    asked = found.where("chunk IS NOT NULL").select("chunk", "first", "size", "kind", "begin", "levels", "counts")
    scored = rows.drop("__learn").groupBy("__chunk").cogroup(asked.groupBy("chunk")).applyInArrow(finished, schema)
    return scored.select(*[F.col(g).alias(c) for c, g in zip(keep, given)], *[f"`{c}`" for c in SCORED.names],
                         F.lit(total).cast("long").alias("train_tokens"))


def _digests(texts):
    return [hashlib.blake2b(t or b"", digest_size=16).digest() for t in texts]


def _joined(docs, words, mass, compute, text, keep):
    """The same with base scores from a join of the words of all distinct texts with their counts."""
    names = [f.name for f in SCORED.fields]
    added = fields(n_tokens="bigint", __known="bigint", __base="double", score="double", __digest="binary")
    rows = extend(docs, added, lambda texts: [*compute(texts), _digests(texts)], text, keep)
    schema = pa.schema([("digest", pa.binary()), ("gram", pa.int64()), ("times", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 0):
                for raw in part.column(0).to_pylist():
                    gram, times = np.unique(tokens([raw])[0], return_counts=True)
                    own = pa.array(_digests([raw]) * len(gram), pa.binary())
                    yield pa.RecordBatch.from_arrays([own, pa.array(gram.view(np.int64)), pa.array(times)], schema=schema)

    texts = docs.select(F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text")).distinct()
    used = texts.mapInArrow(run, fields(digest="binary", gram="bigint", times="bigint"))
    n = F.coalesce("n", F.lit(0))
    sums = used.join(words.select("gram", "n"), "gram", "left").groupBy("digest").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("times") * F.log10((n + 1) / F.lit(mass))).alias("base_score"))
    joined = rows.join(sums.withColumnRenamed("digest", "__digest"), "__digest")
    return joined.select(*[f"`{c}`" for c in rows.columns if not c.startswith("__") and c not in names], *names)

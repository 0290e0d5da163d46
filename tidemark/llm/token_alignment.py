"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Two tokenizers, a byte-level one (A) and a piece one (B), cut the same bytes, a space and the text. Byte offsets where a token
of each ends are shared cuts. An interval between two shared cuts, at first the whole text, is split at a shared cut near its
middle: A's ends are tried outward from the middle, and each is looked up among B's ends by bisection. Both halves are split in
the same way; an interval without a cut inside is a group. All intervals of a block of texts are split side by side.

Tokens whose bytes overlap are linked. The count of an id pair is the number of documents, over the whole corpus, that hold it
linked. Links are found once and written with the rows, as the distinct pairs of each document; counting them is one
aggregation. The pairs with the highest counts, up to ``MAX_PAIRS``, are broadcast with their counts. All others are joined: as
there are so many pairs above them, none of them is in more than a few millionths of the rows, so none is hot.

Null and empty texts, and those that a tokenizer does not give back byte by byte, have no tokens, and zeros. Texts are encoded
whole; a text beyond ``SEGMENT`` bytes is encoded in parts, cut before a space between two other characters, where neither tokenizer
joins; a text without such a place is encoded at once. Repeated rows are documents of their own; ids may be null.
"""

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from tidemark.llm.rows import extend, fields, others
from tidemark.session import materialize

SEGMENT = 1 << 20  # characters of a text that are encoded at once
BLOCK = 1 << 20  # bytes of texts that are aligned side by side
TRIES = 16  # ends tried one at a time, before all of an interval are
MAX_PAIRS = 2_000_000  # pairs that are broadcast, 16 bytes each
MAX_FILE = 64 << 20
_HELD = 4_000_000  # pairs that a counting task holds before it sums them up

# Fixed: how the byte-level tokenizer parts a text before it merges.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SETTLED = re.compile("[\x00-ɏ]*")  # kinds of these characters are the same in every version of Unicode
_RUNS = re.compile(r"\s{500}|\S{5000}")


def _byte_letters() -> dict:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be printed, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteSide:
    """Byte-level BPE from the text of its JSON file."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._whole = Tokenizer.from_str(spec)
        self._whole.no_truncation()
        self._whole.no_padding()
        self._whole.encode_special_tokens = True
        letters = _byte_letters()
        self.bytes = [b""] * (max(self._whole.get_vocab(with_added_tokens=True).values()) + 1)
        for token, i in self._whole.get_vocab(with_added_tokens=False).items():
            self.bytes[i] = bytes(map(letters.__getitem__, token)) if set(token) <= letters.keys() else token.encode()
        self._fast = self._by_rank(json.loads(spec))

    def _by_rank(self, spec):
        """A faster encoder with the same merges, if ids follow the order of the merges; else None."""
        model, parts = spec["model"], spec["pre_tokenizer"] or {}
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ids = [model["vocab"][m] for m in merges]
        single = [i for t, i in model["vocab"].items() if len(t) == 1]
        usual = (parts.get("type"), parts.get("use_regex"), parts.get("add_prefix_space"), spec["normalizer"]) == (
            "ByteLevel", True, False, None)
        odd = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
        if not usual or any(odd) or ids != sorted(set(ids)) or len(single) != 256 or not ids or max(single) >= ids[0]:
            return None
        ranks = {self.bytes[i]: i for i in [*single, *ids]}
        return tiktoken.Encoding("same", pat_str=_PARTS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list) -> list:
        """Ids of each text, a space put before it."""
        fast = [i for i, t in enumerate(texts) if self._fast and _SETTLED.fullmatch(t) and not _RUNS.search(t)]
        ids: list = [None] * len(texts)
        for i in fast:
            ids[i] = self._fast.encode_ordinary(" " + texts[i])
        rest = [i for i, x in enumerate(ids) if x is None]
        if rest:
            found = self._whole.encode_batch_fast([" " + texts[i] for i in rest], add_special_tokens=False)
            for i, one in zip(rest, found):
                ids[i] = one.ids
        return ids


class PieceSide:
    """Piece BPE with byte fallback, from the bytes of its model; it puts the space itself."""

    def __init__(self, model: bytes):
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
                      for p in pieces]
        # Whether a cut before a space is certain: no piece holds a space after anything else.
        self.parted = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, texts: list) -> list:
        return self._model.encode(texts, num_threads=1)


def segments(text: str, size=SEGMENT) -> list:
    """The text in parts of some ``size`` characters; a space between two characters that are none is left out at each cut."""
    parts, begin = [], 0
    while len(text) - begin > size:
        at = re.compile(r"(?<=\S) (?=\S)").search(text, begin + size)
        if at is None:
            break
        parts.append(text[begin:at.start()])
        begin = at.end()
    return [*parts, text[begin:]]


def split_at_cuts(a_ends, b_ends, texts):
    """The groups of tokens: arrays ``(a begin, a end, b begin, b end)`` of indices, in order.

    ``a_ends`` and ``b_ends`` are rising byte offsets over all texts; ``texts`` has the same four arrays for whole texts.
    """
    lo, hi, blo, bhi = texts
    tried = np.zeros(len(lo), np.int64)
    leaves = []
    while len(lo):
        inside = hi - lo - 1  # ends of A strictly inside
        whole = (inside <= tried) | (bhi - blo < 2)
        if whole.any():
            leaves.append((lo[whole], hi[whole], blo[whole], bhi[whole]))
            lo, hi, blo, bhi, tried, inside = (x[~whole] for x in (lo, hi, blo, bhi, tried, inside))
            if not len(lo):
                break
        middle = (lo + hi - 2) >> 1
        at = middle + np.where(tried & 1, tried + 1, -tried) // 2
        place = np.searchsorted(b_ends, a_ends[at])
        shared = b_ends[place] == a_ends[at]
        for i in np.flatnonzero(~shared & (tried >= TRIES)).tolist():
            ends = np.arange(lo[i], hi[i] - 1)
            found = np.searchsorted(b_ends, a_ends[ends])
            both = np.flatnonzero(b_ends[found] == a_ends[ends])
            if len(both):
                near = both[np.abs(ends[both] - middle[i]).argmin()]
                at[i], place[i], shared[i] = ends[near], found[near], True
            else:
                tried[i] = inside[i]
        # A cut interval becomes two, in place, so that all stay in order and the next look-ups are near each other.
        tried = np.repeat(np.where(shared, 0, tried + 1), 1 + shared)
        right = (np.cumsum(1 + shared) - 1)[shared]
        lo, hi, blo, bhi = (np.repeat(x, 1 + shared) for x in (lo, hi, blo, bhi))
        hi[right - 1] = lo[right] = at[shared] + 1
        bhi[right - 1] = blo[right] = place[shared] + 1
    groups = [np.concatenate(x) for x in zip(*leaves)] if leaves else [np.zeros(0, np.int64)] * 4
    order = np.argsort(groups[0])
    return [g[order] for g in groups]


def overlaps(a_ends, b_ends):
    """For each token of A the first token of B whose bytes overlap its own, and how many do."""
    begins = np.concatenate(([0], a_ends[:-1])) if len(a_ends) else a_ends
    first = np.searchsorted(b_ends, begins, "right")
    return first, np.searchsorted(b_ends, a_ends) - first + 1


class Aligned:
    """A block of texts, encoded and aligned. Tokens of all texts follow one another."""

    def __init__(self, texts, a_ids, b_ids, groups, a_ends, b_ends):
        self.a_of, self.b_of = texts  # where each text's tokens begin, and an end
        self.a_ids, self.b_ids, self.groups = a_ids, b_ids, groups
        self.a_ends, self.b_ends = a_ends, b_ends
        self.g_of = np.searchsorted(groups[0], self.a_of)


class Aligner:
    def __init__(self, spec: str, model: bytes):
        self.a, self.b = ByteSide(spec), PieceSide(model)
        self.sizes = len(self.a.bytes), len(self.b.bytes)
        self._lengths = [np.array([len(x) for x in s.bytes], np.int64) for s in (self.a, self.b)]
        self.pair_type = "<u4" if self.sizes[0] * self.sizes[1] <= 2**32 else "<u8"
        self._labels = [f"{i}{mark}" for n, marks in zip(self.sizes, (",|", (",", ";", ""))) for mark in marks for i in range(n)]

    def _encoded(self, raws: list):
        texts = [r.decode("utf-8", "replace") if r else "" for r in raws]
        parts = [segments(t) if self.b.parted else [t] for t in texts]
        flat = [p for t, own in zip(texts, parts) if t for p in own]
        made = [iter(side.encode(flat)) for side in (self.a, self.b)]
        for raw, text, own in zip(raws, texts, parts):
            ids = [[x for _ in own for x in next(m)] if len(own) > 1 else next(m) for m in made] if text else [[], []]
            whole = all(b"".join(map(side.bytes.__getitem__, x)) == b" " + raw for side, x in zip((self.a, self.b), ids)) if raw else True
            yield ids if whole else [[], []]

    def blocks(self, raws: list):
        """Blocks of aligned texts, in order."""
        begin = held = 0
        for end, raw in enumerate(raws, 1):
            held += len(raw or b"")
            if held >= BLOCK or end == len(raws):
                yield self._aligned(list(self._encoded(raws[begin:end])))
                begin, held = end, 0

    def _aligned(self, ids: list) -> Aligned:
        of = [np.cumsum([0] + [len(x[s]) for x in ids]) for s in (0, 1)]
        flat = [np.array(list(chain.from_iterable(x[s] for x in ids)), np.int64) for s in (0, 1)]
        ends = [np.cumsum(lengths[x]) for lengths, x in zip(self._lengths, flat)]
        full = np.flatnonzero(np.diff(of[0]) > 0)
        groups = split_at_cuts(*ends, (of[0][:-1][full], of[0][1:][full], of[1][:-1][full], of[1][1:][full]))
        return Aligned(of, *flat, groups, *ends)

    def group_texts(self, found: Aligned):
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        lo, hi, blo, bhi = found.groups
        a_at = np.arange(len(found.a_ids)) + np.repeat(blo, hi - lo)
        b_at = np.arange(len(found.b_ids)) + np.repeat(hi, bhi - blo)
        a_label, b_label = found.a_ids.copy(), found.b_ids + 2 * self.sizes[0]
        a_label[hi - 1] += self.sizes[0]
        b_label[bhi - 1] += self.sizes[1]
        last = found.b_of[1:][np.diff(found.b_of) > 0] - 1
        b_label[last] += self.sizes[1]
        labels = np.empty(len(a_at) + len(b_at), np.int64)
        labels[a_at], labels[b_at] = a_label, b_label
        bounds = (found.a_of + found.b_of).tolist()
        name = self._labels.__getitem__
        for begin, end in zip(bounds, bounds[1:]):
            yield "".join(map(name, labels[begin:end].tolist()))

    def pairs(self, found: Aligned):
        """(links of each text, its distinct linked id pairs, and how often each is linked), pairs and times as bytes."""
        first, count = overlaps(found.a_ends, found.b_ends)
        total = np.concatenate(([0], np.cumsum(count)))
        at = np.arange(total[-1]) + np.repeat(first - total[:-1], count)
        of = np.repeat(np.arange(len(found.a_of) - 1), np.diff(found.a_of))
        width = self.sizes[0] * self.sizes[1]
        keys, times = np.unique(np.repeat(of * width + found.a_ids * self.sizes[1], count) + found.b_ids[at], return_counts=True)
        bounds = np.searchsorted(keys, np.arange(len(found.a_of)) * width).tolist()
        pairs, times = (keys % width).astype(self.pair_type), times.astype("<u4")
        links = np.diff(total[found.a_of]).tolist()
        return links, [(pairs[a:b].tobytes(), times[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]


@lru_cache(maxsize=1)
def _aligner(spec: bytes, model: bytes) -> Aligner:
    return Aligner(spec.decode(), model)


def _shared(spark, *paths):
    files = []
    for path in paths:
        with open(path, "rb") as file:
            files.append(file.read(MAX_FILE + 1))
        if len(files[-1]) > MAX_FILE:
            raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
    return spark.sparkContext.broadcast(tuple(files))


def align(docs: DataFrame, byte_path: str, piece_path: str, text="text", keep=None) -> DataFrame:
    """Adds the tokens and groups themselves: ``a_ids``, ``b_ids``, and for each group in order where it ends, as numbers of
    tokens (``a_until``, ``b_until``) and as a byte offset in the space and the text (``byte_until``)."""
    shared = _shared(docs.sparkSession, byte_path, piece_path)

    def compute(texts):
        columns: list = [[] for _ in range(5)]
        for found in _aligner(*shared.value).blocks(texts):
            for i in range(len(found.a_of) - 1):
                a, b = slice(*found.a_of[i:i + 2]), slice(*found.b_of[i:i + 2])
                g = slice(*found.g_of[i:i + 2])
                hi, bhi = found.groups[1][g], found.groups[3][g]
                zero = found.a_ends[a.start - 1] if a.start else 0
                for column, value in zip(columns, (found.a_ids[a].astype(np.int32), found.b_ids[b].astype(np.int32),
                                                   hi - a.start, bhi - b.start, found.a_ends[hi - 1] - zero)):
                    column.append(value)
        return columns

    return extend(docs, fields(a_ids="array<int>", b_ids="array<int>", a_until="array<bigint>", b_until="array<bigint>",
                               byte_until="array<bigint>"), compute, text, keep)


FOUND = fields(n_a="bigint", n_b="bigint", n_groups="bigint", n_links="bigint", groups_sha256="string", __pairs="binary",
               __times="binary")


def _found(docs: DataFrame, shared, text, keep) -> DataFrame:
    def compute(texts):
        columns: list = [[] for _ in FOUND.names]
        for found in _aligner(*shared.value).blocks(texts):
            links, pairs = _aligner(*shared.value).pairs(found)
            sums = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in _aligner(*shared.value).group_texts(found)]
            made = [np.diff(x).tolist() for x in (found.a_of, found.b_of, found.g_of)]
            for column, values in zip(columns, (*made, links, sums, [p for p, _ in pairs], [t for _, t in pairs])):
                column.extend(values)
        return columns

    return extend(docs, FOUND, compute, text, keep)


def _summed(keys, held):
    pairs, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], names=keys)


def counts(found: DataFrame, kind: str) -> DataFrame:
    """``pair, n``: how many rows hold each pair; tasks sum up what they read before the shuffle."""
    def run(batches):
        held, size = [], 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held.append(np.frombuffer(raw, kind))
                size += len(held[-1])
                if size >= _HELD:
                    yield _summed(["pair", "n"], held)
                    held, size = [], 0
        if size:
            yield _summed(["pair", "n"], held)

    return found.select("__pairs").mapInArrow(run, fields(pair="bigint", n="bigint")).groupBy("pair").agg(F.sum("n").alias("n"))


class Counts:
    """The broadcast pairs with their counts; a negative count marks one that is the highest of its first id."""

    def __init__(self, table: pa.Table):
        pairs, signed = table["pair"].to_numpy(), table["signed"].to_numpy()
        order = np.argsort(pairs)
        self.pairs, self.signed = pairs[order], signed[order]

    def look_up(self, pairs):
        """(which pairs are here, their signed counts)"""
        if not len(self.pairs):
            return np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return self.pairs[at] == pairs, self.signed[at]


def _least_hot(table: DataFrame, max_pairs: int) -> int:
    """The smallest power of two so that at most ``max_pairs`` pairs have so high a count."""
    sizes = {r.bits: r.n for r in table.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("n")).collect()}
    bits = 64
    while bits > 1 and sum(n for b, n in sizes.items() if b >= bits - 1) <= max_pairs:
        bits -= 1
    return 2 ** (bits - 1)


ADDED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def link_counts(docs: DataFrame, byte_path: str, piece_path: str, text="text", keep=None, max_pairs=MAX_PAIRS) -> DataFrame:
    """Adds ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``; columns so named are replaced.

    ``n_best`` counts the links whose pair has the highest count of all pairs of its A id, ties included; ``count_sum`` adds up
    the counts over the links.
    """
    spark = docs.sparkSession
    shared = _shared(spark, byte_path, piece_path)
    aligner = _aligner(*shared.value)
    kind, width = aligner.pair_type, aligner.sizes[1]
    whole = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(keep if keep is not None else docs.columns)],
                        F.col(f"`{text}`").alias("__t"))
    names = [c for c in (keep if keep is not None else docs.columns)]
    given = [f"__c{i}" for i in range(len(names))]
    found = materialize(_found(whole, shared, "__t", given).withColumn("__row", F.monotonically_increasing_id()), "align-rows")

    counted = materialize(counts(found, kind), "align-counts")
    best = counted.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("n").alias("most"))
    top = F.col("n") == F.col("most")
    # One row per A id is joined: no more than the first vocabulary has entries.
    table = materialize(counted.withColumn("a", F.expr(f"pair div {width}")).join(F.broadcast(best), "a")
                        .select("pair", "n", F.when(top, -F.col("n")).otherwise(F.col("n")).alias("signed")), "align-table")
    hot = _least_hot(table, max_pairs)
    counts_here = spark.sparkContext.broadcast(Counts(table.where(F.col("n") >= hot).select("pair", "signed").toArrow()))
    all_here = table.where(F.col("n") < hot).isEmpty()

    known = fields(n_best="bigint", count_sum="bigint", __rest="array<bigint>", __often="array<bigint>")

    def compute(pairs, times):
        columns: list = [[] for _ in known.names]
        for raw, often in zip(pairs, times):
            own, often = np.frombuffer(raw, kind).astype(np.int64), np.frombuffer(often, "<u4").astype(np.int64)
            here, signed = counts_here.value.look_up(own)
            signed, met = signed[here], often[here]
            for column, value in zip(columns, (int(met[signed < 0].sum()), int((met * np.abs(signed)).sum()), own[~here], often[~here])):
                column.append(value)
        return columns

    rows = extend(found, known, compute, "__pairs", [*given, *FOUND.names[:5], "__row"], more=["__times"])
    if not all_here:
        rows = materialize(rows, "align-known")
        asked = rows.select("__row", F.explode(F.arrays_zip(F.col("__rest").alias("pair"), F.col("__often").alias("often"))).alias("p"))
        rest = asked.select("__row", "p.pair", "p.often").join(table.where(F.col("n") < hot), "pair").groupBy("__row").agg(
            F.sum(F.when(F.col("signed") < 0, F.col("often")).otherwise(0)).alias("__more_best"),
            F.sum(F.col("often") * F.col("n")).alias("__more_sum"))
        rows = rows.join(rest, "__row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("__more_best", F.lit(0)),
            "count_sum": F.col("count_sum") + F.coalesce("__more_sum", F.lit(0))})
    kept = [(own, name) for own, name in zip(given, names) if name in others(docs.select(*[f"`{n}`" for n in names]), ADDED)]
    return rows.select(*[F.col(own).alias(name) for own, name in kept], *ADDED)

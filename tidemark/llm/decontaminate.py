"""Benchmark decontamination by a generalised suffix automaton over the words of all test items.

Texts are read word by word through the automaton, which always knows the longest run of words ending here that
some item holds. A window is ``window`` consecutive words of an item, or the whole of a shorter item. Wherever the
current match covers a window, its words are hit. The hit spans are what decontamination removes; a text whose hit
words reach ``1/coverage`` of all its words is contaminated.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. Null and empty texts have no words and
are never hit; items without words hold no window; items that share an id count as one, a null id as an empty
one. The items reach the workers in blocks of ``BLOCK_WORDS`` words, of which one is an automaton at a time; the
blocks of one pass over the texts are a broadcast of at most ``PASS_BYTES``, and each further pass adds to what the
earlier ones found.
"""

import re
import uuid

from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.rows import ALNUM, CHUNK, alnum_words, extend, fields, others, remember
from tidemark.session import materialize

WINDOW = 13
COVERAGE = 20  # contaminated: coverage * hit words >= words
BLOCK_WORDS = 200_000  # words of test items in one automaton
PASS_BYTES = 32 << 20  # words of test items that are broadcast at one time

_WORD = re.compile(rb"[^ ]+")


class Automaton:
    """Generalised suffix automaton of (item, words) pairs."""

    def __init__(self, items, window: int = WINDOW):
        self.window = window
        self.next, self.link, self.size = [{}], [-1], [0]
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            at = 0
            for word in words:
                at = self._append(at, word)
        self._windows: dict = {}  # state of a whole window: its items
        self._shorts: dict = {}  # state of a whole shorter item: {words: items}
        for name, words in items:
            if len(words) < window:
                at = 0
                for word in words:
                    at = self.next[at][word]
                self._shorts.setdefault(at, {}).setdefault(len(words), set()).add(name)
            else:
                for at in self._window_states(words):
                    self._windows.setdefault(at, set()).add(name)
        self.least = min([window, *(n for found in self._shorts.values() for n in found)])

    def _clone(self, at, state, word):
        """``state`` is longer than one more than ``at``: gives the part of it that is not."""
        copy = len(self.next)
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.size.append(self.size[at] + 1)
        self.link[state] = copy
        while at >= 0 and self.next[at].get(word) == state:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _append(self, at, word):
        state = self.next[at].get(word)
        if state is not None:  # known from another item
            return state if self.size[state] == self.size[at] + 1 else self._clone(at, state, word)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.size.append(self.size[at] + 1)
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            state = self.next[at][word]
            self.link[new] = state if self.size[state] == self.size[at] + 1 else self._clone(at, state, word)
        return new

    def _window_state(self, at):
        """The state of the last ``window`` words of a match that is at least so long."""
        while self.size[self.link[at]] >= self.window:
            at = self.link[at]
        return at

    def _window_states(self, words):
        at = 0
        for i, word in enumerate(words, 1):
            at = self.next[at][word]
            if i >= self.window:
                yield self._window_state(at)

    def scan(self, words: list):
        """(hit spans as [first, last + 1] in order and apart, items, longest match in words)."""
        follow, link, size, least = self.next, self.link, self.size, self.least
        root, at, matched, longest = follow[0], 0, 0, 0
        spans: list = []
        items: set = set()
        for i, word in enumerate(words):
            state = follow[at].get(word)
            if state is not None:
                at = state
                matched += 1
            elif at == 0:
                continue
            elif word not in root:  # every suffix of a match is a match, so no shorter one goes on either
                at = matched = 0
                continue
            else:
                while word not in follow[at]:
                    at = link[at]
                matched = size[at] + 1
                at = follow[at][word]
            if matched > longest:
                longest = matched
            if matched >= least:
                self._hit(at, matched, i + 1, spans, items)
        return spans, items, longest

    def _hit(self, at, matched, end, spans, items):
        covered = 0
        if matched >= self.window:
            covered = self.window
            items |= self._windows[self._window_state(at)]
        if self._shorts:
            while at > 0:
                for n, found in self._shorts.get(at, {}).items():
                    if n <= matched:
                        covered = max(covered, n)
                        items |= found
                at = self.link[at]
        if covered:
            begin = end - covered
            while spans and spans[-1][1] >= begin:
                begin = min(begin, spans.pop()[0])
            spans.append([begin, end])


_built: dict = {}  # of a worker: the last automaton by its key
remember(__name__, _built.clear)


def _automaton(key, block, window):
    if key not in _built:
        _built.clear()
        _built[key] = Automaton([(name, words.split()) for name, words in block], window)
    return _built[key]


def _blocks(items: DataFrame, item: str, text: str):
    """The distinct items in blocks of about ``BLOCK_WORDS`` words; the driver holds those of one pass."""
    block, size = [], 0
    rows = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")), F.col(text).cast("binary")).distinct()
    for name, raw in rows.toLocalIterator():
        words = alnum_words(bytes(raw) if raw is not None else None)
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        if words:
            block.append((name, b" ".join(words)))
            size += len(words)
    yield block


def _passes(blocks):
    """Lists of blocks whose words together stay under ``PASS_BYTES``."""
    held, size = [], 0
    for block in blocks:
        own = sum(len(words) + 100 for _, words in block)
        if held and size + own > PASS_BYTES:
            yield held
            held, size = [], 0
        held.append(block)
        size += own
    yield held


def _union(spans) -> list:
    merged: list = []
    for begin, end in sorted(spans):
        if merged and begin <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([begin, end])
    return merged


FOUND = fields(n_words="bigint", n_hit="bigint", item_ids="array<string>", longest_match="bigint",
               hit_spans="array<array<bigint>>", contaminated="boolean")
CLEANED = T.StructType([*FOUND.fields, *fields(__clean="binary").fields])  # the text without its hit spans


def find(docs: DataFrame, items: DataFrame, text="text", item="item_id", item_text="text", window=WINDOW,
         coverage=COVERAGE, keep=None) -> DataFrame:
    """Adds ``n_words``, ``n_hit``, ``item_ids`` (sorted), ``longest_match``, ``hit_spans`` (word positions, the end
    excluded) and ``contaminated``; columns so named are replaced."""
    return _find(docs, items, text, item, item_text, window, coverage, keep, FOUND)


def _find(docs, items, text, item, item_text, window, coverage, keep, added) -> DataFrame:
    context = docs.sparkSession.sparkContext
    keep = others(docs.select(*[f"`{c}`" for c in (keep if keep is not None else docs.columns)]), added.names)
    rows, source, more = docs, text, ()
    passes = _passes(_blocks(items, item, item_text))
    blocks = next(passes)
    while blocks is not None:
        following = next(passes, None)
        last = following is None
        compute = _scanner(context.broadcast(blocks), uuid.uuid4().hex, window, coverage, last and added is CLEANED)
        chunk = CHUNK if len(blocks) == 1 else 8 * CHUNK  # each further block is built anew for each chunk
        if last:
            return extend(rows, added, compute, source, keep, more, chunk)
        # Another pass: the text goes along, and what is found then joins what is found now.
        rows = rows.select("*", F.col(source).alias("__again")) if source != "__again" else rows
        rows = materialize(extend(rows, FOUND, compute, source, [*keep, "__again"], more, chunk), "decontaminate")
        source, more, blocks = "__again", ("item_ids", "longest_match", "hit_spans"), following


def _scanner(shared, name, window, coverage, cut_out):
    def compute(texts, *found):
        cut = [alnum_words(t) for t in texts]
        rows = [(set(ids), longest, spans) for ids, longest, spans in zip(*found)] or [(set(), 0, [])] * len(cut)
        for n, block in enumerate(shared.value):
            scan = _automaton((name, n), block, window).scan
            for i, words in enumerate(cut):
                spans, items, longest = scan(words)
                if longest:
                    ids, most, known = rows[i]
                    rows[i] = ids | items, max(most, longest), _union([*known, *spans])
        judged = [_judge(words, *row, coverage) for words, row in zip(cut, rows)]
        if cut_out:
            judged = [(*row, None if row[-1] else _without(raw, row[4])) for raw, row in zip(texts, judged)]
        return list(zip(*judged))

    return compute


def _judge(words, items, longest, spans, coverage):
    hit = sum(end - begin for begin, end in spans)
    return len(words), hit, sorted(items), longest, spans, hit > 0 and coverage * hit >= len(words)


def remove_spans(text: str | None, spans) -> str | None:
    """The text without the words of the spans and what stands between them; the rest is kept as it is."""
    return _without(text.encode(), spans).decode() if spans else text


def _without(raw: bytes | None, spans) -> bytes | None:
    if not spans:
        return raw
    words = [m.span() for m in _WORD.finditer(raw.translate(ALNUM))]
    parts, at = [], 0
    for begin, end in spans:
        parts.append(raw[at:words[begin][0]])
        at = words[end - 1][1]
    return b"".join([*parts, raw[at:]])


def clean(docs: DataFrame, items: DataFrame, text="text", item="item_id", item_text="text", window=WINDOW,
          coverage=COVERAGE) -> DataFrame:
    """Texts beyond the coverage limit go; spans beyond the length limit (a window) are cut from the others.

    The columns are those of ``docs``; where a span was cut and there is an ``n_chars``, it follows the text. One scan: a
    text goes to the automaton once and comes back as it stays.
    """
    names = docs.columns
    rest = [F.col(f"`{c}`") for c in names if c != text]
    packed = docs.select(F.struct(*rest, F.lit(0).alias("__none")).alias("__row"), F.col(f"`{text}`").alias("__text"))
    found = _find(packed, items, "__text", item, item_text, window, coverage, ["__row"], CLEANED).where("NOT contaminated")
    new = F.col("__clean").cast("string")

    def column(c):
        if c == text:
            return new.alias(c)
        kept = F.col(f"__row.`{c}`")
        return F.when(F.col("n_hit") > 0, F.length(new).cast(docs.schema[c].dataType)).otherwise(kept).alias(c) if c == "n_chars" else kept

    return found.select(*map(column, names))

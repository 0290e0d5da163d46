"""BPE encoding and decoding by forced-boundary splitting.

Two neighbouring bytes that stand together inside no token of the vocabulary can never be merged across, so a
cut between them is certain. Texts are cut there, the fragments are encoded independently of each other, and
their ids are concatenated. White space is such a cut already in the raw text, where the tokenizer drops it; so a
raw fragment is a word, most words repeat, and a bounded memory of encoded words does most of the work. A word
that is not in memory is normalised, split by the tokenizer's own rules, cut at every forced boundary, and each
fragment is merged by a BPE model: with the end-of-word mark for the last fragment of a piece, without it before.

Texts are encoded whole. Null text and empty text give no tokens; ties and repeated rows do not matter.
"""

import hashlib
import json
from functools import lru_cache
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import Split

from tidemark.llm.rows import extend, fields, hand_back, remember

MEMORY_WORDS = 800_000  # encoded words kept by a worker, in two generations
SHARED_WORDS = 200_000  # the same where the executor's memory is full of other steps already
BATCH_BYTES = 256 << 10  # texts that are encoded together
LONG_WORD = 64  # bytes; longer words are encoded but not kept
MAX_SPEC_BYTES = 64 << 20  # largest tokenizer file that is broadcast
_BREAK = ord("\n")


class Coder:
    """Encodes as ``Tokenizer.encode(text, add_special_tokens=False)`` does; decodes with special tokens kept."""

    def __init__(self, spec: str, words: int | None = None):
        self._memory = MEMORY_WORDS if words is None else words
        self._whole = Tokenizer.from_str(spec)
        self._whole.no_truncation()
        self._whole.no_padding()
        layout = json.loads(spec)
        model = layout["model"]
        if model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("cuts are certain only for plain BPE, with or without an end-of-word mark")
        suffix = model.get("end_of_word_suffix") or ""
        plain = [t[:-len(suffix)] if suffix and t.endswith(suffix) else t for t in model["vocab"]]
        joined = {ord(a) << 21 | ord(b) for t in plain for a, b in zip(t, t[1:])}
        self._joined = np.array(sorted(joined) or [-1], np.int64)  # pairs of letters that stand together in a token
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._inner = _by_line(BPE(vocab=model["vocab"], merges=merges))
        self._last = (_by_line(BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=suffix)) if suffix
                      else self._inner)
        self._special = [t["content"] for t in layout["added_tokens"]]
        self._decoder = layout["decoder"] is not None
        names = {} if self._decoder else self._whole.get_vocab(with_added_tokens=True)
        spaced = {i: t.encode() + b" " for t, i in names.items()}
        sizes = np.bincount(list(spaced), [len(t) for t in spaced.values()]).astype(np.int64) if spaced else np.zeros(1, np.int64)
        self._names = np.frombuffer(b"".join(spaced[i] for i in sorted(spaced)), np.uint8)  # each with a space after it
        self._name_bounds = np.append(0, np.cumsum(sizes))
        probe = [self._whole.encode(x, add_special_tokens=False).ids for x in ("a \t\n\x0b\x0c\r b", "a", "b")]
        self._drops_space = probe[0] == probe[1] + probe[2] and not any(t != "".join(t.split()) for t in self._special)
        self._of_word: dict = {}
        self._older: dict = {}

    def _pieces(self, words: list):
        """(the words' pieces by the tokenizer's own normaliser and splitter, one after the other, and how many each word has)."""
        normal, split = self._whole.normalizer, self._whole.pre_tokenizer.pre_tokenize_str
        one = lambda w: normal.normalize_str(w) if normal is not None else w
        joined = one(" ".join(words)) if self._drops_space else ""
        parts = joined.split(" ")
        if not self._drops_space or len(parts) != len(words):  # white space beyond ASCII inside of words
            found = [[p for p, _ in split(one(w))] for w in words]
            return [p for own in found for p in own], np.array([len(own) for own in found], np.int64)
        made = split(joined)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        begins = np.fromiter((begin for _, (begin, _) in made), np.int64, len(made))
        return [p for p, _ in made], np.bincount(np.searchsorted(ends, begins, "right"), minlength=len(words))

    def _merge(self, pieces: list):
        """(ids of the pieces, one after the other, as bytes, and how many each has): each piece is cut at its forced boundaries,
        fragments are merged for themselves. Byte-level letters hold no line break."""
        code = np.frombuffer("\n".join(pieces).encode("utf-32-le"), "<u4").astype(np.int64)
        pair, breaks = code[:-1] << 21 | code[1:], code == _BREAK
        at = np.minimum(np.searchsorted(self._joined, pair), len(self._joined) - 1)
        cuts = np.flatnonzero((self._joined[at] != pair) & ~breaks[:-1] & ~breaks[1:]) + 1
        fragments = np.insert(code, cuts, _BREAK).astype("<u4").tobytes().decode("utf-32-le").split("\n")
        ends = np.flatnonzero(breaks)
        order = np.argsort(np.append(cuts, ends), kind="stable")
        last = np.append(np.repeat([False, True], [len(cuts), len(ends)])[order], True)  # fragments that end their piece
        sizes = np.zeros(len(fragments), np.int64)
        heads, sizes[~last] = _merge_lines(self._inner, list(compress(fragments, ~last)))
        tails, sizes[last] = _merge_lines(self._last, list(compress(fragments, last)))
        ids, of_last = np.zeros(len(heads) + len(tails), "<u4"), np.repeat(last, sizes)
        ids[~of_last], ids[of_last] = heads, tails
        return ids.tobytes(), np.diff(np.cumsum(sizes)[last], prepend=0)

    def _learn(self, words: list):
        """Encodes words (raw fragments) each for itself and keeps them."""
        texts = [w.decode("utf-8", "replace") for w in words]
        every = " ".join(texts)
        if any(s in every for s in self._special) or len(every.split()) != len(texts):
            odd = [any(s in t for s in self._special) for t in texts]
            for word, text in compress(zip(words, texts), odd):
                own = self._whole.encode(text, add_special_tokens=False).ids
                self._of_word[word] = np.array(own, "<u4").tobytes()
            rest = [(w, t, len(t.split()) != 1) for w, t, special in zip(words, texts, odd) if not special]
            groups = [[(w, t) for w, t, spaced in rest if not spaced], *[[(w, t)] for w, t, spaced in rest if spaced]]
        else:
            groups = [list(zip(words, texts))]
        for group in filter(None, groups):
            pieces, counts = self._pieces([t for _, t in group])
            raw, sizes = self._merge(pieces) if pieces else (b"", np.zeros(0, np.int64))
            bounds = 4 * np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
            bounds = bounds.tolist()
            self._of_word.update(zip([w for w, _ in group], map(raw.__getitem__, map(slice, bounds, bounds[1:]))))

    def _cut(self, text: bytes | None) -> list:
        return text.split() if text and self._drops_space else [text] if text else []

    def encode(self, texts: list):
        """For each text (ids as little-endian 32-bit integers, decoded text in UTF-8)."""
        begin = size = 0
        for end, text in enumerate(texts, 1):
            size += len(text or b"")
            if size >= BATCH_BYTES or end == len(texts):
                yield from self._encode_some([self._cut(t) for t in texts[begin:end]])
                begin, size = end, 0

    def _decoded(self, raw: list) -> list:
        """Decoded texts in UTF-8; without a decoder they are the names of the ids with spaces between."""
        numbers = [np.frombuffer(r, "<u4") for r in raw]
        if self._decoder:
            return [self._whole.decode(n.tolist(), skip_special_tokens=False).encode() for n in numbers]
        every = np.concatenate(numbers)
        sizes = self._name_bounds[every + 1] - self._name_bounds[every]
        ends = np.append(0, np.cumsum(sizes))
        text = self._names[np.repeat(self._name_bounds[every] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        bounds = ends[np.append(0, np.cumsum([len(n) for n in numbers]))].tolist()
        return [text[a:max(a, b - 1)] for a, b in zip(bounds, bounds[1:])]

    def _encode_some(self, cut: list):
        needed, missing = set().union(*cut), []
        for word in needed.difference(self._of_word):
            found = self._older.get(word)
            if found is None:
                missing.append(word)
            else:
                self._of_word[word] = found
        if missing:
            self._learn(missing)
        ids = self._of_word.__getitem__
        raw = [b"".join(map(ids, words)) for words in cut]
        yield from zip(raw, self._decoded(raw))
        for word in missing:
            if len(word) > LONG_WORD:
                del self._of_word[word]
        if len(self._of_word) > self._memory // 2:  # words that are not met until the next change are forgotten then
            self._older, self._of_word = self._of_word, {}


def _by_line(model: BPE) -> Tokenizer:
    """A tokenizer that merges each line for itself and does nothing else."""
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = Split("\n", "removed")
    return tokenizer


def _merge_lines(tokenizer: Tokenizer, fragments: list):
    """(ids of the fragments, one after the other, and how many each has)."""
    if not fragments:
        return np.zeros(0, "<u4"), np.zeros(0, np.int64)
    found = tokenizer.encode("\n".join(fragments), add_special_tokens=False)
    return np.array(found.ids, "<u4"), np.bincount(np.array(found.word_ids, np.int64), minlength=len(fragments))


@lru_cache(maxsize=1)
def _coder(spec: str, words: int) -> Coder:
    return Coder(spec, words)


remember(__name__, _coder.cache_clear)


def _coded(spec: str, words: int, texts: list) -> list:
    hand_back()  # what the texts before and forgotten words have left
    return list(_coder(spec, words).encode(texts))


def _shared(spark, path):
    with open(path, encoding="utf-8") as file:
        spec = file.read()
    if len(spec) > MAX_SPEC_BYTES:
        raise ValueError(f"a tokenizer file of {len(spec)} bytes is larger than {MAX_SPEC_BYTES}")
    return spark.sparkContext.broadcast(spec)


def encode(docs: DataFrame, tokenizer_path: str, text="text", keep=None, words=MEMORY_WORDS) -> DataFrame:
    """Adds ``token_ids`` (array of int) and ``decoded`` (string); columns so named are replaced."""
    spec = _shared(docs.sparkSession, tokenizer_path)

    def compute(texts):
        coded = _coded(spec.value, words, texts)
        return [[np.frombuffer(ids, "<u4").astype(np.int32) for ids, _ in coded], [d.decode() for _, d in coded]]

    return extend(docs, fields(token_ids="array<int>", decoded="string"), compute, text, keep)


def digests(docs: DataFrame, tokenizer_path: str, text="text", keep=None, words=MEMORY_WORDS) -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of the same encoding; the arrays stay in the task."""
    spec = _shared(docs.sparkSession, tokenizer_path)

    def compute(texts):
        coded = _coded(spec.value, words, texts)
        return [[len(ids) // 4 for ids, _ in coded], [hashlib.sha256(ids).hexdigest() for ids, _ in coded],
                [hashlib.sha256(d).hexdigest() for _, d in coded]]

    return extend(docs, fields(n_tokens="bigint", ids_sha256="string", decoded_sha256="string"), compute, text, keep)

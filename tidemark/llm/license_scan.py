"""License scans: fuzzy search for short notices.

A notice of which at most ``k`` letters are wrong still holds one of its ``k + 1`` equal pieces unharmed. So the exact
pieces of all notices are looked up together in one pass over a text; each place is a candidate, and the regex
library's bounded-error matching verifies the notice around it, with its edits and its span.

A text is searched as its words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z lower-cased, with one space between them, so
line breaks and punctuation do not matter. Null and empty texts have no words and no labels. Repeated rows get equal
results; a notice found twice gives two spans and one label.
"""

import re
from functools import lru_cache

import ahocorasick
import regex
from pyspark.sql import DataFrame

from tidemark.llm.rows import alnum_words, extend, fields

# Phrases whose words stand consecutively, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Notices as their words, and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license version", "gpl"),
    ("under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under a creative commons attribution", "cc"),
    ("licensed under cc by nc 4 0", "cc"),
    ("licensed under cc by sa 4 0", "cc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
LETTERS_PER_ERROR = 12


class Scanner:
    """Notices as (words, label) pairs; ``errors`` gives the letters that may be wrong in a notice."""

    def __init__(self, notices=NOTICES, errors=lambda words: len(words) // LETTERS_PER_ERROR):
        self.notices = []
        seeds: dict = {}
        for n, (words, label) in enumerate(notices):
            letters, k = words.encode().decode("latin-1"), errors(words)
            at = [len(letters) * i // (k + 1) for i in range(k + 2)]
            for begin, end in zip(at, at[1:]):
                seeds.setdefault(letters[begin:end], []).append((n, begin))
            fuzzy = regex.compile(f"(?:{regex.escape(letters)}){{e<={k}}}", regex.BESTMATCH)
            self.notices.append((letters, label, k, fuzzy))
        self.seeds = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def find(self, letters: str) -> list:
        """(first letter, letter after the last, notice, errors) of each notice found, in order."""
        near: dict = {}
        for last, (size, places) in self.seeds.iter(letters):
            for n, offset in places:
                begin = last + 1 - size - offset
                near.setdefault(n, []).append(begin)
        found = []
        for n, begins in near.items():
            text, _, k, fuzzy = self.notices[n]
            at = 0
            for begin in sorted(set(begins)):
                lo, hi = max(at, begin - k), begin + len(text) + k
                if hi - lo < len(text) - k:
                    continue
                match = fuzzy.search(letters, lo, min(hi, len(letters)))
                if match:
                    found.append((match.start(), match.end(), n, sum(match.fuzzy_counts)))
                    at = match.end()
        return sorted(found)

    def label(self, n: int) -> str:
        return self.notices[n][1]

    def likeness(self, n: int, errors: int) -> float:
        return 1 - errors / len(self.notices[n][0])


_PHRASES = [(re.compile(f"(?<![^ ]){words}(?![^ ])"), words, label) for words, label in PHRASES]


@lru_cache(maxsize=4)
def _scanner(notices):
    return Scanner(notices)


def scan_text(text: bytes | None, scanner: Scanner):
    words = alnum_words(text)
    letters = b" ".join(words).decode("latin-1")
    word_at = lambda at: letters.count(" ", 0, at)
    places, base = [], set()
    for pattern, plain, label in _PHRASES:
        if plain in letters:
            own = [m.start() for m in pattern.finditer(letters)]
            places += own
            base |= {label} if own else set()
    spans = scanner.find(letters)
    labels = base | {scanner.label(n) for _, _, n, _ in spans}
    best = max([1.0 if base else 0.0, *(scanner.likeness(n, errors) for _, _, n, errors in spans)])
    return (len(words), len(places), word_at(min(places)) if places else None,
            word_at(max(places)) if places else None, ",".join(sorted(base)), ",".join(sorted(labels)), best,
            [f"{scanner.label(n)}:{word_at(a)}-{word_at(b - 1)}:{errors}" for a, b, n, errors in spans])


ADDED = fields(n_words="bigint", n_base="bigint", first_word="bigint", last_word="bigint", base_labels="string",
               labels="string", score="double", spans="array<string>")


def scan(docs: DataFrame, text="text", notices=NOTICES, keep=None) -> DataFrame:
    """Adds word and phrase counts, labels, ``score`` (1 for an exact phrase or notice, less for each wrong letter)
    and ``spans`` (``label:first word-last word:wrong letters``); columns so named are replaced."""
    def compute(texts):
        scanner = _scanner(notices)
        return list(zip(*[scan_text(t, scanner) for t in texts]))

    return extend(docs, ADDED, compute, text, keep)

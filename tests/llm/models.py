"""Plain models that the operators are held against, and rows that are hard on them."""

import re
import zlib
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

LONG = " ".join(f"word{i % 997} of{i % 31}" for i in range(20_000))
#: (doc_id, text, score, n_words): the last two columns clash with what operators add.
HARD = [(1, None, 1.5, "a"), (2, "", None, None), (3, "one", 2.0, "b"), (4, " \t\n\x0b\x0c\r ", 0.0, ""),
        (5, LONG, 0.1, "c"), (6, "Tie tie TIE", 0.1, "d"), (6, "Tie tie TIE", 0.1, "d"), (7, "Tie tie TIE", 0.1, "d"),
        (None, "Tie tie TIE", 0.1, "d"), (8, "é 日本 \x1c x y <|im_end|> \U0001f642", 3.0, "e")]


def hard(spark):
    return spark.createDataFrame(HARD, "doc_id bigint, text string, score double, n_words string")


def spaced(text):
    return SPACED.findall((text or "").translate(LOWER))


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def remainder(doc_id, modulus):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def base_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    text = text or ""
    words = SPACED.findall(text)
    seen = Counter(zip(words, words[1:], words[2:]))
    inside = {j for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(inside))


def shingles(text, n):
    words = spaced(text)
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def groups(texts, n, similarity=80):
    """{id: smallest id that links lead to} of {id: text}."""
    sets, parent = {i: shingles(t, n) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where: dict = {}
    for i, own in sets.items():
        for element in own:
            where.setdefault(element, []).append(i)
    for i, own in sets.items():
        shared = Counter(j for element in own for j in where[element] if j < i)
        for j, common in shared.items():
            if 100 * common >= similarity * (len(own) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in texts}


def contamination(text, items, window=13, coverage=20):
    """(n_words, n_hit, ids, contaminated); ``items`` are (id, text) pairs."""
    words, hit, found = alnum(text), set(), set()
    places: dict = {}
    for name, content in items:
        own = alnum(content)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            places.setdefault(size, {}).setdefault(tuple(own[i:i + size]), set()).add(name)
    for size, known in places.items():
        for i in range(len(words) - size + 1):
            names = known.get(tuple(words[i:i + size]))
            if names:
                found |= names
                hit |= set(range(i, i + size))
    return len(words), len(hit), sorted(map(str, found)), bool(hit) and coverage * len(hit) >= len(words)

"""Token alignment, whitening and mixing against plain models, over whole tables and on hard rows."""

import hashlib
import heapq
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tests.llm import models
from tidemark.llm import mixing, token_alignment, whitening

SF = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- alignment ---------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def sides():
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    letters = token_alignment._byte_letters()
    known = {i: bytes(letters.get(c, 63) for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}

    def piece(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if re.fullmatch("<0x..>", name) else name.replace("▁", " ").encode()

    def encode(text):
        if not text:
            return [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        tokens = [(i, known[i]) for i in ids[0]], [(i, piece(i)) for i in ids[1]]
        whole = (" " + text).encode()
        return tokens if all(b"".join(x for _, x in t) == whole for t in tokens) else ([], [])

    return encode


def spans(tokens):
    end = 0
    for i, raw in tokens:
        yield i, end, end + len(raw)
        end += len(raw)


def aligned(sides, text):
    """(A ids, B ids, groups as text, links)"""
    a, b = (list(spans(t)) for t in sides(text))
    cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
    groups, links, i, j = [], Counter(), 0, 0
    for cut in cuts:
        own, other = [x for x in a[i:] if x[2] <= cut], [x for x in b[j:] if x[2] <= cut]
        i, j = i + len(own), j + len(other)
        groups.append(",".join(str(x[0]) for x in own) + "|" + ",".join(str(x[0]) for x in other))
        links.update((x[0], y[0]) for x in own for y in other if x[1] < y[2] and y[1] < x[2])
    return [x[0] for x in a], [x[0] for x in b], groups, links


def expected_links(sides, texts):
    found = [aligned(sides, t) for t in texts]
    counts = Counter(p for _, _, _, links in found for p in links)
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    for a, b, groups, links in found:
        yield (len(a), len(b), len(groups), sum(links.values()), sum(n for p, n in links.items() if counts[p] == most[p[0]]),
               sum(n * counts[p] for p, n in links.items()),
               hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["  two  spaces \n\n\t tab", "<|endoftext|> <s> </s> <unk> <0x41> ▁ under ▁▁", "日本語のテキスト and Ελληνικά й", "\U0001f642\U0001f642 a\x00b\x1f",
       "don't we'll 12345 3.14159 !!!???", "x" * 700, " ", "\n", "é é ﬁ", "ꟁᲉ newer letters", "a" + " " * 900 + "b"]


def test_alignment_of_the_table(spark, sides):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60)
    texts = rows.collect()
    found = token_alignment.link_counts(rows, *PATHS, keep=["doc_id"]).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in found] == list(expected_links(sides, [r.text for r in texts]))


@pytest.mark.parametrize("max_pairs", [0, 40, 10**6])
def test_alignment_hard_rows(spark, sides, max_pairs):
    """The same, whether counts are broadcast, joined, or both."""
    rows = [(i, t, "kept", 0.5) for i, t in enumerate([*ODD, None, "", *ODD[:3], models.LONG[:3000]])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_a string, `x.y` double")
    found = token_alignment.link_counts(docs, *PATHS, max_pairs=max_pairs)
    assert found.columns == ["doc_id", "text", "x.y", *COLUMNS]
    got = [tuple(r[c] for c in COLUMNS) for r in found.orderBy("doc_id").collect()]
    assert got == list(expected_links(sides, [r[1] for r in rows]))


def test_alignment_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two")], "doc_id bigint, text string")
    found = token_alignment.link_counts(docs, *PATHS).collect()
    assert len(found) == 3 and {(r.n_a, r.count_sum) for r in found} == {(2, 6)}
    assert token_alignment.link_counts(docs.limit(0), *PATHS).collect() == []


def test_alignment_spans(spark, sides):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "doc_id bigint, text string")
    for row in token_alignment.align(docs, *PATHS).orderBy("doc_id").collect():
        a, b, groups, _ = aligned(sides, row.text)
        assert (row.a_ids, row.b_ids) == (a, b)
        got = [",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2]))
               for i, i2, j, j2 in zip([0, *row.a_until], row.a_until, [0, *row.b_until], row.b_until)]
        assert got == groups and (not got or row.byte_until[-1] == len(row.text.encode()) + 1)


def test_long_texts_are_encoded_in_parts():
    with open(PATHS[0], encoding="utf-8") as a, open(PATHS[1], "rb") as b:
        aligner = token_alignment.Aligner(a.read(), b.read())
    text = " ".join(random.Random(4).choices([*models.LONG.split()[:50], "é", "  ", "\n x", "日本", "don't"], k=3000))
    parts = token_alignment.segments(text, 200)
    assert len(parts) > 20 and " ".join(parts) == text
    for side in (aligner.a, aligner.b):
        assert sum(side.encode(parts), []) == side.encode([text])[0]


def test_groups_without_inner_cuts():
    """Long stretches without a shared cut, beside many cuts."""
    rnd = random.Random(5)
    for _ in range(200):
        n = rnd.randrange(1, 400)
        a, b = (np.array(sorted({*rnd.sample(range(1, n + 1), rnd.randrange(1, n + 1)), n})) for _ in "ab")
        if rnd.random() < .5:
            b = np.array([x for x in b.tolist() if x == n or x % 7 == 0 or x > n // 2])
        lo, hi, blo, bhi = token_alignment.split_at_cuts(a, b, [np.array([x]) for x in (0, len(a), 0, len(b))])
        assert a[hi - 1].tolist() == sorted(set(a.tolist()) & set(b.tolist())) == b[bhi - 1].tolist()
        assert lo[1:].tolist() == hi[:-1].tolist() and blo[1:].tolist() == bhi[:-1].tolist()


# --- whitening ---------------------------------------------------------------------------------------------

def test_whitening_of_the_table(spark):
    found = entry.queries()["op12_whitening"](spark, SF).toPandas().sort_values(["vec_id", "component"])
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(1024 * np.array(rows.embedding.tolist(), float)) + 100_000
    n, total = len(x), x.sum(0)
    values, vectors = np.linalg.eigh((x - total / n).T @ (x - total / n) / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    expected, got = (x - total / n) @ vectors / np.sqrt(values), found.whitened.to_numpy().reshape(n, 8)
    signs = np.sign((expected * got).sum(0))
    assert np.abs(got - expected * signs).max() < 1e-9
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, total)) for row in x]
    assert found.deviation.tolist() == [d for d in exact for _ in range(8)] and set(found.n) == {n}
    assert np.allclose(found.explained[:8], values / np.trace((x - total / n).T @ (x - total / n) / n), rtol=1e-9)
    assert found.identity_error.nunique() == 1 and 0 <= found.identity_error.iloc[0] < 1e-9 and found.certified.all()


def spread(values, seed=3):
    n = len(values)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))[0]
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("values", [
    [5.0], [3, 2, 1], [1] * 12, [4, 4, 4, 1, 1, 1, 0, 0, 0], [1, 1 - 1e-12, 1 - 1e-7, 0.5, *[0.1] * 20], list(10.0 ** -np.arange(30)),
    list(np.linspace(1, 2, 64)), [0.0] * 4])
def test_leading_eigenvalues(values):
    matrix = spread(values) if len(values) > 1 else np.diag(values)
    found = whitening.leading(matrix)
    best = sorted(values, reverse=True)[:8]
    assert len(found.values) == sum(v > 1e-12 * max(values) for v in best) and found.certified
    assert np.allclose(found.values, best[:len(found.values)], rtol=0, atol=1e-13 * max(values))
    assert np.allclose(found.vectors @ found.vectors.T, np.eye(len(found.values)), atol=1e-13)
    assert np.allclose(matrix @ found.vectors.T, found.vectors.T * found.values, atol=1e-13 * max(values))


def test_inertia_and_factor():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 8, 33):
        for kind in range(3):
            a = rng.standard_normal((n, n))
            a = {0: a + a.T, 1: a @ a.T, 2: np.zeros((n, n)) + np.eye(n)[::-1]}[kind]
            order, lower, blocks = whitening.factor(a)
            d = np.zeros((n, n))
            for k, block in blocks:
                d[k:k + len(block), k:k + len(block)] = block
            assert np.allclose(lower @ d @ lower.T, a[order][:, order], atol=1e-11 * n)
            for shift in (-1.5, 0.3, 2.0):
                assert whitening.above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()


def test_whitening_hard_rows(spark):
    rows = [(1, None, "x", 1.), (2, [], "y", None), (3, [1., None], "z", 1.), (4, [float("nan"), 2.], "z", 1.), (5, [1., 2.], "a", 2.),
            (6, [3., 5.], "a", 2.), (6, [3., 5.], "a", 2.), (None, [4., 1.], "a", 2.), (7, [1., 2., 3.], "q", 1.),
            (8, [float("inf"), 1.], "", 0.), (9, [1e300, 1.], "", 0.)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, component string, `n.n` double")
    found = whitening.whiten(table)
    assert found.columns == ["vec_id", "embedding", "n.n", *whitening.ADDED.names]
    got = found.collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (5, 1), (5, 2), (6, 1), (6, 1), (6, 2), (6, 2)]
    assert {r.n for r in got} == {4} and max(r.identity_error for r in got) < 1e-12
    for part in ("vec_id < 3", "vec_id = 5", "vec_id = 6", "vec_id < 0"):  # nothing varies, or nothing is there
        assert whitening.whiten(table.where(part)).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], "vec_id bigint, embedding array<float>")
    assert {r.component for r in whitening.whiten(line).collect()} == {1}  # of rank one


def test_deviations_are_exact_or_null():
    model = whitening.Whitener(3 * 10**6, (7, -5 * 10**12 + 1), np.ones(0), np.ones((0, 2)), 1.0, True)
    x = np.array([[3, -(10**6)], [2, 10**7], [10**3, 10**9]])
    exact = [sum((model.n * int(v) - s) ** 2 for v, s in zip(row, model.sums)) for row in x]
    assert model.deviations(x) == [d if d < 2**63 else None for d in exact] and None in model.deviations(x)


# --- mixing ------------------------------------------------------------------------------------------------

def highest_quotients(targets, bounds, block, house):
    """Blocks of each place, allocated one by one."""
    won = [0] * len(targets)
    heap = [(0.5 / (t / block), i) for i, t in enumerate(targets) if t > 0 and bounds[i]]
    heapq.heapify(heap)
    for _ in range(house):
        _, i = heapq.heappop(heap)
        won[i] += 1
        if won[i] < bounds[i]:
            heapq.heappush(heap, ((won[i] + 0.5) / (targets[i] / block), i))
    return won


def plain_targets(sizes, weights=(5, 2, 1), repeats=3):
    weights, full = [weights[i % len(weights)] for i in range(len(sizes))], set()
    while True:
        left = [i for i in range(len(sizes)) if i not in full]
        each = (sum(sizes) - sum(repeats * sizes[i] for i in full)) / sum(weights[i] for i in left)
        over = {i for i in left if weights[i] * each > repeats * sizes[i]}
        if not over:
            return [float(repeats * s) if i in full else weights[i] * each for i, s in enumerate(sizes)]
        full |= over


@pytest.mark.parametrize("few", [10_000, 3])
def test_quotas(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW", few)
    rnd = random.Random(7)
    for sizes in ([100, 100, 100, 100], [5, 100_000, 40, 0, 7], [rnd.randrange(1, 10**6) for _ in range(30)], [1], [3] * 25, [0, 0]):
        rows = spark.createDataFrame([(f"s{i:03}", s) for i, s in enumerate(sizes)], "source string, size bigint")
        sources = mixing.targets(rows)
        found = sorted(sources.collect(), key=lambda r: r.place)
        assert [r.target for r in found] == pytest.approx(plain_targets(sizes), rel=1e-12)
        block = mixing.block_size(sources)
        until = [r.until for r in sorted(mixing.quotas(sources, block, shards=5).collect(), key=lambda r: r.place)]
        bounds = [3 * s // block for s in sizes]
        whole = (2 * sum(sizes) + block) // (2 * block)
        for h in range(5):
            assert [u[h] for u in until] == highest_quotients([r.target for r in found], bounds, block, whole * (h + 1) // 5)
        for r, u in zip(found, until):
            assert abs(u[-1] * block - r.target) <= max(2 * block, 0.01 * r.target) and u[-1] * block <= 3 * r.source_size


def test_mix_hard_rows(spark):
    table = models.hard(spark).withColumns({"source": F.when(F.col("doc_id") % 2 == 0, "é").when(F.col("doc_id") == 3, "z"),
                                            "spans": F.lit(1), "a.b": F.lit(2)})
    rows = table.select("doc_id", "source", "spans", "`a.b`", "text", *mixing.measures())
    found = mixing.mix(rows, shards=4).collect()
    sizes = {i: Counter() for i in ("é", "z", None)}
    for r in rows.collect():
        sizes[r.source][len(models.SPACED.findall(r.text or ""))] += 1
    assert Counter((r.source, r["size"]) for r in found) == Counter({(s, n): k for s, c in sizes.items() for n, k in c.items()})
    for source, place in (("z", 1), ("é", 0), (None, 2)):
        own = [r for r in found if r.source == source]
        assert all(0 <= r.taken <= 3 * r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(2, 0.02 * own[0].target)
    assert found[0]["a.b"] == 2 and len(found) == len(models.HARD)
    assert mixing.mix(rows.limit(0)).collect() == []
    assert {(r.taken, r.target) for r in mixing.mix(rows.where("size = 0")).collect()} == {(0, 0.0)}
    again = mixing.mix(rows.repartition(5), shards=4).collect()
    assert Counter(map(str, again)) == Counter(map(str, found))


def test_mixed_shards(spark):
    """Every shard holds the mixture, spans fill each source's part of a shard without gaps, and texts follow them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mix(docs.select("doc_id", "source", *mixing.measures()), shards=6).cache()
    found, texts = mixed.collect(), {r.doc_id: r.text for r in docs.collect()}
    parts, of = defaultdict(list), {}
    for r in found:
        of[r.source] = r.target
        for s in r.spans:
            parts[s.shard, r.source].append((s["at"], s["until"] - s["first"]))
            assert 0 <= s["first"] < s["until"] <= r["size"]
    total = sum(of.values())
    for h in range(6):
        held = {s: sum(n for _, n in parts[h, s]) for s in of}
        for s, n in held.items():
            assert abs(n - of[s] * sum(held.values()) / total) <= 2 * 16
            assert [a for a, _ in sorted(parts[h, s])] == [sum(n for _, n in sorted(parts[h, s])[:i]) for i in range(len(parts[h, s]))]
    spans = {(r.doc_id, s.shard, s["at"]): (s["first"], s["until"]) for r in found for s in r.spans}
    for r in mixing.span_texts(docs, mixed).collect():
        begin, end = spans[r.doc_id, r.shard, r["at"]]
        assert r.words == " ".join(models.SPACED.findall(texts[r.doc_id])[begin:end])

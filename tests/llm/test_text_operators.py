"""Operators on single texts against plain models, over whole tables and on hard rows."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tests.llm import models
from tidemark.llm import bpe, decontaminate, license_scan, lm_score, quality_classifier, quality_rules, rows
from tidemark.llm.rows import extend, fields

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def run(spark, name):
    return entry.queries()[name](spark, SF).toPandas()


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


@pytest.fixture(scope="module")
def good(spark):
    rows = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()
    return {r.doc_id for r in rows}


def test_quality_rules(spark, texts, good):
    found = run(spark, "op1_quality_rules").set_index("doc_id")
    assert set(found.index) == set(texts)

    def grams(text):
        words = models.SPACED.findall(text or "")
        h = lambda w, seed: xxhash.xxh64_intdigest(w.encode(), seed)
        signed = lambda x: x - 2**64 if x >= 2**63 else x
        return [signed(h(w, 42)) % quality_rules.BUCKETS for w in words] + [
            signed(h(b, h(a, 42))) % quality_rules.BUCKETS for a, b in zip(words, words[1:])]

    raw, target = Counter(), Counter()
    for i, text in texts.items():
        raw.update(grams(text))
        target.update(grams(text) if i in good else [])
    raws, targets, n = sum(raw.values()), sum(target.values()), quality_rules.BUCKETS
    own = sorted(math.floor(found.loc[i].log_ratio / quality_rules.STEP) for i in texts if i in good and not found.loc[i].base_failed)
    least = quality_rules.STEP * (2 * own[math.ceil(len(own) / 100) - 1] - own[math.ceil(len(own) / 2) - 1])
    for i, text in texts.items():
        row, base = found.loc[i], models.base_counts(text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == base
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        ratio = np.mean([math.log((target[g] + 1) / (targets + n) * (raws + n) / (raw[g] + 1)) for g in grams(text)])
        assert abs(row.log_ratio - ratio) < 1e-6
        assert row.base_failed == failed and row.kept == (not failed and row.log_ratio >= least)


def test_quality_rules_on_hard_rows(spark):
    docs = models.hard(spark).withColumn("kept", F.lit("x"))
    ratio = quality_rules.ratios(docs, docs.select("doc_id"))
    rows = quality_rules.judge(docs, ratio).collect()
    assert len(rows) == len(models.HARD) and all(isinstance(r.kept, bool) for r in rows)
    for row in rows:
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == models.base_counts(row.text)
    assert quality_rules.judge(docs.where("false"), ratio).count() == 0
    nothing = quality_rules.ratios(docs, docs.select("doc_id").where("false"))
    assert {r.log_ratio for r in quality_rules.judge(docs, nothing).collect()} == {0.0}
    assert quality_rules.judge(docs, ratio).where("log_ratio > 100").count() == 0  # a filter that could be pushed down


@pytest.mark.parametrize("short", [False, True])
def test_windows_that_interleave(spark, monkeypatch, short):
    if short:  # hashes of one bit: everything rests on the words
        monkeypatch.setattr(quality_rules, "hashed", lambda *w: F.xxhash64(*w).bitwiseAND(F.lit(1).cast("long")))
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("ab c d".split()) for _ in range(rnd.randint(0, 60)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for row in quality_rules.judge(docs, [0] * 8).collect():
        assert row.n_repeat_words == models.base_counts(row.text)[4]


def test_threshold_without_trusted_texts(spark):
    docs = models.hard(spark)
    assert quality_rules.threshold(docs, docs.select("doc_id").where("false"), [0] * 8) == 0.0


def test_names_with_dots(spark):
    docs = models.hard(spark).withColumn("x.y", F.lit("kept"))
    items = spark.createDataFrame([("i", "tie tie tie")], "item_id string, text string")
    rows = decontaminate.find(docs, items).collect()
    assert {r["x.y"] for r in rows} == {"kept"} and sum(r.contaminated for r in rows) == 4
    assert "x.y" in decontaminate.clean(docs, items).columns


def test_classifier(spark, texts):
    found = run(spark, "op2_quality_classifier")
    assert sorted(found.doc_id) == sorted(texts) and found.score.between(0, 1).all()
    assert (found.predicted == (found.score >= 0.5)).all()
    assert (found.held_out == [models.remainder(i, 3) == 1 for i in found.doc_id]).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(found[found.held_out], on="doc_id")
    assert (labels.predicted == labels.quality).mean() > 0.9


def test_classifier_learns_from_positives_alone():
    rnd = np.random.default_rng(1)
    good, bad = rnd.normal(1, 1, (3000, 5)), rnd.normal(-1.5, 1, (1000, 5))
    web = np.vstack([good[2000:], bad])
    model = quality_classifier.fit(good[:2000], web)
    assert abs(model[3] - 0.5) < 0.1
    assert (quality_classifier.score(good[2000:], model) >= 0.5).mean() > 0.95
    assert (quality_classifier.score(bad, model) < 0.5).mean() > 0.95


def test_classifier_on_hard_rows(spark):
    docs = models.hard(spark)
    model = quality_classifier.train(docs, docs.select("doc_id"))
    rows = quality_classifier.classify(docs, model).collect()
    assert len(rows) == len(models.HARD) and rows[0].n_words == "a"
    assert len({r.score for r in rows if r.text == "Tie tie TIE"}) == 1
    assert quality_classifier.train(docs, docs.select("doc_id").where("false")) is None
    assert {r.score for r in quality_classifier.classify(docs, None).collect()} == {0.5}
    assert quality_classifier.train(docs.where("false"), docs.select("doc_id")) is None


def test_licenses(spark, texts):
    found = run(spark, "op5_license_scan").set_index("doc_id")
    assert set(found.index) == set(texts)
    for i, text in texts.items():
        words = models.alnum(text)
        places, base = [], set()
        for phrase, label in license_scan.PHRASES:
            own = phrase.split()
            at = [k for k in range(len(words)) if words[k:k + len(own)] == own]
            places, base = places + at, base | ({label} if at else set())
        row = found.loc[i]
        assert (row.n_words, row.n_base, row.base_labels) == (len(words), len(places), ",".join(sorted(base)))
        assert set(row.base_labels.split(",")) - {""} <= set(row.labels.split(","))
        if places:
            assert (row.first_word, row.last_word) == (min(places), max(places))


def test_fuzzy_notices():
    scanner = license_scan.Scanner()
    scan = lambda text: license_scan.scan_text(text.encode(), scanner)
    exact = scan("x. Released under\nthe MIT License.")
    assert exact[1] == 1 and exact[5] == "mit" and exact[6] == 1.0 and exact[7] == ["mit:1-5:0"]
    wrong = scan("x. Reléased undr the MTI Lisense.")
    assert scan("Released undr the MIT Licence")[4:6] == ("", "mit")
    assert wrong[4] == "" and wrong[5] in ("", "mit")
    assert scan("the license was released under the sun")[5] == ""
    assert license_scan.scan_text(None, scanner)[:6] == (0, 0, None, None, "", "")


def test_seeds_lose_no_notice():
    """Every text within the bound is found: one, two, ... letters are changed, dropped or added at random."""
    rnd, notices = random.Random(6), license_scan.NOTICES
    scanner = license_scan.Scanner()
    for words, label in notices:
        k = len(words) // license_scan.LETTERS_PER_ERROR
        for _ in range(60):
            letters = list(words)
            for _ in range(k):
                at = rnd.randrange(len(letters))
                letters[at:at + 1] = rnd.choice([[], ["q"], [letters[at], "z"]])
            found = scanner.find("aa bb " + "".join(letters) + " cc")
            assert any(scanner.label(n) == label for _, _, n, _ in found), "".join(letters)


def test_license_hard_rows(spark):
    rows = license_scan.scan(models.hard(spark)).collect()
    assert len(rows) == len(models.HARD) and rows[0].n_words == 0 and rows[0].labels == ""
    assert license_scan.scan(models.hard(spark).where("false")).count() == 0


def test_contamination(spark, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = run(spark, "op6_decontaminate").set_index("doc_id")
    assert set(found.index) == set(texts) and found.n_hit.sum() > 0
    for i, text in texts.items():
        words, hit, ids, contaminated = models.contamination(text, items)
        row = found.loc[i]
        assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (words, hit, len(ids), contaminated)
        assert row.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()


def test_automaton_against_all_windows():
    rnd = random.Random(3)
    for case in range(600):
        window, letters = rnd.choice([2, 3, 4]), "ab" if case % 2 else "abcd"
        items = [(str(k), "".join(rnd.choice(letters + " ") for _ in range(rnd.randint(0, 12)))) for k in range(4)]
        text = " ".join(rnd.choice(letters + "x") for _ in range(25))
        scanner = decontaminate.Automaton([(n, [w.encode() for w in models.alnum(t)]) for n, t in items], window)
        spans, found, _ = scanner.scan([w.encode() for w in models.alnum(text)])
        _, hit, ids, _ = models.contamination(text, items, window)
        assert sum(b - a for a, b in spans) == hit and sorted(found) == ids


def test_blocks_and_passes_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    names = ["doc_id", "n_words", "n_hit", "item_ids", "longest_match", "contaminated"]
    once = sorted(decontaminate.find(docs, items).select(names).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 300)
    assert sorted(decontaminate.find(docs, items).select(names).collect()) == once
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 4000)
    again = decontaminate.find(docs, items, keep=["doc_id"])
    assert again.columns[0] == "doc_id" and "text" not in again.columns
    assert sorted(again.select(names).collect()) == once


def test_cleaned_texts(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, "short one"), (None, ""), (3, None)],
                                  "item_id bigint, text string")
    long = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame(
        [(1, "A, b c d e f g h i j k l m n!", 0, "k"), (2, f"{long} SHORT. one {long}", 7, "k"), (3, "fine", 4, "k"),
         (4, None, None, "k"), (5, "", 0, "k"), (3, "fine", 4, "k")], "doc_id bigint, text string, n_chars bigint, n_hit string")
    rows = decontaminate.clean(docs, items)
    assert rows.columns == docs.columns
    kept = {(r.doc_id, r.text, r.n_chars, r.n_hit) for r in rows.collect()}
    cut = f"{long}  {long}"
    assert kept == {(2, cut, len(cut), "k"), (3, "fine", 4, "k"), (4, None, None, "k"), (5, "", 0, "k")}
    assert rows.count() == 5
    assert decontaminate.clean(docs, items.where("false")).count() == docs.count()
    assert decontaminate.clean(docs.where("false"), items).count() == 0


def test_cleaned_in_several_passes(spark, monkeypatch):
    """Spans are cut also where an earlier pass than the last one hits."""
    items = spark.createDataFrame([(f"i{n}", " ".join(f"t{n}x{k}" for k in range(15))) for n in range(40)], "item_id string, text string")
    rest = " ".join(f"w{i}" for i in range(600))
    docs = spark.createDataFrame([(n, f"{rest} " + " ".join(f"t{n}x{k}" for k in range(15)) + f" . T{39 - n}x0 end", "odd", n)
                                  for n in range(40)], "`x.y` bigint, text string, __clean string, n_hit bigint")
    once = sorted(map(tuple, decontaminate.clean(docs, items).collect()))
    assert [r[1] for r in once] == [f"{rest}  . T{39 - n}x0 end" for n in range(40)]
    assert [(r[0], r[2], r[3]) for r in once] == [(n, "odd", n) for n in range(40)]
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 60)
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 3000)
    assert sorted(map(tuple, decontaminate.clean(docs, items).collect())) == once


def test_kept_text_goes_along_once(spark):
    docs = spark.createDataFrame([(1, "é A", b"\xff", 2), (2, None, None, 3), (3, "", b"", None)],
                                 "doc_id bigint, text string, raw binary, size bigint")
    for text in ("text", "raw"):
        out = extend(docs, fields(size="bigint"), lambda found, ids: [[len(t or b"") + i for t, i in zip(found, ids)]], text, more=["doc_id"])
        assert out.columns == ["doc_id", "text", "raw", "size"] and out.schema["text"].dataType == docs.schema["text"].dataType
        assert [tuple(r)[:3] for r in sorted(out.collect())] == [tuple(r)[:3] for r in docs.collect()]
        assert sorted(r["size"] for r in out.collect()) == ([2, 3, 5] if text == "text" else [2, 2, 3])


def test_bpe(spark, texts):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    found = run(spark, "op9_bpe").set_index("doc_id")
    assert set(found.index) == set(texts)
    for i, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        row = found.loc[i]
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_on_any_text(name):
    with open(public_tokenizers.path(name)) as file:
        coder = bpe.Coder(file.read())
    rnd = random.Random(1)
    letters = "abcXYZ  \n\t'’sS019éÉñßΣσςİıà́̀ 　\x85\x1c\x0b日本語한국🙂‍<|>!?#$-_.,;:"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(chr(rnd.choice([rnd.randint(0, 0x2ff), rnd.randint(0x300, 0xd7ff), rnd.randint(0xe000, 0x1ffff)]))
                      for _ in range(12)) for _ in range(500)]
    texts += ["a<|endoftext|>b <|startoftext|>", "x" * 300, ""]
    for text, (ids, decoded) in zip(texts, coder.encode([t.encode() for t in texts])):
        expected = coder._whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, text
        assert decoded.decode() == coder._whole.decode(expected, skip_special_tokens=False)


def test_bpe_memory_and_hard_rows(spark, monkeypatch):
    rows = bpe.encode(models.hard(spark), TOKENIZER).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    assert len(rows) == len(models.HARD) and rows[0].score == 1.5
    for row in rows:
        assert row.token_ids == tokenizer.encode(row.text or "", add_special_tokens=False).ids
    assert bpe.digests(models.hard(spark).where("false"), TOKENIZER).count() == 0
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 3)
    with open(TOKENIZER) as file:
        coder = bpe.Coder(file.read())
    for text in ("a b c d", "e f a b c", "a a e"):
        (ids, _), = coder.encode([text.encode()])
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe_words_that_come_again(monkeypatch):
    """Words beyond the memory of one generation are learnt again only when they are missing from the last one, too."""
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 8)
    with open(TOKENIZER) as file:
        coder = bpe.Coder(file.read())
    learnt, learn = [], coder._learn
    coder._learn = lambda words: learnt.extend(words) or learn(words)
    for text in (b"a b c d", b"e f g", b"h i", b"a b c d"):
        list(coder.encode([text]))
    assert sorted(learnt) == [bytes([c]) for c in b"abcdefghi"]
    assert len(coder._of_word) + len(coder._older) <= 16


def test_bpe_memory_of_a_worker_is_bounded():
    """Fewer words in memory give the same ids, and another operator's task empties it."""
    with open(TOKENIZER) as file:
        spec = file.read()
    given = [" ".join(f"w{i}" for i in range(at, at + 400)).encode() for at in range(0, 4000, 300)]
    assert bpe._coded(spec, 500, given) == bpe._coded(spec, 10**6, given)
    small = bpe._coder(spec, 500)
    for text in given:
        list(small.encode([text]))
        assert len(small._of_word) <= 500 and len(small._older) <= 900
    bpe._coder.cache_clear()
    bpe._coded(spec, 500, given)
    rows.forget_others(bpe.__name__)
    assert bpe._coder.cache_info().currsize == 1
    rows.forget_others(decontaminate.__name__)
    assert bpe._coder.cache_info().currsize == 0


def language_model(texts):
    counts = Counter()
    for i, text in texts:
        if models.remainder(i, 7) not in (2, None):
            counts.update([*models.spaced(text), " end"])
    return counts, sum(counts.values()), len(counts)


def test_language_model(spark, texts):
    found = run(spark, "op10_lm_score").set_index("doc_id")
    counts, total, distinct = language_model(texts.items())
    for i, text in texts.items():
        tokens, row = [*models.spaced(text), " end"], found.loc[i]
        assert (row.n_tokens, row.train_tokens, row.held_out) == (len(tokens), total, models.remainder(i, 7) == 2)
        assert row.n_known == sum(counts[t] > 0 for t in tokens)
        assert math.isclose(row.base_score, sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens))
        assert row.score <= 0
    held = found[found.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_joined_counts_give_the_same(spark):
    docs = models.hard(spark).where("doc_id IS NULL OR doc_id <> 5")
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score", "train_tokens"]
    once, joined = (sorted(lm_score.score(docs, docs, max_words=n).select(names).collect(), key=str) for n in (10**6, 0))
    assert len(once) == len(joined) == docs.count()
    for a, b in zip(once, joined):
        assert a[:3] == b[:3] and all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(a[3:], b[3:]))
    assert {r.score for r in lm_score.score(docs, docs.where("false")).collect()} == {0.0}
    assert lm_score.score(docs.where("false"), docs).count() == 0


def test_filter_is_never_too_low():
    rnd = random.Random(2)
    rows = [(k, rnd.getrandbits(39), rnd.randint(1, 12)) for k in (1, 2, 3) for _ in range(700)]
    kind, gram, level = (np.array(c, t) for c, t in zip(zip(*rows), (np.int64, np.uint64, np.int64)))
    bits = lm_score.fill(kind.astype(np.uint64), gram, level)
    found = lm_score.Filter(bits)
    over = 0
    for kind, gram, level in rows:
        got = found.level(kind, np.array([gram], np.uint64))[0]
        assert got >= level
        over += got > level
    assert over < 0.06 * len(rows) and len(bits) <= lm_score.MAX_BYTES >> 10
    foreign = np.random.default_rng(3).integers(2**40, 2**63, 400_000).astype(np.uint64)
    assert (found.level(lm_score.PAIR, foreign) > 0).mean() < 2e-4


def test_chances_add_up(spark, texts):
    """The chances of all words after one context, whatever its count, add up to 1 but for the steps of quantised counts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bits = lm_score.place_bits(docs)
    made = lm_score.gather(docs, bits)
    found, (gram, n) = lm_score.Filter(*lm_score._whole(made, bits)), lm_score._exact(made)
    gram, n = np.frombuffer(gram, np.uint64), np.frombuffer(n, np.int64)
    level = found.level(lm_score.WORD, gram)
    uses, mass = lm_score._count_of(level), n.sum() + len(n) + 1
    for least in (8, 35, 163, 651, 5000):
        for at in np.argsort(np.abs(n - least))[:3]:
            met = np.minimum(found.level(lm_score.PAIR, lm_score._pair(np.full(len(gram), gram[at]), gram)), np.minimum(level, level[at]))
            paired = np.minimum((1 - lm_score.DISCOUNT) * lm_score._count_of(met) / uses[at], 1 - lm_score.DISCOUNT)
            chances = (paired + lm_score.DISCOUNT * (uses + 1) / mass).sum()
            assert 0.5 < chances <= 1.25, (n[at], chances)


def test_scores_do_not_depend_on_the_place_of_the_filter(spark):
    """A filter that is not broadcast holds all levels and gives the scores of one that is."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(
        models.hard(spark).select("doc_id", "text")).repartition(3)
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score", "train_tokens"]
    scored = lambda **limits: sorted(lm_score.score(docs, docs, keep=["doc_id"], **limits).select(names).collect(), key=str)
    once = scored()
    for other in (scored(max_bytes=65536), scored(max_bytes=0, max_words=0)):
        assert len(once) == len(other) == docs.count()
        for a, b in zip(once, other):
            assert a[:3] == b[:3] and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[3:], b[3:]))
    assert lm_score.score(docs.where("false"), docs, max_bytes=0).count() == 0


def test_counts_and_questions_in_one_shuffle(spark, monkeypatch):
    """A condition on the rows gives what a frame of the training texts gives, n-grams pass one shuffle, and runs over several parts fit."""
    monkeypatch.setattr(lm_score, "LOOKED_BYTES", 1 << 20)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(
        models.hard(spark).select("doc_id", "text")).repartition(3)
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    names, written = ["doc_id", "n_tokens", "n_known", "base_score", "score", "train_tokens"], []
    plain = lm_score.materialize
    monkeypatch.setattr(lm_score, "materialize", lambda df, label: written.append(label) or plain(df, label))
    of = lambda training, **limits: sorted(lm_score.score(docs, training, keep=["doc_id"], **limits).select(names).collect(), key=str)
    once = of(docs.where(learn))
    del written[:]
    for training in (learn, docs.where(learn)):
        for a, b in zip(once, of(training, max_bytes=65536), strict=True):
            assert a[:3] == b[:3] and a[5] == b[5] and math.isclose(a[3], b[3], rel_tol=1e-9, abs_tol=1e-9)
            assert math.isclose(a[4], b[4], rel_tol=1e-9, abs_tol=1e-9)
    assert written == ["lm-texts", "lm-levels"] * 2


def test_pairs_met_once_count(spark):
    """Against the formula; medians, since a single probe may err."""
    training = [(i, f"a{i} b{i} c{i}") for i in range(40)]
    held = [(i, f"a{i} b{i} c{i}" if i % 2 else f"c{i} b{i} a{i}") for i in range(40)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.score for r in lm_score.score(frame(held), frame(training)).collect()}
    ends = 1.5 ** 9 * 1.25  # what the level of 40 stands for
    word, end = 0.3 * 2 / (160 + 121 + 1), 0.3 * (ends + 1) / (160 + 121 + 1)
    seen = [0.7 / ends + word, 0.7 + word, 0.7 + word, 0.7 + end]
    for rest, chances in ((1, seen), (0, [word, word, word, end])):
        middle = np.median([found[i] for i in range(40) if i % 2 == rest])
        assert math.isclose(middle, sum(map(math.log10, chances)), abs_tol=1e-9)


def test_pairs_are_told_by_all_bits():
    """Words that share the upper 24 bits, and contexts that share the lower 40, make pairs of their own."""
    words, one = np.arange(1000, dtype=np.uint64), np.full(1000, 7, np.uint64)
    made = [lm_score._pair(one, words), lm_score._pair(words << np.uint64(40), one), lm_score._pair(words + np.uint64(10**6), one)]
    assert len(np.unique(np.concatenate(made))) == 3000

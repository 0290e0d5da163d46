"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Every word and every pair of neighbouring words falls by a hash into one of ``BUCKETS`` buckets. The texts of the
trusted target and all texts of the corpus each give a multinomial over the buckets (add-one smoothing); both count
whole tables. The score of a text is the mean over its n-grams of ``ln(target / raw)``, so length does not matter,
and a text is kept if no base rule fails and its score reaches a threshold taken from the trusted texts' own scores. Ratios are rounded to millionths
and summed as integers, so the verdict does not depend on the order of addition.

Only DataFrame functions are used. Words are ``[^\\x20\\x09-\\x0D]+``, their case counts. Null and empty texts have
no words and fail the base rules; their ratio is 0. Without a trusted target all ratios are 0. Repeated rows count
once each in the corpus and get equal verdicts. Equal 3-word windows of a text are brought together by hashes and told by
their words.
"""

import json
from math import log

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.rows import join_small, others

BUCKETS = 10_000
STEP = 0.0001  # of ratios, when the threshold is taken
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words in repeated windows

_SPACE = "[\\x20\\x09-\\x0D]+"
_MICRO = 1_000_000


def _words(text):
    return F.array_remove(F.split(text, _SPACE), "")


def _buckets(buckets: int):
    """Buckets of the words and of the neighbouring pairs in ``__w``."""
    one = F.transform("__w", lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    pairs = F.when(F.size("__w") > 1, F.transform(
        F.sequence(F.lit(0), F.size("__w") - 2),
        lambda i: F.pmod(F.xxhash64(F.get("__w", i), F.get("__w", i + 1)), F.lit(buckets)).cast("int")))
    return F.concat(one, F.coalesce(pairs, F.array().cast("array<int>")))


def ratios(docs: DataFrame, trusted: DataFrame, text="text", key="doc_id", buckets=BUCKETS) -> list:
    """Millionths of ``ln(target / raw)`` per bucket: at most ``buckets`` counts reach the driver.

    ``trusted`` holds the ids, in column ``key``, of the documents that are the target.
    """
    ids = trusted.select(F.col(key).alias("id")).where("id IS NOT NULL").distinct().withColumn("good", F.lit(1))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    marked = join_small(rows, ids, "id", "left").select(F.coalesce("good", F.lit(0)).alias("good"),
                                                        _words(F.col("text")).alias("__w"))
    grams = marked.select("good", F.explode(_buckets(buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target"))
    return _ratios([(r.bucket, r.raw, r.target) for r in counts.collect()], buckets)


def _ratios(counts, buckets):
    raws, targets = sum(c[1] for c in counts), sum(c[2] for c in counts)
    if not targets:
        return [0] * buckets
    made = [round(_MICRO * log((raws + buckets) / (targets + buckets)))] * buckets
    for bucket, raw, target in counts:
        made[bucket] = round(_MICRO * log((target + 1) * (raws + buckets) / ((raw + 1) * (targets + buckets))))
    return made


def hashed(*words):
    return F.xxhash64(*words)


def _repeated():
    """Words in 3-word windows that the text holds more than once, from the sorted starts in ``__r``."""
    steps = F.transform("__r", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("__r", k + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ratio", "kept"]


def threshold(docs: DataFrame, trusted: DataFrame, ratio: list, text="text", key="doc_id") -> float:
    """The lowest ratio that is kept, from the trusted documents that pass the base rules: as far below their lowest per cent as
    that is below their median. All of them count, in steps of ``STEP``, so no more than the steps in use reach the driver; 0
    without any."""
    ids = trusted.select(F.col(key).alias("id")).where("id IS NOT NULL").distinct()
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("__text"))
    judged = judge(join_small(rows, ids, "id", "left_semi"), ratio, "__text", ["id"], 0.0).where("NOT base_failed")
    steps = judged.groupBy(F.floor(F.col("log_ratio") / STEP).alias("at")).agg(F.count("*").alias("n")).collect()
    total, upto, low = sum(r.n for r in steps), 0, None
    for r in sorted(steps):
        upto += r.n
        if low is None and 100 * upto >= total:
            low = r.at
        if 2 * upto >= total:
            return STEP * (2 * low - r.at)
    return 0.0


def judge(docs: DataFrame, ratio: list, text="text", keep=None, threshold=0.0) -> DataFrame:
    """Adds the base counts, ``base_failed``, ``log_ratio`` (mean per n-gram) and ``kept``; columns so named are
    replaced. ``ratio`` is what ``ratios`` returned."""
    keep = others(docs.select(*[f"`{c}`" for c in (keep if keep is not None else docs.columns)]), ADDED)
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], content.alias("__t"), _words(content).alias("__w"))
    three = lambda i: [F.get("__w", i + k) for k in range(3)]
    # Low bits hold where a window starts, the others bits of its hash: sorting numbers finds those that may be repeated.
    packed = F.when(F.size("__w") > 2, F.transform(F.sequence(F.lit(0), F.size("__w") - 3), lambda i: F.call_function(
        "shiftleft", hashed(*three(i)), F.col("__b")).bitwiseOR(i.cast("long"))))
    rows = rows.withColumn("__b", F.length(F.bin(F.size("__w").cast("long"))).cast("int")).withColumn("__p", F.sort_array(packed))
    near = lambda x, y: F.coalesce(F.call_function("shiftright", x, F.col("__b"))
                                   == F.call_function("shiftright", y, F.col("__b")), F.lit(False))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__b")) - 1
    maybe = F.transform(F.filter("__p", lambda x, k: near(x, F.get("__p", k - 1)) | near(x, F.get("__p", k + 1))),
                        lambda x: x.bitwiseAND(mask).cast("int"))
    rows = rows.withColumn("__m", maybe)

    def window(i):
        words = three(i)
        return F.struct(hashed(*words).alias("h"), *[w.alias(n) for n, w in zip("abc", words)], i.alias("p"))

    # Of those, sorted by hash, and words where hashes are equal: the same windows stand together, in order.
    rows = rows.withColumn("__s", F.sort_array(F.transform("__m", window)))
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    starts = F.transform(F.filter("__s", lambda x, k: same(x, F.get("__s", k - 1)) | same(x, F.get("__s", k + 1))), lambda x: x["p"])
    lines = F.filter(F.split("__t", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    table = F.from_json(F.lit(json.dumps(ratio)), "array<bigint>")
    # A filter on a result must not be pushed below this point, where it would repeat the arrays inside of each other.
    rows = rows.withColumns({"__r": F.sort_array(starts), "__g": _buckets(len(ratio)), "__l": lines,
                             "__stop": F.monotonically_increasing_id()})
    here = F.col("__stop") >= 0
    total = F.aggregate("__g", F.lit(0).cast("long"), lambda a, g: a + F.get(table, g))
    judged = rows.select(
        *[F.col(f"`{c}`") for c in keep], F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(here, _repeated()), F.lit(0).cast("long")).alias("n_repeat_words"),
        F.when(here & (F.size("__g") > 0), total / F.size("__g") / _MICRO).otherwise(0.0).alias("log_ratio"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    judged = judged.withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold))

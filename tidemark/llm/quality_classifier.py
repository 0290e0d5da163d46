"""Quality classifier by positive-unlabelled learning.

Trusted positives are texts labelled good; everything else, good or bad, is unlabelled. With the share ``pi`` of good
texts among the unlabelled ones, the risk of a classifier is ``pi R_p(+) + R_u(-) - pi R_p(-)``; the last two terms
together estimate the risk on bad texts, which cannot be negative, so the classifier minimises the non-negative form
``pi R_p(+) + max(0, R_u(-) - pi R_p(-))``. Bad labels are never used.

``pi`` is estimated first: a classifier of positives against unlabelled texts ranks both, and in no region can the
unlabelled share be smaller than ``pi`` times the positive share, so the smallest ratio of the two bounds ``pi``.

The classifier is linear in surface features of the whole text. It is fitted on a bounded sample: the ``positives``
trusted texts and ``unlabelled`` other rows that come first by a seeded hash of their id. Every text is scored.

Null and empty texts have zero features and get the score of such a text. Without any trusted positive, or
without unlabelled rows, all scores are 0.5. Rows without an id are scored but never learnt from; repeated rows get
equal scores.
"""

from operator import eq

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.rows import extend, fields

POSITIVES = 6_000
UNLABELLED = 12_000
STEPS = 600
SEED = 20

_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!", b"|", b"#*$%&", b"<>{}[]=\\",
           b".,;:?", b"'\"()-/", b"_^~`@+", b"\n", b" \t\r\x0b\x0c", bytes(range(128, 256)),
           bytes([*range(9), *range(14, 32), 127])]
_CLASSES = np.zeros((256, len(_GROUPS)))
for _i, _group in enumerate(_GROUPS):
    _CLASSES[list(_group), _i] = 1


def features(texts: list) -> np.ndarray:
    """One row per UTF-8 text (or None)."""
    counts = np.zeros((len(texts), 256))
    shape = np.zeros((len(texts), 6))
    for i, text in enumerate(texts):
        if not text:
            continue
        counts[i] = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words, lines = text.split(), [x for x in text.split(b"\n") if x]
        n = len(words)
        if n:
            repeats = sum(map(eq, words, words[1:]))
            shape[i] = (np.log1p(n) / 10, min(len(text) / n, 50) / 10, len(set(words)) / n ** 0.85, repeats / n,
                        1 - len(set(lines)) / len(lines) if lines else 0, len(max(words, key=len)) > 60)
    size = np.maximum(counts.sum(1, keepdims=True), 1)
    shares = counts @ _CLASSES / size
    return np.hstack([shares, np.sqrt(shares), shape, np.sqrt(shape[:, 3:5])])


WIDTH = features([None]).shape[1]


def _descend(gradient, width, steps=STEPS, rate=0.05):
    """Adam from zero; ``gradient`` of the weights."""
    w, first, second = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
    return w


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Upper bound on the share of positives among the unlabelled: one half fits a ranking, the other bounds."""
    p, u = positive[::2], unlabelled[::2]
    w = _descend(lambda w: -(p * (1 - _sigmoid(p @ w))[:, None]).mean(0) + (u * _sigmoid(u @ w)[:, None]).mean(0)
                 + 1e-3 * w, p.shape[1], steps=300)
    p, u = positive[1::2] @ w, unlabelled[1::2] @ w
    if not len(p) or not len(u):
        return 0.5
    slack = np.sqrt(1 / len(p))
    bounds = [(u >= t).mean() / (p >= t).mean() for t in np.quantile(p, np.linspace(0.005, 0.5, 40))]
    return float(np.clip(min(bounds) + 0.1 * slack, 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, penalty=1e-3):
    """(mean, scale, weights, prior) of the classifier with the smallest non-negative risk, logistic loss."""
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = [np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))]) for x in (positive, unlabelled)]
    prior = estimate_prior(p, u)

    def gradient(w):
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        good = prior * -(p * (1 - sp)[:, None]).mean(0)
        bad = (u * su[:, None]).mean(0) - prior * (p * sp[:, None]).mean(0)
        risk = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        return (good + bad if risk >= 0 else -bad) + penalty * w

    return mean, scale, _descend(gradient, p.shape[1]), prior


def score(x: np.ndarray, model) -> np.ndarray:
    mean, scale, w, _ = model
    return _sigmoid(np.clip((x - mean) / scale, -8, 8) @ w[:-1] + w[-1])


def _first(ids: DataFrame, n: int) -> DataFrame:
    return ids.where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(n)


def train(docs: DataFrame, trusted: DataFrame, text="text", key="doc_id", positives=POSITIVES, unlabelled=UNLABELLED):
    """The model from ``docs`` (all of them may be learnt from) and the ids in ``trusted``; None if one is empty."""
    known = _first(trusted.select(F.col(key).alias("id")), positives).withColumn("good", F.lit(1))
    web = _first(docs.select(F.col(key).alias("id")), unlabelled).withColumn("good", F.lit(0))
    sample = F.broadcast(known.unionByName(web))  # at most positives + unlabelled pairs of numbers
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(sample, "id")
    described = extend(rows, fields(x="array<double>"), lambda texts: [list(features(texts))], keep=["id", "good"])
    # One row per id: documents that share an id count once, by the least of each feature.
    found = described.groupBy("id", "good").agg(*[F.min(F.col("x")[i]).alias(f"x{i}") for i in range(WIDTH)]).collect()
    found.sort(key=lambda r: (r.good, str(r.id)))
    p, u = (np.array([r[2:] for r in found if r.good == good]) for good in (1, 0))
    return fit(p, u) if len(p) and len(u) else None


def classify(docs: DataFrame, model, text="text", keep=None) -> DataFrame:
    """Adds ``score`` (0 to 1, higher is better) and ``predicted`` (1 from 0.5); columns so named are replaced."""
    def compute(texts):
        found = score(features(texts), model) if model else np.full(len(texts), 0.5)
        return [found, (found >= 0.5).astype(np.int32)]

    return extend(docs, fields(score="double", predicted="int"), compute, text, keep)

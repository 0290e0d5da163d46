"""URL filters: rules first, and gradient-boosted trees on lexical features for the urls that no rule fits.

A rule is a host and the start of a path; it fits the host and all its subdomains, and the longest one wins. The
urls that a rule fits are the labelled ones: the trees learn from a bounded sample of them, of each verdict the
``SAMPLE / 2`` first by a seeded hash, weighted by how many labelled urls of the verdict there are, and judge all others. Features: lengths, depth, ratio of digits, entropy of the letters, number of
parameters, hyphens and labels of the host, and statistics of the host's last label among all labelled urls.

Only DataFrame functions and Spark's own trees are used. Null urls, and those without ``://``, have an empty host
and path, fit no rule and are judged by their features. With labelled urls of one verdict only, that verdict is
given; without any, urls are allowed. Repeated rows get equal verdicts.
"""

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.rows import join_small, others

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/"))
SAMPLE = 20_000
SEED = 3
TREES, DEPTH = 12, 4
SMOOTHING = 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FEATURES = ["f_length", "f_host", "f_path", "f_depth", "f_digits", "f_entropy", "f_parameters", "f_hyphens", "f_labels",
             "f_suffix_length", "f_suffix_rate", "f_suffix_seen"]


def host_and_path(url="url"):
    """After the first ``://``: up to ``/``, ``?`` or ``#``, A-Z lower-cased; then up to ``?`` or ``#``."""
    text = F.coalesce(F.col(url), F.lit(""))
    parts = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, parts, 1), _UPPER, _LOWER), F.regexp_extract(text, parts, 2)


def _fitting(rules, value):
    """``value`` of the longest rule that fits columns ``host`` and ``path``, else null. Rules are a short list."""
    def fits(rule):
        host, path = rule.split("/", 1)
        return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)

    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    return F.coalesce(*[F.when(fits(rule), F.lit(value(verdict, rule))) for verdict, rule in ordered], F.lit(None).cast("string"))


def _with_features(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``suffixes``: ``suffix, seen, blocked`` of labelled urls."""
    url = F.col("__url")
    size = F.greatest(F.length(url), F.lit(1))
    letters = F.array_distinct(F.filter(F.split(url, ""), lambda c: c != ""))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
    query = F.regexp_extract(url, "(?s)\\?([^#]*)", 1)
    prior = suffixes.agg(F.sum("blocked").alias("b"), F.sum("seen").alias("s")).first()
    overall = (prior.b or 0) / prior.s if prior.s else 0.5
    seen, blocked = F.coalesce("seen", F.lit(0)), F.coalesce("blocked", F.lit(0))
    joined = join_small(rows.withColumn("suffix", F.substring_index("host", ".", -1)), suffixes, "suffix", "left", 64)
    return joined.withColumns({
        "f_length": F.length(url), "f_host": F.length("host"), "f_path": F.length("path"),
        "f_depth": F.size(F.split("path", "/")) - 1,
        "f_digits": (F.length(url) - F.length(F.translate(url, "0123456789", ""))) / size,
        "f_entropy": -F.aggregate(letters, F.lit(0.0), lambda a, c: a + share(c) * F.log2(share(c))),
        "f_parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "f_hyphens": F.size(F.split("host", "-")) - 1, "f_labels": F.size(F.split("host", "\\.")),
        "f_suffix_length": F.length("suffix"),
        "f_suffix_rate": (blocked + SMOOTHING * overall) / (seen + SMOOTHING), "f_suffix_seen": F.log1p(seen)})


def _sample(labelled: DataFrame, found: dict, sample: int) -> DataFrame:
    """At most half of ``sample`` of each of two verdicts; ``found`` is how many there are, and column ``weight`` brings
    the verdicts back to these shares, with 1 as its mean."""
    most = max(sample // 2, 1)
    held = {label: min(n, most) for label, n in found.items()}
    scale = sum(held.values()) / sum(found.values())
    first, second = (labelled.where(F.col("label") == label).orderBy(F.xxhash64("__url", F.lit(SEED)), "__url").limit(most)
                     .withColumn("weight", F.lit(scale * found[label] / held[label])) for label in sorted(found))
    return first.unionByName(second)


ADDED = ["host", "path", "rule", "verdict", "block_score"]


def judge(pages: DataFrame, rules=RULES, url="url", keep=None, sample=SAMPLE) -> DataFrame:
    """Adds ``host, path, rule`` (null where none fits), ``verdict`` and ``block_score`` (the trees', null where a rule
    decides or there are no trees); columns so named are replaced."""
    keep = others(pages.select(*[f"`{c}`" for c in (keep if keep is not None else pages.columns)]), ADDED)
    host, path = host_and_path(url)
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__kept")
    rows = pages.select(kept, F.coalesce(F.col(url), F.lit("")).alias("__url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", _fitting(rules, lambda v, r: r)).withColumn("said", _fitting(rules, lambda v, r: v))
    labelled = rows.where("said IS NOT NULL").withColumn("label", (F.col("said") == "block").cast("double"))
    suffixes = labelled.groupBy(F.substring_index("host", ".", -1).alias("suffix")).agg(
        F.count("*").alias("seen"), F.sum("label").alias("blocked"))
    found = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    verdict = F.col("said")
    if len(found) < 2:
        only = "block" if found.get(1.0) else "allow"
        judged = rows.withColumn("block_score", F.lit(None).cast("double"))
        verdict = F.coalesce(verdict, F.lit(only))
    else:
        chosen = _sample(labelled.select("__url", "host", "path", "label"), found, sample)
        vectors = VectorAssembler(inputCols=_FEATURES, outputCol="features")
        trees = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=SEED,
                              checkpointInterval=-1)
        model = trees.fit(vectors.transform(_with_features(chosen, suffixes)).select("features", "label", "weight"))
        scored = model.transform(vectors.transform(_with_features(rows, suffixes)))
        judged = scored.withColumn("block_score", F.when(verdict.isNull(), vector_to_array("probability")[1]))
        verdict = F.coalesce(verdict, F.when(F.col("prediction") == 1, "block").otherwise("allow"))
    return judged.select("__kept.*", "host", "path", "rule", verdict.alias("verdict"), "block_score")

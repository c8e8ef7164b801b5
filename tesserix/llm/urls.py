"""Operator 3: URL filters. Rules decide first; gradient-boosted trees on lexical features decide the rest. DataFrame only.

Features: URL and host length, path depth, digit and hyphen ratio, character entropy, parameter counts, and the smoothed rate
and count of all labelled URLs under the host's suffix (its last two labels). Suffixes are counted over all labelled rows, pre-aggregated, in
FOLDS folds by a hash of the URL; a URL's own fold is left out of its rate and count, so that no label reaches its own feature. The trees are
Spark's GBTClassifier, fitted on at most `most` different URLs, drawn by a hash of the URL and weighted by their rows (a documented
bound, whatever one URL's number of copies; scoring covers all rows). Labels come from a table (url, label 0 or 1; 1: block), by default from
a list of known hosts: a host label in BAD_HOSTS means block, any other host allow.

Null URLs and URLs without :// have an empty host and path, fit no rule, and are scored as the text they are. URLs of any length are read whole. Repeated rows get
equal verdicts. Without two classes among the labelled URLs the method answers their one class (allow if there are none). An empty table gives an empty
result; columns other than page_id and url are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserix.runtime import BROADCAST_ROWS, saved

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Host labels of URLs known to be unwanted: the labels of the training rows.
BAD_HOSTS = ("ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
MOST_LABELLED, FOLDS = 20_000, 5
FEATURES = ("len_url", "len_host", "depth", "digit_ratio", "hyphen_ratio", "entropy", "n_params", "has_fragment", "n_labels", "suffix_rate", "suffix_log_n")


def host(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. rules are a parameter of at most some hundreds."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # later ones win
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of a text's characters."""
    size = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size)
    return F.when(size == 0, 0.0).otherwise(F.aggregate(counts, F.lit(0.0), lambda a, p: F.when(p > 0, a - p * F.log2(p)).otherwise(a)))


def lexical(pages: DataFrame, *others: str) -> DataFrame:
    """page_id, url, other columns asked for, host, path and the features that need no statistics."""
    u = F.coalesce(F.col("url"), F.lit(""))
    ratio = lambda signs: F.when(F.length(u) == 0, 0.0).otherwise((F.length(u) - F.length(F.regexp_replace(u, signs, ""))) / F.length(u))
    labels = F.split("host", r"\.")
    return (
        pages.select("page_id", "url", *others).withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
        .withColumns({
            "len_url": F.length(u).cast("double"), "len_host": F.length("host").cast("double"), "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "digit_ratio": ratio("[0-9]"), "hyphen_ratio": ratio("-"), "entropy": entropy(u), "n_params": F.regexp_count(F.coalesce(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit("")), F.lit("[^&=]+=")).cast("double"),
            "has_fragment": F.contains(u, F.lit("#")).cast("double"), "n_labels": F.size(labels).cast("double"), "suffix": F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), "."),
        })
    )


def known_hosts(pages: DataFrame, bad=BAD_HOSTS) -> DataFrame:
    """(url, label) of all pages: 1 if a label of the host is known to be bad."""
    urls = pages.select("url").filter("url is not null")
    return urls.select("url", F.arrays_overlap(F.split(host(F.col("url")), r"\."), F.array(*map(F.lit, bad))).cast("int").alias("label"))


def _fold() -> Column:
    return F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS))


def suffix_counts(labels: DataFrame) -> DataFrame:
    """suffix, and per fold the labelled rows (n_0, ...) and those to block (bad_0, ...)."""
    rows = lexical(labels.select(F.lit(0).alias("page_id"), "url", "label"), "label").withColumn("__fold", _fold())
    per_fold = [F.sum(F.when(F.col("__fold") == k, x).otherwise(0)).alias(f"{name}_{k}") for k in range(FOLDS) for name, x in (("n", F.lit(1)), ("bad", F.col("label")))]
    return rows.groupBy("suffix").agg(*per_fold)


def with_suffix_stats(rows: DataFrame, counts: DataFrame, prior: float) -> DataFrame:
    """rows with suffix_rate and suffix_log_n from the folds that the row isn't in."""
    rows = rows.withColumn("__fold", _fold()).join(counts, "suffix", "left")
    others = lambda name: sum((F.when(F.col("__fold") == k, F.lit(0)).otherwise(F.coalesce(F.col(f"{name}_{k}"), F.lit(0))) for k in range(FOLDS)), F.lit(0))
    n, bad = others("n").cast("double"), others("bad").cast("double")
    drop = [f"{name}_{k}" for k in range(FOLDS) for name in ("n", "bad")]
    return rows.withColumns({"suffix_rate": (bad + 10 * prior) / (n + 10), "suffix_log_n": F.log1p(n)}).drop("__fold", *drop)


def filter_urls(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, most: int = MOST_LABELLED, trees: int = 12) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' probability of block) for every row of pages. labels: (url, label)."""
    rows = lexical(pages)
    labels = (known_hosts(pages) if labels is None else labels.select("url", F.col("label").cast("int").alias("label"))).filter("url is not null and label in (0, 1)")
    counts = saved(suffix_counts(labels), "url-suffixes")
    total = counts.agg(*[F.sum(sum((F.col(f"{name}_{k}") for k in range(FOLDS)), F.lit(0))).alias(name) for name in ("n", "bad")], F.count(F.lit(1)).alias("suffixes")).first()
    n, bad = total["n"] or 0, total["bad"] or 0
    prior = bad / max(1, n)
    if not 0 < bad < n:
        scored = rows.withColumn("score", F.lit(float(prior)))
    else:
        counts = F.broadcast(counts) if total["suffixes"] <= BROADCAST_ROWS else counts
        # about nine tenths of the bound by the hash, so that the limit only holds what the estimate of different URLs can be wrong by
        different = labels.agg(F.approx_count_distinct("url", 0.01)).first()[0]
        chosen = labels.filter(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(900_000 * min(1.0, most / max(1, different))) + (1_000_000 if different <= most else 1))
        sample = saved(chosen.groupBy("url", "label").agg(F.count(F.lit(1)).alias("rows")).limit(most), "url-sample")
        train = lexical(sample.withColumn("page_id", F.lit(0)), "label", "rows")
        to_vector = VectorAssembler(inputCols=list(FEATURES), outputCol="__features")
        # both classes count alike
        weight = F.col("rows") * F.when(F.col("label") == 1, n / (2 * bad)).otherwise(n / (2 * (n - bad)))
        data = to_vector.transform(with_suffix_stats(train, counts, prior)).select("__features", F.col("label").cast("double").alias("label"), weight.alias("__weight"))
        classes = {r["label"] for r in sample.select("label").distinct().collect()}
        if len(classes) < 2:  # one class is too rare for the sample: the suffix's rate answers
            scored = with_suffix_stats(rows, counts, prior).withColumn("score", F.col("suffix_rate"))
        else:
            model = GBTClassifier(featuresCol="__features", labelCol="label", weightCol="__weight", maxIter=trees, maxDepth=3, seed=7, checkpointInterval=-1).fit(data.coalesce(2))
            scored = model.transform(to_vector.transform(with_suffix_stats(rows, counts, prior))).withColumn("score", vector_to_array("probability")[1])
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")

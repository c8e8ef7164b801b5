"""Rank and operating metrics over (keys, y, score) rows.

Everything is built on one relation: a histogram of scores with the counts below each score. Its prefix sums run in two
levels, over BUCKETS buckets of a key and inside each bucket, so that a key with most of the rows isn't one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def cumulative(df: DataFrame, keys: list[str], value: str, counts: dict[str, Column], place: Column | None = None) -> DataFrame:
    """Per (keys, value): each count c, c_below (sum over smaller values) and c_all (sum over all). counts: name -> expression to sum.

    place: an expression of keys and value that doesn't fall where the value grows, and spreads values over [0, 1], which the buckets cut; the
    value itself unless given. Results are the same for any place; values that share a bucket are ordered in one task."""
    hist = df.groupBy(*keys, value).agg(*[F.sum(e).alias(c) for c, e in counts.items()])
    at = F.col(value).cast("double") if place is None else place
    hist = hist.withColumn("__bucket", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), at)) * BUCKETS).cast("int"))
    every = Window.partitionBy(*keys) if keys else Window.partitionBy()
    before = every.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = hist.groupBy(*keys, "__bucket").agg(*[F.sum(c).alias(c) for c in counts])
    totals = totals.select(*keys, "__bucket", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}_0") for c in counts], *[F.sum(c).over(every).alias(f"{c}_all") for c in counts])
    inside = Window.partitionBy(*keys, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = hist.join(totals, [*keys, "__bucket"])
    below = [(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"__{c}_0")).alias(f"{c}_below") for c in counts]
    return out.select(*keys, value, *counts, *below, *[f"{c}_all" for c in counts])


def ranked(df: DataFrame, keys: list[str], score: str = "score", y: str = "y", weight: Column | None = None, place: Column | None = None) -> DataFrame:
    """cumulative() with p (positives) and n (negatives), each row counting weight (1 unless given)."""
    w = F.lit(1) if weight is None else weight
    rows = df.filter(F.col(score).isNotNull() & F.col(y).isin(0, 1))
    return cumulative(rows, keys, score, {"p": F.when(F.col(y) == 1, w).otherwise(F.lit(0)), "n": F.when(F.col(y) == 0, w).otherwise(F.lit(0))}, place)


def auc_expr() -> Column:
    """From ranked(): half credit for ties; twice the statistic is a whole number, divided once. Null without both classes."""
    pairs = F.first("p_all").cast("double") * F.first("n_all")
    return F.when(pairs > 0, F.sum(F.col("p") * (2 * F.col("n_below") + F.col("n"))) / (2 * pairs))


def tpr_at_fpr_expr(target: float) -> Column:
    """The largest TPR among all thresholds with FPR at most target (0 if none)."""
    p, n = F.nullif(F.col("p_all"), F.lit(0)), F.nullif(F.col("n_all"), F.lit(0))
    fits = (n - F.col("n_below")) / n <= target
    return F.when((F.first("p_all") > 0) & (F.first("n_all") > 0), F.coalesce(F.max(F.when(fits, (p - F.col("p_below")) / p)), F.lit(0.0)))


def fpr_at_tpr_expr(target: float = 0.95) -> Column:
    """FPR at the first threshold from above that reaches the TPR."""
    p, n = F.nullif(F.col("p_all"), F.lit(0)), F.nullif(F.col("n_all"), F.lit(0))
    return F.when((F.first("p_all") > 0) & (F.first("n_all") > 0), F.min(F.when((p - F.col("p_below")) / p >= target, (n - F.col("n_below")) / n)))


def accuracy_expr(score: str = "score") -> Column:
    return F.sum(F.when(F.col(score) >= 0.5, F.col("p")).otherwise(F.col("n"))) / F.sum(F.col("p") + F.col("n"))


def _grouped(df: DataFrame, keys: list[str], *exprs: Column) -> DataFrame:
    return (df.groupBy(*keys) if keys else df.groupBy()).agg(*exprs)


def auc(df: DataFrame, keys: list[str], score: str = "score", y: str = "y", weight: Column | None = None, name: str = "auc") -> DataFrame:
    return _grouped(ranked(df, keys, score, y, weight), keys, auc_expr().alias(name))


def robustness_table(df: DataFrame, keys: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """n, acc, auc, tpr_at_1fpr, tpr_at_5fpr, fpr_at_95tpr per key, in one pass over the histogram."""
    return _grouped(
        ranked(df, keys, score, y), keys, F.sum(F.col("p") + F.col("n")).alias("n"), accuracy_expr(score).alias("acc"), auc_expr().alias("auc"),
        tpr_at_fpr_expr(0.01).alias("tpr_at_1fpr"), tpr_at_fpr_expr(0.05).alias("tpr_at_5fpr"), fpr_at_tpr_expr(0.95).alias("fpr_at_95tpr"),
    )


def rate(hit: Column, among: Column) -> Column:
    """Share of `among` rows that are hits; null without any."""
    return F.avg(F.when(among, hit.cast("double")))


def operating_metrics(df: DataFrame, keys: list[str], score: str, high: Column, low: Column, y: str = "y") -> DataFrame:
    """Rows' rates under a policy: fpr, recall, false_clear_rate, coverage, review_rate."""
    flagged, cleared, yy = F.col(score) >= high, F.col(score) <= low, F.col(y)
    return _grouped(
        df, keys, rate(flagged, yy == 0).alias("fpr"), rate(flagged, yy == 1).alias("recall"), rate(cleared, yy == 1).alias("false_clear_rate"),
        F.avg((flagged | cleared).cast("double")).alias("coverage"), F.avg((~(flagged | cleared)).cast("double")).alias("review_rate"),
    )


def one_label(y: str = "y") -> Column:
    """The group's label, or an error if its views disagree."""
    return F.when(F.min(y) == F.max(y), F.min(y)).otherwise(F.raise_error(F.lit("an original has views with different labels")))


def any_view_metrics(df: DataFrame, keys: list[str], score: str, high: Column, low: Column, group: str = "grp") -> DataFrame:
    """Originals' errors: real flagged in any view, fake cleared in any view, and any view under review."""
    s = F.col(score)
    per = df.groupBy(*keys, group).agg(one_label().alias("y"), F.max((s >= high).cast("int")).alias("flag"), F.max((s <= low).cast("int")).alias("clear"), F.max(((s > low) & (s < high)).cast("int")).alias("review"))
    real, fake = F.col("y") == 0, F.col("y") == 1
    return _grouped(
        per, keys, F.sum(F.when(real, F.col("flag")).otherwise(0)).alias("real_any_view_errors"), F.sum(real.cast("long")).alias("n_real"), rate(F.col("flag"), real).alias("real_any_view_fpr"),
        F.sum(F.when(fake, F.col("clear")).otherwise(0)).alias("fake_any_view_clear_errors"), F.sum(fake.cast("long")).alias("n_fake"), rate(F.col("clear"), fake).alias("fake_any_view_false_clear"),
        F.avg(F.col("review").cast("double")).alias("original_any_view_review"),
    )


def brier(df: DataFrame, keys: list[str], score: str, y: str = "y") -> DataFrame:
    return _grouped(df, keys, F.avg((F.col(score) - F.col(y)) * (F.col(score) - F.col(y))).alias("brier"))


def error_summary(df: DataFrame, score: str, degraded: str, y: str = "y") -> DataFrame:
    """One row: counts, error rates at 0.5, AUC and FPR at 95 % TPR of both scores, mean drift by class, flips."""
    s, d, yy = F.col(score), F.col(degraded), F.col(y)
    real, fake = yy == 0, yy == 1
    counts = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(real.cast("long")).alias("n_real"), F.sum(fake.cast("long")).alias("n_fake"),
        F.sum((real & (s >= 0.5)).cast("long")).alias("n_false_positives"), F.sum((fake & (s < 0.5)).cast("long")).alias("n_false_negatives"),
        rate(s >= 0.5, real).alias("fpr"), rate(s < 0.5, fake).alias("fnr"), F.avg(F.when(real, d - s)).alias("drift_real"), F.avg(F.when(fake, d - s)).alias("drift_fake"),
        F.sum((real & (s < 0.5) & (d >= 0.5)).cast("long")).alias("n_flips_to_fp"), F.sum((fake & (s >= 0.5) & (d < 0.5)).cast("long")).alias("n_flips_to_fn"),
    )
    for name, column in (("clean", score), ("degraded", degraded)):
        counts = counts.crossJoin(_grouped(ranked(df, [], column, y), [], auc_expr().alias(f"auc_{name}"), fpr_at_tpr_expr().alias(f"fpr_at_95tpr_{name}")))  # one row each
    return counts


def memberships(df: DataFrame) -> DataFrame:
    """Each row once per domain it belongs to: all, its own, and its domain's tampered part (real and tampered)."""
    own = F.array(F.lit("all"), F.col("domain"))
    return df.withColumn("member", F.explode(F.when(F.col("sid") != 1, F.concat(own, F.array(F.concat("domain", F.lit("_tampered"))))).otherwise(own)))


def condition_summary(per_condition: DataFrame, keys: list[str]) -> DataFrame:
    """Means over conditions and the worst AUC, from robustness_table rows."""
    return _grouped(per_condition, keys, F.avg("auc").alias("mean_auc"), F.min("auc").alias("worst_auc"), F.avg("acc").alias("mean_acc"), F.avg("tpr_at_1fpr").alias("mean_tpr_at_1fpr"), F.count(F.lit(1)).alias("n_conditions"))


def per_class(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Real against all, synthetic (sid 1) and tampered (sid 2): n, AUC, TPR at 1 % and 5 % FPR."""
    kinds = F.array(F.lit("all"), F.when(F.col("sid") != 2, "synthetic"), F.when(F.col("sid") != 1, "tampered"))
    rows = df.withColumn("against", F.explode(F.filter(kinds, lambda k: k.isNotNull())))
    return _grouped(ranked(rows, [*keys, "against"], score), [*keys, "against"], F.sum(F.col("p") + F.col("n")).alias("n"), auc_expr().alias("auc"), tpr_at_fpr_expr(0.01).alias("tpr_at_1fpr"), tpr_at_fpr_expr(0.05).alias("tpr_at_5fpr"))


def probe_separability(df: DataFrame, probes: list[str], y: str = "y") -> DataFrame:
    """Per scalar probe: AUC, its distance from chance (max of auc and 1 - auc), class means."""
    rows = df.select(y, F.explode(F.map_from_arrays(F.array(*map(F.lit, probes)), F.array(*[F.col(p).cast("double") for p in probes]))).alias("probe", "value"))
    means = rows.groupBy("probe").agg(
        F.avg(F.when(F.col(y) == 0, F.col("value"))).alias("mean_real"), F.avg(F.when(F.col(y) == 1, F.col("value"))).alias("mean_fake"), F.percentile_approx("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias("q"),
    )
    # probes have units of their own: buckets lie around each one's median, as wide as its quartiles are apart; a row per probe
    q = means.select("probe", F.get("q", 1).alias("__mid"), F.greatest(F.get("q", 2) - F.get("q", 0), F.lit(1e-12)).alias("__wide"))
    place = 0.5 + F.atan((F.col("value") - F.col("__mid")) / F.col("__wide")) / math.pi
    aucs = _grouped(ranked(rows.join(F.broadcast(q), "probe"), ["probe", "__mid", "__wide"], "value", y, place=place), ["probe"], auc_expr().alias("auc"))
    return aucs.withColumn("separability", F.greatest("auc", 1 - F.col("auc"))).join(means.drop("q"), "probe")

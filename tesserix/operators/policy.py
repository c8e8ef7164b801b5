"""Three-way decision policies from worst-view order statistics. Each original, not each view, is a trial."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserix.functions.binomial import allowed, upper
from tesserix.functions.scalars import next_down, next_up
from tesserix.operators.metrics import cumulative, one_label

TARGET_FPR, TARGET_FALSE_CLEAR, CONFIDENCE, MARGIN = 0.01, 0.05, 0.95, 1e-5


def worst_views(df: DataFrame, keys: list[str], score: str = "score", group: str = "grp") -> DataFrame:
    """Per original: its label and its worst view (largest score if real, smallest if fake). A score that is null or not finite is an error."""
    s = F.col(score).cast("double")
    per = df.groupBy(*keys, group).agg(one_label().alias("y"), F.max(score).alias("top"), F.min(score).alias("bottom"), F.every(F.coalesce(F.abs(s) < float("inf"), F.lit(False)) & ~F.isnan(s)).alias("__finite"))
    worst = F.when(F.col("y") == 0, F.col("top")).otherwise(F.col("bottom"))
    return per.select(*keys, group, "y", F.when(F.col("__finite"), worst).otherwise(F.raise_error(F.lit("a score isn't finite"))).alias("worst"))


def select_policy(df: DataFrame, keys: list[str], score: str = "score", group: str = "grp", target_fpr=TARGET_FPR, target_false_clear: float = TARGET_FALSE_CLEAR, confidence: float = CONFIDENCE, bounds: bool = True) -> DataFrame:
    """One policy per key. The k-th worst views are found in cumulative counts, so no class is sorted in one task.

    target_fpr: a number or the name of one of the keys. Targets lie strictly between 0 and 1. A key without originals of both classes is an error."""
    for t in (target_fpr, target_false_clear):
        if not isinstance(t, str) and not 0 < t < 1:
            raise ValueError(f"{t} is no error rate")
    target = F.col(target_fpr) if isinstance(target_fpr, str) else F.lit(float(target_fpr))
    target = F.when((target > 0) & (target < 1), target).otherwise(F.raise_error(F.lit("a target is no error rate")))
    worst = worst_views(df, keys, score, group)
    steps = cumulative(worst, [*keys, "y"], "worst", {"c": F.lit(1)})
    sizes = worst.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("n"))
    may = sizes.withColumn("may", allowed(F.col("n"), F.when(F.col("y") == 0, target).otherwise(F.lit(target_false_clear)), confidence)).select(*keys, "y", "n", F.col("may.k").alias("k"), F.col("may.certified").alias("certified"))
    # real from the top, fake from the bottom
    beyond = F.when(F.col("y") == 0, F.col("c_all") - F.col("c_below") - F.col("c")).otherwise(F.col("c_below"))
    at_k = steps.join(may, [*keys, "y"]).filter((beyond <= F.col("k")) & (F.col("k") < beyond + F.col("c")))
    real, fake = F.col("y") == 0, F.col("y") == 1
    pick = lambda c, of: F.max(F.when(of, F.col(c)))
    grouped = at_k.groupBy(*keys) if keys else at_k.groupBy()
    cut = grouped.agg(
        pick("worst", real).alias("real_k"), pick("worst", fake).alias("fake_k"), pick("n", real).alias("n_real"), pick("n", fake).alias("n_fake"),
        pick("k", real).alias("k_real"), pick("k", fake).alias("k_fake"), pick("certified", real).alias("fpr_bound_met"), pick("certified", fake).alias("false_clear_bound_met"),
    )
    whole = F.col("real_k").isNotNull() & F.col("fake_k").isNotNull()
    checked = lambda c: F.when(whole, F.col(c)).otherwise(F.raise_error(F.lit("a policy needs originals of both classes")))
    cut = cut.withColumn("h", next_up(checked("real_k"))).withColumn("l", next_down(checked("fake_k")))
    # where flagging would begin below clearing, both give way: the band between them is half of what they overlapped
    middle, reach = (F.col("l") + F.col("h")) / 2, F.greatest(F.col("l") - F.col("h"), F.lit(0.0)) / 4
    meets = F.col("l") >= F.col("h")
    cut = cut.withColumn("high", F.when(meets, middle + reach).otherwise(F.col("h"))).withColumn("low", F.when(meets, middle - reach).otherwise(F.col("l")))
    told = worst.join(cut.select(*keys, "high", "low"), keys) if keys else worst.crossJoin(cut.select("high", "low"))  # one row
    grouped = told.groupBy(*keys) if keys else told.groupBy()
    errors = grouped.agg(F.sum((real & (F.col("worst") >= F.col("high"))).cast("long")).alias("real_errors"), F.sum((fake & (F.col("worst") <= F.col("low"))).cast("long")).alias("fake_errors"))
    out = cut.join(errors, keys) if keys else cut.crossJoin(errors)
    out = out.select(*keys, "high", "low", "n_real", "n_fake", "k_real", "k_fake", "fpr_bound_met", "false_clear_bound_met", "real_errors", "fake_errors")
    if bounds:
        out = out.withColumn("fpr_upper", upper(F.col("real_errors"), F.col("n_real"), confidence)).withColumn("false_clear_upper", upper(F.col("fake_errors"), F.col("n_fake"), confidence))
    return out


def numerical_guard(policy: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Widen the review band by margin on either side; counts and bounds stay those of the unguarded thresholds."""
    if margin < 0:
        raise ValueError("the margin must not be negative")
    return policy.withColumn("high", F.col("high") + margin).withColumn("low", F.col("low") - margin).withColumn("margin", F.lit(margin))


def conditionwise_policy(df: DataFrame, condition: str, score: str = "score", group: str = "grp", bounds: bool = True, **kw) -> DataFrame:
    """The intersection of the conditions' guarded policies: one row. An original twice in one condition is an error."""
    once = df.groupBy(condition, group).agg(F.min("y").alias("__y0"), F.max("y").alias("__y1"), F.min(score).alias(score), F.count(F.lit(1)).alias("__rows"))
    once = once.select(condition, group, F.when(F.col("__rows") == 1, F.col("__y0")).otherwise(F.raise_error(F.lit("an original occurs twice in a condition"))).alias("y"), score)
    each = numerical_guard(select_policy(once, [condition], score, group, bounds=bounds, **kw))
    return each.agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.max("real_errors").alias("real_errors"), F.max("fake_errors").alias("fake_errors"),
        F.every("fpr_bound_met").alias("fpr_bound_met"), F.every("false_clear_bound_met").alias("false_clear_bound_met"), F.count(F.lit(1)).alias("n_conditions"),
        *([F.max("fpr_upper").alias("fpr_upper"), F.max("false_clear_upper").alias("false_clear_upper")] if bounds else []),
    )


def development_gate(table: DataFrame, baseline: str = "base", candidate: str = "cand") -> DataFrame:
    """table (condition, model, auc): may the candidate replace the baseline? One row."""
    at = lambda m, c: F.max(F.when((F.col("model") == m) & (F.col("condition") == c), F.col("auc")))
    mean = lambda m: F.avg(F.when(F.col("model") == m, F.col("auc")))
    out = table.agg(mean(baseline).alias("mean_base"), mean(candidate).alias("mean_cand"), (at(candidate, "resize_0.25") - at(baseline, "resize_0.25")).alias("thumbnail_delta"), (at(candidate, "clean") - at(baseline, "clean")).alias("clean_delta"))
    return out.withColumn("eligible", (F.col("mean_cand") >= F.col("mean_base")) & (F.col("thumbnail_delta") >= -0.005) & (F.col("clean_delta") >= -0.01))


def development_selection(table: DataFrame, clean: DataFrame, baseline: str = "base") -> DataFrame:
    """Which model goes on: table (model, ord, condition, auc) on external development data, clean (model, auc) on the own source's.

    A candidate is eligible if it passes development_gate() against the baseline and loses at most 0.005 on the own source; the baseline always is. Of
    the eligible ones the one with the largest mean AUC is selected, the first in order on ties. One row per model."""
    at = lambda c: F.max(F.when(F.col("condition") == c, F.col("auc")))
    per = table.groupBy("model").agg(F.min("ord").alias("ord"), F.avg("auc").alias("mean_auc"), at("resize_0.25").alias("thumb"), at("clean").alias("clean"))
    per = per.join(clean.select("model", F.col("auc").alias("own_auc")), "model")
    base = per.filter(F.col("model") == baseline).select(*[F.col(c).alias(f"__{c}") for c in ("mean_auc", "thumb", "clean", "own_auc")])
    out = per.crossJoin(F.broadcast(base))  # one row
    guard = F.col("own_auc") >= F.col("__own_auc") - 0.005
    gate = (F.col("mean_auc") >= F.col("__mean_auc")) & (F.col("thumb") - F.col("__thumb") >= -0.005) & (F.col("clean") - F.col("__clean") >= -0.01)
    out = out.select(
        "model", "ord", "mean_auc", (F.col("thumb") - F.col("__thumb")).alias("thumbnail_delta"), (F.col("clean") - F.col("__clean")).alias("clean_delta"), "own_auc", guard.alias("own_guard_met"),
        ((F.col("model") == baseline) | (gate & guard)).alias("eligible"),
    )
    best = out.agg(F.min(F.when(F.col("eligible"), F.struct((-F.col("mean_auc")).alias("m"), "ord", "model")))["model"].alias("__best"))
    return out.crossJoin(F.broadcast(best)).withColumn("selected", F.col("model") == F.col("__best")).drop("__best")


def release_gate(records: DataFrame, reference: str) -> DataFrame:
    """records (name, bounds_supported, external_auc, tampered_auc, review_rate) to the same with the gates and selected.

    Of those that pass all gates the one with the least review is selected, else the reference."""
    ref = records.filter(F.col("name") == reference).select(F.col("external_auc").alias("__e"), F.col("tampered_auc").alias("__t"), F.col("review_rate").alias("__r"))
    out = records.crossJoin(F.broadcast(ref))  # one row
    out = out.withColumn("external_ok", F.col("external_auc") >= F.col("__e") - 0.005).withColumn("tampered_ok", F.col("tampered_auc") >= F.col("__t") - 0.005).withColumn("lower_review", F.col("review_rate") < F.col("__r"))
    out = out.withColumn("eligible", F.col("bounds_supported") & F.col("external_ok") & F.col("tampered_ok") & F.col("lower_review") & (F.col("name") != reference)).drop("__e", "__t", "__r")
    best = out.agg(F.coalesce(F.min(F.when(F.col("eligible"), F.struct("review_rate", "name")))["name"], F.lit(reference)).alias("__best"))
    return out.crossJoin(F.broadcast(best)).withColumn("selected", F.col("name") == F.col("__best")).drop("__best")

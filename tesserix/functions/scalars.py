"""Scalar rules: labels, clamps, verdicts, fixed-point text, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def binary_label(sid: Column) -> Column:
    """0 real, 1 and 2 generated or tampered; anything else has no label."""
    return F.when(sid == 0, 0).when(sid.isin(1, 2), 1)


def folder(label: Column) -> Column:
    return F.when(label == 0, "real").when(label == 1, "aigc")


def sid_from_path(path: Column) -> Column:
    """The number before the first _ of the file's stem; without one, 1 below a folder aigc, else 0."""
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    parent = F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)
    return F.coalesce(F.regexp_extract(stem, r"^([0-9]+)_", 1).try_cast("int"), F.when(parent == "aigc", 1).otherwise(0))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def clamp(x: Column) -> Column:
    """What isn't finite is 0.5; the rest is cut to [0, 1]."""
    return F.when(is_finite(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(F.lit(0.5))


def verdict(score: Column, high: Column, low: Column) -> Column:
    """flag, clear or review; not finite: review first of all; without a policy: by 0.5."""
    return (
        F.when(~is_finite(score), "review").when(high.isNull(), F.when(score >= 0.5, "flag").otherwise("clear"))
        .when(score >= high, "flag").when(score <= low, "clear").otherwise("review")
    )


def next_up(x: Column) -> Column:
    return F.when(x.isNotNull(), F.reflect(F.lit("java.lang.Math"), F.lit("nextUp"), F.coalesce(x, F.lit(0.0))).cast("double"))


def next_down(x: Column) -> Column:
    return F.when(x.isNotNull(), F.reflect(F.lit("java.lang.Math"), F.lit("nextDown"), F.coalesce(x, F.lit(0.0))).cast("double"))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def platt(score: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(F.lit(a) * score + F.lit(b)))


def blend(p0: Column, p1: Column, alpha: float) -> Column:
    return (1 - alpha) * p0 + alpha * p1


def dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v))


def normalised(x: Column) -> Column:
    """x over its length plus 1e-8."""
    n = norm(x) + 1e-8
    return F.transform(x, lambda v: v / n)


def half_up(x: Column, digits: int) -> Column:
    return F.round(x.cast("decimal(18,10)"), digits)


def callback_text(pred: Column, high: Column, low: Column) -> Column:
    """What a reader of one score is told: the verdict, the score and where the thresholds lie; a score that isn't finite claims nothing."""
    said = F.when(pred >= high, "AI flag").when(pred <= low, "Low signal").otherwise("Needs review")
    told = F.format_string("%s (score %.3f; flagged from %.3f, low signal up to %.3f)", said, pred, high, low)
    return F.when(is_finite(pred), told).otherwise(F.lit("Needs review (no valid score)"))

"""Sigmoid calibration of a frozen head's scores, cross-fitted over stratified folds.

A fold's sigmoid is fitted to its own rows, to smoothed targets ((n1 + 1) / (n1 + 2) and 1 / (n0 + 2)), by Newton steps from 0; the calibrated score is the mean of all folds' sigmoids. A
step for all folds is one pass: five sums a fold. Folds are min(MOST, rows of the rarer label), at least 2; each label is dealt out over them by hash ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserix.operators.sampling import hash_ranks
from tesserix.runtime import forget, saved

MOST, STEPS, RIDGE = 5, 12, 1e-9


def n_folds(df: DataFrame, y: str = "y") -> int:
    """Folds that the rarer label allows."""
    n = [r["n"] for r in df.filter(F.col(y).isin(0, 1)).groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(2, min([MOST, *n])) if len(n) == 2 else 2


def dealt(df: DataFrame, key: str, folds: int, y: str = "y", seed: str = "calibration") -> DataFrame:
    """df with fold: of each label, ranks by the hash of key, dealt out in turn."""
    return hash_ranks(df, [y], key, seed).withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(folds)).cast("int"))


def newton(a: Column, b: Column, sums: dict[str, Column]) -> tuple[Column, Column]:
    """The step of (a, b), given slopes (ga, gb) and curvatures (haa, hab, hbb)."""
    haa, hbb = sums["haa"] + RIDGE, sums["hbb"] + RIDGE
    det = haa * hbb - sums["hab"] * sums["hab"]
    return a - (hbb * sums["ga"] - sums["hab"] * sums["gb"]) / det, b - (haa * sums["gb"] - sums["hab"] * sums["ga"]) / det


def fit_folds(df: DataFrame, score: str = "score", y: str = "y", steps: int = STEPS) -> list[tuple[int, float, float]]:
    """(fold, a, b) of 1 / (1 + exp(-(a s + b))) for each fold of df (score, y, fold): one aggregation a step, a row a fold to the driver."""
    spark = df.sparkSession
    rows = df.filter(F.col(y).isin(0, 1) & F.col(score).isNotNull()).select("fold", F.col(score).cast("double").alias("s"), F.col(y).alias("t"))
    rows = saved(rows, "calibration-rows")  # three narrow columns; every step reads them
    sizes = rows.groupBy("fold").agg(F.sum("t").alias("n1"), F.sum(1 - F.col("t")).alias("n0")).collect()
    found = [(r["fold"], 0.0, 0.0, (r["n1"] + 1) / (r["n1"] + 2), 1 / (r["n0"] + 2)) for r in sizes]
    for _ in range(steps):
        told = F.broadcast(spark.createDataFrame(found, "fold int, a double, b double, high double, low double"))
        p = 1 / (1 + F.exp(-(F.col("a") * F.col("s") + F.col("b"))))
        r = rows.join(told, "fold").withColumn("p", p).withColumn("g", F.col("p") - F.when(F.col("t") == 1, F.col("high")).otherwise(F.col("low"))).withColumn("h", F.col("p") * (1 - F.col("p")))
        sums = r.groupBy("fold", "a", "b", "high", "low").agg(
            F.sum(F.col("g") * F.col("s")).alias("ga"), F.sum("g").alias("gb"), F.sum(F.col("h") * F.col("s") * F.col("s")).alias("haa"), F.sum(F.col("h") * F.col("s")).alias("hab"), F.sum("h").alias("hbb")
        )
        a, b = newton(F.col("a"), F.col("b"), {c: F.col(c) for c in ("ga", "gb", "haa", "hab", "hbb")})
        found = [tuple(x) for x in sums.select("fold", a.alias("a"), b.alias("b"), "high", "low").collect()]
    forget(spark, rows)
    return [(f, a, b) for f, a, b, _, _ in sorted(found)]


def calibrated(score: Column, sigmoids: list[tuple[int, float, float]]) -> Column:
    """The mean of all folds' sigmoids; scores that are null or NaN give 0.5."""
    mean = sum((1 / (1 + F.exp(-(score * a + b))) for _, a, b in sigmoids), F.lit(0.0)) / max(1, len(sigmoids))
    return F.when(score.isNull() | F.isnan(score), 0.5).otherwise(mean if sigmoids else F.lit(0.5))

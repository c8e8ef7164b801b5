"""Linear heads on feature vectors by Spark ML: scaling, weighted fits, calibration, cross-validation, ablation, blends.

Objectives follow the usual definition sum(w loss) / sum(w) + L2 / (2 C sum(w)); scaling divides by the population deviation. Multilayer and boosted heads are in
perceptron and boosting.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserix.functions.scalars import dot, sigmoid
from tesserix.operators.metrics import auc
from tesserix.operators.vectors import scale_stats


def scaled(x: Column, mean: list[float], std: list[float]) -> Column:
    """(x - mean) / std, with a deviation of 0 as 1."""
    m, s = F.array(*map(F.lit, mean)), F.array(*[F.lit(v if v > 0 else 1.0) for v in std])
    return F.zip_with(F.zip_with(x, m, lambda a, b: a - b), s, lambda a, b: a / b)


def moments(df: DataFrame, weight: Column | None = None) -> tuple[list[float], list[float]]:
    """Per position mean and population deviation: as many numbers as the vector is wide."""
    rows = sorted(scale_stats(df, weight=weight).select("pos", "mean", "std").collect(), key=lambda r: r["pos"])
    return [r["mean"] for r in rows], [r["std"] for r in rows]


def balanced(df: DataFrame, y: str = "y") -> dict[int, float]:
    n = {r[y]: r["n"] for r in df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()}
    return {k: sum(n.values()) / (len(n) * v) for k, v in n.items()}


class LinearHead:
    """Weights, bias and scaling; its score is one expression, evaluated where the data are."""

    def __init__(self, mean, std, weights, bias):
        self.mean, self.std, self.weights, self.bias = list(mean), list(std), list(weights), float(bias)

    def score(self, x: Column) -> Column:
        return sigmoid(dot(scaled(x, self.mean, self.std), F.array(*map(F.lit, self.weights))) + self.bias)


def fit_logistic(df: DataFrame, c: float = 1.0, weight: Column | None = None, class_balanced: bool = True, weigh_scaling: bool = False, scaling: tuple[list[float], list[float]] | None = None) -> LinearHead:
    """df (x, y). weight: of rows; class_balanced: times n / (2 n_class); weigh_scaling: the scaling is weighted too; scaling: of these rows, where it is known."""
    w = F.lit(1.0) if weight is None else weight
    mean, std = scaling or moments(df, w if weigh_scaling else None)
    if class_balanced:
        by = balanced(df)
        w = w * F.when(F.col("y") == 1, by.get(1, 1.0)).otherwise(by.get(0, 1.0))
    rows = df.select(array_to_vector(scaled(F.col("x"), mean, std)).alias("features"), F.col("y").cast("double").alias("label"), w.alias("weight")).persist()
    total = rows.agg(F.sum("weight")).first()[0]
    model = LogisticRegression(weightCol="weight", standardization=False, regParam=1 / (c * total), elasticNetParam=0.0, maxIter=200, tol=1e-8).fit(rows)
    rows.unpersist()
    return LinearHead(mean, std, model.coefficients.toArray().tolist(), model.intercept)


def fit_platt(df: DataFrame, score: str = "score") -> tuple[float, float]:
    """a and b of 1 / (1 + exp(a s + b)), fitted to smoothed targets: each row counts as both labels, by its target."""
    n = {r["y"]: r["n"] for r in df.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    hi, lo = (n.get(1, 0) + 1) / (n.get(1, 0) + 2), 1 / (n.get(0, 0) + 2)
    t = F.when(F.col("y") == 1, hi).otherwise(lo)
    rows = df.select(array_to_vector(F.array(F.col(score))).alias("features"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), t.alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - t).alias("weight")))).alias("e")).select("features", "e.*")
    model = LogisticRegression(weightCol="weight", regParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(rows)
    return -float(model.coefficients[0]), -float(model.intercept)


#: Fits that run at the same time, so that the small jobs of one don't leave a cluster idle.
AT_ONCE = 4


def at_once(work: list) -> list:
    """The results of functions without arguments, run side by side."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(w) for w in work]]


def _scored_folds(df: DataFrame, heads: list[LinearHead]) -> DataFrame:
    """df with out-of-fold scores, in one reading: each row by the head that didn't learn from its fold."""
    score = F.lit(None).cast("double")
    for f, head in enumerate(heads):
        score = F.when(F.col("fold") == f, head.score(F.col("x"))).otherwise(score)
    return df.filter(F.col("fold").between(0, len(heads) - 1)).withColumn("score", score)


def cross_validated(df: DataFrame, k: int, fit=fit_logistic, **kw) -> DataFrame:
    """df (x, y, fold) to its rows with out-of-fold scores."""
    return _scored_folds(df, at_once([lambda f=f: fit(df.filter(F.col("fold") != f), **kw) for f in range(k)]))


def grid(df: DataFrame, k: int, cs=(0.01, 0.1, 1.0), weights=(1.0, 2.0, 5.0)) -> list[tuple[float, float, float]]:
    """(auc, c, tampered weight) of each setting by cross-validation; the first best is max() by auc. All fits of all settings share one kept table."""
    settings = [(c, w) for c in cs for w in weights]
    rows = df.persist()
    # a fold's scaling is the same in all settings
    scalings = at_once([lambda f=f: moments(rows.filter(F.col("fold") != f)) for f in range(k)])
    fits = at_once([lambda c=c, w=w, f=f: fit_logistic(rows.filter(F.col("fold") != f), c=c, weight=F.when(F.col("sid") == 2, w).otherwise(1.0), scaling=scalings[f]) for c, w in settings for f in range(k)])
    scored = [_scored_folds(rows, fits[i * k : (i + 1) * k]).select("y", "score", F.lit(i).alias("setting")) for i in range(len(settings))]
    every = scored[0]
    for s in scored[1:]:
        every = every.unionByName(s)
    found = {r["setting"]: r["auc"] for r in auc(every, ["setting"]).collect()}
    rows.unpersist()
    return [(found.get(i), c, w) for i, (c, w) in enumerate(settings)]


def branch_ablation(df: DataFrame, k: int, branches: dict[str, list[tuple[int, int]]]) -> DataFrame:
    """branch, auc: heads on slices of x, cross-validated; branches: name -> slices (start, stop)."""
    parts = {name: df.withColumn("x", F.concat(*[F.slice("x", a + 1, b - a) for a, b in slices])) for name, slices in branches.items()}
    scored = at_once([lambda p=p, n=n: cross_validated(p, k).select("y", "score", F.lit(n).alias("branch")) for n, p in parts.items()])
    every = scored[0]
    for s in scored[1:]:
        every = every.unionByName(s)
    return auc(every, ["branch"])

"""Boosted trees, the perceptron and cross-fitted calibration against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tesserix.operators import boosting, calibration, metrics, perceptron


def brute_tree(bins, raw, y, w, leaves, l2, least, rate):
    """Best-first growth with all sums taken anew: (leaf of each row's values)."""
    g, h = boosting.gradients(raw, y, w)
    g, h = g / boosting.GRAIN, h / boosting.GRAIN

    def best(rows):
        out = None
        for k in range(bins.shape[1]):
            for at in np.unique(bins[rows, k])[:-1]:
                left, right = rows[bins[rows, k] <= at], rows[bins[rows, k] > at]
                if min(len(left), len(right)) < least:
                    continue
                of = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
                gain = of(left) + of(right) - of(rows)
                if gain > 1e-12 and (out is None or gain > out[0] + 1e-12):
                    out = (gain, left, right)
        return out

    parts = [(np.arange(len(y)), best(np.arange(len(y))))]
    while len(parts) < leaves:
        open_parts = [i for i, (_, b) in enumerate(parts) if b]
        if not open_parts:
            break
        _, (_, left, right) = parts.pop(max(open_parts, key=lambda i: parts[i][1][0]))
        parts += [(left, best(left)), (right, best(right))]
    values = np.empty(len(y))
    for rows, _ in parts:
        values[rows] = -rate * g[rows].sum() / (h[rows].sum() + l2)
    return values, len(parts)


def test_boosted_trees_by_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 700
    x = np.round(rng.normal(0, 1, (n, 4)), 1)
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] + rng.normal(0, 0.4, n) > 0).astype(float)
    w = 1 + (np.arange(n) % 3) / 2
    df = spark.createDataFrame([(r.tolist(), float(t), float(v)) for r, t, v in zip(x, y, w, strict=True)], "x array<double>, y double, w double").repartition(5)
    model = boosting.fit_boosted(df, trees=3, leaves=9, least=15, weight=F.col("w"))
    bins, raw = model.bins(x), np.full(n, np.log((w * y).sum() / (w * (1 - y)).sum()))
    for tree in model.trees:
        values, parts = brute_tree(bins, raw, y, w, 9, 1.0, 15, 0.1)
        assert np.allclose(tree.values(bins), values, atol=1e-9) and sum(f < 0 for f in tree.feature) == parts <= 9
        raw += values
    again = boosting.fit_boosted(df.repartition(2), trees=1, leaves=9, least=15, weight=F.col("w"))
    assert again.trees[0] == model.trees[0]  # however rows are dealt out
    scored = model.score(df).toPandas()
    assert np.allclose(scored.score, 1 / (1 + np.exp(-model.raw(model.bins(np.stack(scored.x))))))
    flat = boosting.fit_boosted(df.filter("y = 1"), trees=2)
    assert flat.trees == [] and set(flat.score(df).toPandas().score) == {0.5}
    assert boosting.fit_boosted(df.limit(0), trees=2).trees == []


def test_edges_of_few_and_many_values(spark):
    df = spark.range(5000).select(F.array((F.col("id") % 4).cast("double"), (F.col("id") * 1.5), F.lit(7.0)).alias("x"))
    few, many, one = boosting.quantile_edges(df)
    assert few.tolist() == [0.5, 1.5, 2.5] and len(one) == 0 and 200 < len(many) <= 254
    counts = np.bincount(np.searchsorted(many, np.arange(5000) * 1.5))
    assert counts.max() < 3 * 5000 / 255


def test_perceptron_gradient_and_fit(spark):
    rng = np.random.default_rng(1)
    n, d, units = 400, 3, 5
    x = rng.normal(0, 1, (n, d))
    y, w = (x[:, 0] * x[:, 1] > 0).astype(float), 1 + rng.random(n)
    flat = rng.normal(0, 1, (d + 1) * units + units + 1)
    loss, slope = perceptron.loss_and_gradient(flat, x, y, w, units)
    for k in range(0, len(flat), 3):
        step = np.zeros(len(flat))
        step[k] = 1e-6
        up, down = (perceptron.loss_and_gradient(flat + s * step, x, y, w, units)[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - slope[k]) < 1e-3 * max(1, abs(slope[k]))
    df = spark.createDataFrame([(r.tolist(), float(t), float(v)) for r, t, v in zip(x, y, w, strict=True)], "x array<double>, y double, w double")
    total, g = perceptron.summed(df.repartition(20), flat, np.zeros(d), np.ones(d), units)
    assert abs(total - loss) < 1e-6 * loss and np.allclose(g, slope, rtol=1e-6, atol=1e-6)
    model = perceptron.fit_perceptron(df, units=16, steps=60, weight=F.col("w"))
    assert metrics.auc(model.score(df), []).first()["auc"] > 0.97  # no linear head can tell these classes apart
    rosen = lambda v: (float((1 - v[0]) ** 2 + 100 * (v[1] - v[0] ** 2) ** 2), np.array([-2 * (1 - v[0]) - 400 * v[0] * (v[1] - v[0] ** 2), 200 * (v[1] - v[0] ** 2)]))
    assert np.allclose(perceptron.minimise(rosen, np.array([-1.2, 1.0]), 200, tol=1e-12), [1, 1], atol=1e-3)


def test_calibration_folds(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(s), int(rng.random() < 1 / (1 + np.exp(-4 * s + 1)))) for i, s in enumerate(rng.normal(0, 1, 600))]
    df = spark.createDataFrame(rows, "id long, score double, y int")
    k = calibration.n_folds(df)
    parts = calibration.dealt(df, "id", k)
    assert k == 5 and {(r["fold"], r["y"]): r["count"] for r in parts.groupBy("fold", "y").count().collect()}.keys() == {(f, y) for f in range(5) for y in (0, 1)}
    found = calibration.fit_folds(parts)
    pdf = parts.toPandas()
    for fold, a, b in found:  # the slope of each fold's loss is 0
        own = pdf[pdf.fold == fold]
        t = np.where(own.y == 1, (own.y.sum() + 1) / (own.y.sum() + 2), 1 / ((1 - own.y).sum() + 2))
        g = 1 / (1 + np.exp(-(a * own.score + b))) - t
        assert abs(g.sum()) < 1e-5 and abs((g * own.score).sum()) < 1e-5 and 2 < a < 8
    odd = spark.createDataFrame([(1, float("nan")), (2, None), (3, 0.2)], "id long, score double").select(calibration.calibrated(F.col("score"), found).alias("p")).collect()
    assert [r["p"] for r in odd[:2]] == [0.5, 0.5] and 0 < odd[2]["p"] < 1
    assert calibration.n_folds(df.filter("y = 1 or id < 20")) >= 2 and calibration.n_folds(df.filter("y = 1")) == 2

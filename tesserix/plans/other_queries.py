"""Queries that SQL can't express (images, fitted heads, streams): checked by tests, and by rows only in the driver's comparison."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tesserix.functions.scalars import platt
from tesserix.operators import heads, images, metrics, sampling
from tesserix.plans.base import FEATURES, query
from tesserix.sources.relations import features, scored_views
from tesserix.streaming import quotas


@query("WITH e AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type) AS r FROM events) SELECT event_type, least(count(*), 40)::BIGINT AS n FROM e GROUP BY event_type")
def stream_quota_fill(spark, d):
    """ST3: a keyed quota of 40 over the event stream."""
    events = quotas.table_stream(spark, d, "events")
    kept = quotas.run_to_table(quotas.fill_quotas(events, "event_type", 40, ["event_id"]), "stream-quota")
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sha256(coalesce(text, '')) AS sha256, count(DISTINCT 1)::BIGINT AS n FROM documents GROUP BY 1")
def stream_content_once(spark, d):
    """ST1 ST2 S5 D16: each content once, however often it comes."""
    docs = quotas.table_stream(spark, d, "documents")
    return quotas.run_to_table(quotas.once_by_content(docs).select("sha256"), "stream-once").groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))


@query(doubles=("auc",))
def cross_validated_head(spark, d):
    """A logistic head on features, grouped folds, out-of-fold AUC."""
    f = features(spark, d)
    rows = f.join(sampling.group_folds(f, "grp", 3).select("grp", "fold"), "grp").select("grp", "view_idx", "x", "y", "sid", "fold")
    return metrics.auc(heads.cross_validated(rows, 3, c=0.1), [])


@query(doubles=("auc",))
def branch_ablation(spark, d):
    """Heads on slices."""
    f = features(spark, d)
    rows = f.join(sampling.group_folds(f, "grp", 2).select("grp", "fold"), "grp").select("x", "y", "sid", "fold")
    return heads.branch_ablation(rows, 2, {"first": [(0, 32)], "last": [(32, 64)], "both": [(0, 16), (48, 64)]})


@query(doubles=("mean_score", "mean_calibrated"))
def platt_calibration(spark, d):
    """M7: a sigmoid fitted to scores."""
    sv = scored_views(spark, d).withColumn("score", F.col("score_b"))
    a, b = heads.fit_platt(sv)
    return sv.withColumn("p", platt(F.col("score"), a, b)).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg("p").alias("mean_calibrated"))


@query(doubles=("blockiness", "laplacian"))
def image_views(spark, d):
    """The table's images under all test conditions, measured."""
    views = images.expand_views(images.block_images(features(spark, d), 32), "v4", "test")
    return images.measured(views, ["img_id", "label", "condition"]).select("img_id", "label", "condition", F.size("forensic").alias("n_forensic"), "blockiness", "laplacian", "dhash", "phash")


def mean_colour(image):
    """A stand-in encoder of three numbers."""
    return image.reshape(-1, 3).mean(0) / 255


@query(doubles=("pred",))
def score_images(spark, d):
    """Directory-style scoring of the table's images with an injected encoder."""
    return images.scored(images.block_images(features(spark, d), 32), ["img_id", "label"], mean_colour, np.array([1.0, -2.0, 0.5]), 0.1)


GREYS = f"{FEATURES}, px AS (SELECT vec_id, i // 8 AS r, i % 8 AS c, greatest(0, least(255, floor((x[i + 1] + 1) * 128)))::BIGINT AS g FROM fv, (SELECT unnest(range(64)) AS i))"


def _greys(spark, d):
    """(vec_id, r, c, g): the pixels of the table's blocks."""
    f = features(spark, d).select("vec_id", F.posexplode("x").alias("i", "v"))
    g = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("v") + 1) * 128))).cast("long")
    return f.select("vec_id", F.floor(F.col("i") / 8).alias("r"), (F.col("i") % 8).alias("c"), g.alias("g"))


@query(
    f"""WITH {GREYS}, s AS (SELECT vec_id, 'h' AS axis, c + 1 AS place, abs(lead(g) OVER (PARTITION BY vec_id, r ORDER BY c) - g) AS d FROM px UNION ALL SELECT vec_id, 'v', r + 1, abs(lead(g) OVER (PARTITION BY vec_id, c ORDER BY r) - g) FROM px)
SELECT vec_id, axis, avg(d) FILTER (place % 4 = 0) - avg(d) FILTER (place % 4 <> 0) AS blockiness, count(d) AS n FROM s GROUP BY vec_id, axis""",
    ("blockiness",),
)
def pixel_blockiness(spark, d):
    """I20 in relational form on the table's blocks, with borders at every fourth step."""
    from pyspark.sql import Window

    g = _greys(spark, d)
    step = lambda axis, at, by: g.select("vec_id", F.lit(axis).alias("axis"), (F.col(at) + 1).alias("at"), F.abs(F.lead("g").over(Window.partitionBy("vec_id", by).orderBy(at)) - F.col("g")).alias("d"))
    s = step("h", "c", "r").unionByName(step("v", "r", "c"))
    border = F.col("at") % 4 == 0
    return s.groupBy("vec_id", "axis").agg((F.avg(F.when(border, F.col("d"))) - F.avg(F.when(~border, F.col("d")))).alias("blockiness"), F.count("d").alias("n"))


@query(
    f"""WITH {GREYS}, q AS (SELECT a.vec_id, a.g AS r, b.g, c.g AS b FROM px a JOIN px b ON a.vec_id = b.vec_id AND a.r = b.r AND a.c = 7 - b.c JOIN px c ON a.vec_id = c.vec_id AND a.c = c.c AND a.r = 7 - c.r)
SELECT vec_id, avg(r) AS mean_r, avg(g) AS mean_g, avg(b) AS mean_b, stddev_pop(r) AS std_r, stddev_pop(g) AS std_g, stddev_pop(b) AS std_b, corr(r, g) AS corr_rg, corr(g, b) AS corr_gb, corr(r, b) AS corr_rb FROM q GROUP BY vec_id""",
    ("mean_r", "mean_g", "mean_b", "std_r", "std_g", "std_b", "corr_rg", "corr_gb", "corr_rb"),
)
def pixel_colour_stats(spark, d):
    """I15's colour part and F8, in relational form, on the table's blocks with mirrored colours."""
    at = lambda r, c: F.get("l", (r * 8 + c).cast("int"))
    f = features(spark, d).select("vec_id", F.transform("x", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v + 1) * 128))).cast("long")).alias("l"))
    r, c = F.floor(F.col("i") / 8), F.col("i") % 8
    q = f.select("vec_id", "l", F.posexplode("l").alias("i", "r")).select("vec_id", "r", at(r, 7 - c).alias("g"), at(7 - r, c).alias("b"))
    guarded = lambda a, b: F.when((F.stddev_pop(a) < 1e-8) | (F.stddev_pop(b) < 1e-8), 0.0).otherwise(F.corr(a, b))
    return q.groupBy("vec_id").agg(*[F.avg(c).alias(f"mean_{c}") for c in "rgb"], *[F.stddev_pop(c).alias(f"std_{c}") for c in "rgb"], guarded("r", "g").alias("corr_rg"), guarded("g", "b").alias("corr_gb"), guarded("r", "b").alias("corr_rb"))

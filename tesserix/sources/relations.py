"""Base relations: scored views, features, manifests and registries, from the driver's tables or from fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserix.runtime import table

#: (name, op, param) in evaluation order: fixed values.
PRESETS = (
    ("clean", None, None), ("jpeg_90", "jpeg", 90.0), ("jpeg_70", "jpeg", 70.0), ("jpeg_50", "jpeg", 50.0), ("jpeg_30", "jpeg", 30.0),
    ("blur_0.5", "blur", 0.5), ("blur_1.0", "blur", 1.0), ("blur_2.0", "blur", 2.0), ("resize_0.5", "resize", 0.5), ("resize_0.25", "resize", 0.25),
    ("noise_0.02", "noise", 0.02), ("noise_0.05", "noise", 0.05), ("noise_0.10", "noise", 0.10), ("jitter_0.20", "jitter", 0.20), ("crop_0.80", "crop", 0.80),
)
#: Ordered redistribution chains: fixed values.
CHAINS = {
    "crop_resize_jpeg": (("crop", 0.8), ("resize", 0.25), ("jpeg", 50.0)),
    "noise_jpeg": (("noise", 0.05), ("jpeg", 50.0)),
    "blur_resize_jpeg": (("blur", 1.0), ("resize", 0.5), ("jpeg", 30.0)),
    "double_repost": (("resize", 0.5), ("jpeg", 70.0), ("resize", 0.5), ("jpeg", 30.0)),
}
PROBES = ("clean", "jpeg_30", "blur_1.0", "resize_0.25", "noise_0.05")
EVERY = tuple(p[0] for p in PRESETS)
#: Conditions by generation and role: fixed values.
ROLE_CONDITIONS = {
    ("v3", "train"): ("clean", "resize_0.25", "jpeg_30", "random_crop_scale_jpeg", "noise_jpeg", "blur_resize_jpeg", "double_repost"),
    ("v3", "cal"): (*PROBES, "crop_resize_jpeg"),
    ("v3", "dev"): (*PROBES, "jitter_0.20", *CHAINS),
    ("v3", "test"): (*EVERY, *CHAINS),
    ("v4", "train"): ("clean", "crop_resize_jpeg"),
    ("v4", "replay"): ("clean", "crop_resize_jpeg"),
    ("v4", "cal"): ("clean", "crop_resize_jpeg"),
    ("v4", "dev"): (*PROBES, "crop_resize_jpeg"),
    ("v4", "test"): (*EVERY, *CHAINS),
}
VIEWS = ("clean", "jpeg", "blur", "resize")


def conditions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, i, op, p) for i, (n, op, p) in enumerate(PRESETS)], "name string, ord int, op string, param double")


def chains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, i, op, p) for n, steps in CHAINS.items() for i, (op, p) in enumerate(steps)], "name string, step int, op string, param double")


def role_conditions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g, r, n, i) for (g, r), names in ROLE_CONDITIONS.items() for i, n in enumerate(names)], "generation string, role string, condition string, ord int")


def scored_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per original (user) and condition (event type), with the scores of two matched models."""
    cells = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("grp"), F.col("event_type").alias("condition")).agg(F.max("value").alias("a"), F.min("value").alias("b"))
    y = F.when(F.col("sid") == 0, 0).otherwise(1)
    return cells.withColumn("sid", (F.col("grp") % 3).cast("int")).withColumn("y", y).select(
        "grp", "condition", F.when(F.col("grp") % 2 == 0, "even").otherwise("odd").alias("domain"), "sid", "y",
        ((F.col("a") + 60 * F.col("y")) / (F.col("a") + 60 * F.col("y") + 50)).alias("score_a"), ((F.col("b") + 3 * F.col("y")) / (F.col("b") + 3 * F.col("y") + 50)).alias("score_b"),
    )


def scored_views_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("grp"), F.concat_ws("_", "l_returnflag", "l_linestatus").alias("condition")).agg(F.max("l_extendedprice").alias("a"))
    y = F.when(F.col("sid") == 0, 0).otherwise(1)
    return cells.withColumn("sid", (F.col("grp") % 3).cast("int")).withColumn("y", y).select("grp", "condition", "sid", "y", ((F.col("a") + 20000 * F.col("y")) / (F.col("a") + 20000 * F.col("y") + 50000)).alias("score_a"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four views per original; x is a vector of 64 numbers."""
    grp, view = F.floor(F.col("vec_id") / 4).cast("long"), (F.col("vec_id") % 4).cast("int")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", grp.alias("grp"), view.alias("view_idx"), F.col("embedding").cast("array<double>").alias("x"))
    return rows.withColumn("condition", F.element_at(F.array(*map(F.lit, VIEWS)), F.col("view_idx") + 1)).withColumn("sid", (F.col("grp") % 3).cast("int")).withColumn("y", F.when(F.col("sid") == 0, 0).otherwise(1))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as originals: sha (content), role by a hash rank, domain, model, sid."""
    from tesserix.functions.hashing import stable_hash

    h = stable_hash("role", F.col("doc_id")) % 10
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("doc_id").alias("ord"), F.sha2("text", 256).alias("sha"), F.col("lang").alias("domain"), F.col("source").alias("model"), (F.col("doc_id") % 3).cast("int").alias("sid"),
        F.when(h < 6, "train").when(h < 7, "cal").when(h < 8, "dev").otherwise("test").alias("role"),
    )

"""Quotas, hash-ranked samples, folds and shards. Draws depend on a seed and an identifier alone, so they repeat anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserix.functions.hashing import stable_hash, unit_hash
from tesserix.operators.metrics import cumulative


def sid_quotas(n: int) -> dict[int, int]:
    """Per binary class n: real n, synthetic half of it (at least 1), tampered the rest (at least 1)."""
    synthetic = max(1, n // 2)
    return {0: n, 1: synthetic, 2: max(1, n - synthetic)}


def quota_table(spark, per_binary: list[int]) -> DataFrame:
    return spark.createDataFrame([(n, s, q) for n in per_binary for s, q in sid_quotas(n).items()], "per_binary int, sid int, quota int")


def with_quotas(df: DataFrame, per_binary: str) -> DataFrame:
    """df with a row per sid and its quota: all for real ones, half (at least 1) for synthetic ones, what is left (at least 1) for tampered ones."""
    n = F.col(per_binary)
    half = F.greatest(F.lit(1), F.floor(n / 2).cast("int"))
    return df.select("*", F.posexplode(F.array(n.cast("int"), half, F.greatest(F.lit(1), n.cast("int") - half))).alias("sid", "quota"))


def first_n(df: DataFrame, by: list[str], order: list, n) -> DataFrame:
    """The first n rows of each `by`; n may be a column. Spark limits ranks before the shuffle where n is a number."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def balanced_slice(df: DataFrame, m: int | None, label: str = "label", order: str = "ord") -> DataFrame:
    """In input order: half of m (at least 1) with label 0, the rest (at least 1) with label 1; everything if m is 0 or None."""
    if not m:
        return df
    n0 = max(1, m // 2)
    w = Window.partitionBy(label).orderBy(order)
    ranked = df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= max(n0, max(1, m - n0)))
    return ranked.filter(F.col("__rank") <= F.when(F.col(label) == 0, n0).otherwise(max(1, m - n0))).drop("__rank")


def hash_sample(df: DataFrame, by: list[str], key: str, n: int, seed: str) -> DataFrame:
    """n rows of each stratum, those with the smallest hashes."""
    return first_n(df.withColumn("__h", stable_hash(seed, F.col(key))), by, ["__h", key], n).drop("__h", "rank")


def hash_ranks(df: DataFrame, by: list[str], key: str, seed: str) -> DataFrame:
    """rank (from 1) and n per stratum in hash order, by cumulative counts rather than one sort per stratum. key is unique."""
    rows = df.withColumn("__u", unit_hash(seed, F.col(key)))
    at = cumulative(rows, by, "__u", {"c": F.lit(1)}).select(*by, "__u", (F.col("c_below") + 1).alias("rank"), F.col("c_all").alias("n"))
    return rows.join(at, [*by, "__u"]).drop("__u")


def stratified_halves(df: DataFrame, by: list[str], key: str, seed: str) -> DataFrame:
    """half: 0 for the first half of each stratum (rounded down) in hash order, else 1."""
    return hash_ranks(df, by, key, seed).withColumn("half", F.when(F.col("rank") * 2 <= F.col("n"), 0).otherwise(1)).drop("rank", "n")


def cal_test_split(df: DataFrame, key: str, fraction: float, seed: str) -> DataFrame:
    """part: cal for a fraction of all rows in hash order (at least 1 row on either side), else test."""
    n_cal = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(F.col("n") * fraction)))
    return hash_ranks(df.withColumn("__all", F.lit(0)), ["__all"], key, seed).withColumn("part", F.when(F.col("rank") <= n_cal, "cal").otherwise("test")).drop("rank", "n", "__all")


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """A fold per group: groups with most views first, dealt in turn, so that folds are alike in views. Ranks are prefix sums over
    the few distinct view counts plus a rank inside each in hash order, by cumulative counts, as all groups may have the same number of views."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_views"))
    by_size = sizes.groupBy("n_views").agg(F.count(F.lit(1)).alias("m"))
    before = Window.orderBy(F.desc("n_views")).rowsBetween(Window.unboundedPreceding, -1)
    base = by_size.select("n_views", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    inside = hash_ranks(sizes, ["n_views"], group, "folds").withColumn("__r", F.col("rank") - 1)
    return inside.join(F.broadcast(base), "n_views").select(group, "n_views", F.pmod(F.col("base") + F.col("__r"), F.lit(k)).cast("int").alias("fold"))


def quota_fill(df: DataFrame, quotas: DataFrame, key: str, order: str, content: str) -> tuple[DataFrame, DataFrame]:
    """Fill quotas in order after dropping repeated content: the accepted rows, and the shortfall per key. quotas (key, quota): few rows.

    The largest quota limits ranks as a number first, which Spark does in every task before the shuffle."""
    most = quotas.agg(F.max("quota")).first()[0] or 0
    unique = df.join(F.broadcast(quotas), key).withColumn("__first", F.row_number().over(Window.partitionBy(content).orderBy(order))).filter("__first = 1").drop("__first")
    got = unique.withColumn("slot", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("slot") <= most).filter(F.col("slot") <= F.col("quota"))
    short = quotas.join(got.groupBy(key).agg(F.count(F.lit(1)).alias("filled")), key, "left").select(key, "quota", F.coalesce("filled", F.lit(0)).alias("filled")).withColumn("short", F.col("quota") - F.col("filled"))
    return got, short


def roles_by_quota(df: DataFrame, by: str, order: str, quotas: list[tuple[str, int]]) -> DataFrame:
    """The i-th row of each `by` gets the first role whose cumulative quota covers i; rows beyond all quotas are left out."""
    w, total, role = Window.partitionBy(by).orderBy(order), 0, F.lit(None).cast("string")
    cuts = []
    for name, q in quotas:
        total += q
        cuts.append((total, name))
    for cut, name in reversed(cuts):
        role = F.when(F.col("slot") <= cut, name).otherwise(role)
    return df.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= total).withColumn("role", role)


def contiguous_shards(df: DataFrame, order: str, total: int, n: int) -> DataFrame:
    """shard i holds ordinals from floor(i total / n) up to floor((i + 1) total / n)."""
    return df.withColumn("shard", F.least(F.lit(n - 1), F.floor((F.col(order) * n + n - 1) / total)).cast("int")).withColumn(
        "shard", F.when(F.floor(F.col("shard") * total / n) > F.col(order), F.col("shard") - 1).otherwise(F.col("shard")).cast("int")
    )

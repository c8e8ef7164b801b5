"""Report tables: comparisons, merges with completeness checks, error lists, ablation matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compare(base: DataFrame, cand: DataFrame, key: str = "transform") -> DataFrame:
    """Base and candidate rows of a key side by side: deltas, and whether the AUC intervals are disjoint."""
    b = base.select(key, *[F.col(c).alias(f"{c}_base") for c in ("ord", "auc", "auc_lo", "auc_hi", "acc")])
    c = cand.select(key, *[F.col(x).alias(f"{x}_cand") for x in ("auc", "auc_lo", "auc_hi", "acc")])
    apart = (F.col("auc_lo_cand") > F.col("auc_hi_base")) | (F.col("auc_lo_base") > F.col("auc_hi_cand"))
    return b.join(c, key).select(key, F.col("ord_base").alias("ord"), "auc_base", "auc_cand", (F.col("auc_cand") - F.col("auc_base")).alias("delta_auc"), "acc_base", "acc_cand", (F.col("acc_cand") - F.col("acc_base")).alias("delta_acc"), apart.alias("ci_disjoint"))


def compare_summary(rows: DataFrame, key: str = "transform") -> DataFrame:
    """From compare(): clean delta, mean delta of the other rows, worst AUCs, separated gains and losses, best and worst row, verdict."""
    other, d = F.col(key) != "clean", F.col("delta_auc")
    out = rows.agg(
        F.max(F.when(~other, d)).alias("clean_delta"), F.avg(F.when(other, d)).alias("mean_delta"), F.min(F.when(other, F.col("auc_base"))).alias("worst_base"), F.min(F.when(other, F.col("auc_cand"))).alias("worst_cand"),
        F.sum((F.col("ci_disjoint") & (d > 0)).cast("long")).alias("n_gains"), F.sum((F.col("ci_disjoint") & (d < 0)).cast("long")).alias("n_losses"),
        F.max(F.when(other, F.struct(d, F.col(key)))).alias("best"), F.min(F.when(other, F.struct(d, F.col(key)))).alias("worst"),
    )
    return out.select("clean_delta", "mean_delta", "worst_base", "worst_cand", "n_gains", "n_losses", F.col(f"best.{key}").alias("best_row"), F.col(f"worst.{key}").alias("worst_row"), F.when(F.col("mean_delta") > 0.002, "better").when(F.col("mean_delta") < -0.002, "worse").otherwise("level").alias("verdict"))


def keep_last(parts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return parts.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def merge_shards(parts: list[DataFrame], registry: DataFrame, key: str = "transform") -> tuple[DataFrame, DataFrame]:
    """One table from shards (the last row of a key wins; columns that old shards lack are null), with the registry's order, and the
    registry's keys that are missing. Rows outside the registry are dropped."""
    rows = None
    for i, p in enumerate(parts):
        p = p.withColumn("__part", F.lit(i))
        rows = p if rows is None else rows.unionByName(p, allowMissingColumns=True)
    rows = rows.withColumn("__row", F.coalesce(F.col("row"), F.lit(0))) if "row" in rows.columns else rows.withColumn("__row", F.lit(0))
    last = keep_last(rows, [key], ["__part", "__row"]).drop("__part", "__row")
    reg = registry.select(F.col("name").alias(key), "ord")
    return last.join(F.broadcast(reg), key), reg.join(last, key, "left_anti")


def missing_cells(rows: DataFrame, heads: list[str], key: str = "transform", head: str = "head") -> DataFrame:
    """(key, head) cells that are missing for keys that occur at all."""
    want = rows.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, heads))).alias(head))
    return want.join(rows.select(key, head).distinct(), [key, head], "left_anti")


def ablation_matrix(rows: DataFrame, key: str = "transform", head: str = "head") -> DataFrame:
    """Per head without clean: mean AUC, the worst row and its AUC (the first by order on ties)."""
    return rows.filter(F.col(key) != "clean").groupBy(head).agg(F.avg("auc").alias("mean_auc"), F.min(F.struct("auc", "ord", F.col(key).alias("t"))).alias("w"), F.count(F.lit(1)).alias("n_rows")).select(head, "mean_auc", F.col("w.t").alias("worst_row"), F.col("w.auc").alias("worst_auc"), "n_rows")


def headline(rows: DataFrame, key: str = "transform") -> DataFrame:
    """Clean AUC, mean and worst of the other rows, their deltas against clean, mean TPR at 1 % FPR."""
    other = F.col(key) != "clean"
    out = rows.agg(F.max(F.when(~other, F.col("auc"))).alias("clean_auc"), F.avg(F.when(other, F.col("auc"))).alias("mean_auc"), F.min(F.when(other, F.struct("auc", key))).alias("w"), F.avg(F.when(other, F.col("tpr_at_1fpr"))).alias("mean_tpr_at_1fpr"))
    return out.select("clean_auc", "mean_auc", F.col("w.auc").alias("worst_auc"), F.col(f"w.{key}").alias("worst_row"), (F.col("mean_auc") - F.col("clean_auc")).alias("mean_delta"), (F.col("w.auc") - F.col("clean_auc")).alias("worst_delta"), "mean_tpr_at_1fpr")


def deltas_to(rows: DataFrame, by: str, condition: str, reference: str = "clean", value: str = "auc") -> DataFrame:
    """value minus the reference condition's, per `by`."""
    ref = rows.filter(F.col(condition) == reference).select(by, F.col(value).alias("control"))
    return rows.filter(F.col(condition) != reference).join(ref, by).select(by, condition, value, "control", (F.col(value) - F.col("control")).alias("delta"))


def top_errors(df: DataFrame, kinds: dict[str, tuple[Column, Column]], group: str, k: int, keep: list[str]) -> DataFrame:
    """Per kind the k worst distinct originals. kinds: name -> (which rows, sort key ascending). An original's worst row stands for it;
    it is a partial minimum before the shuffle."""
    entries = F.array(*[F.when(mask, F.struct(F.lit(name).alias("kind"), key.cast("double").alias("key"))) for name, (mask, key) in kinds.items()])
    rows = df.select(*keep, F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select(*keep, "e.kind", "e.key")
    others = [c for c in keep if c != group]
    best = rows.groupBy("kind", group).agg(F.min(F.struct("key", *others)).alias("m")).select("kind", group, "m.*")
    w = Window.partitionBy("kind").orderBy("key", group)
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("kind", "rank", *keep)


def error_counts(df: DataFrame, kinds: dict[str, Column], group: str) -> DataFrame:
    """Per kind: views in error and distinct originals."""
    entries = F.array(*[F.when(mask, F.lit(name)) for name, mask in kinds.items()])
    rows = df.select(group, F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("kind"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("view_errors"), F.countDistinct(group).alias("distinct_originals"))


def shard_gaps(shards: DataFrame, total: int) -> DataFrame:
    """shards (start, rows): what is wrong with the cover of 0..total: gap, overlap or short rows; empty if nothing is. Shards are few."""
    w = Window.orderBy("start", "rows")
    s = shards.withColumn("expected", F.coalesce(F.lag(F.col("start") + F.col("rows")).over(w), F.lit(0)))
    bad = s.filter(F.col("start") != F.col("expected")).select("start", "expected", F.when(F.col("start") > F.col("expected"), "gap").otherwise("overlap").alias("problem"))
    end = shards.agg(F.coalesce(F.max(F.col("start") + F.col("rows")), F.lit(0)).alias("start")).filter(F.col("start") != total).select("start", F.lit(total).cast("long").alias("expected"), F.lit("short").alias("problem"))
    return bad.select(F.col("start").cast("long"), F.col("expected").cast("long"), "problem").unionByName(end.select(F.col("start").cast("long"), "expected", "problem"))


def replace_section(text: Column, name: str, body: str) -> Column:
    """The text between the markers of a section, replaced."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    return F.concat(F.substring_index(text, start, 1), F.lit(f"{start}\n{body}\n{end}"), F.substring_index(text, end, -1))

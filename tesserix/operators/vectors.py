"""Vector columns: slices, compositions, pooled and weighted statistics, consistency rows, view blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserix.functions.hashing import let
from tesserix.functions.scalars import is_finite, norm, normalised
from tesserix.operators.metrics import one_label

#: start and stop (0-based, stop excluded) of the feature branches of the 924-wide vector: fixed values.
BRANCHES = {"clip": (0, 512), "dino": (512, 896), "forensic": (896, 924)}


def checked(x: Column, width: int) -> Column:
    """x, or an error if it hasn't this width or isn't finite."""
    bad = (F.size(x) != width) | ~F.forall(x, is_finite)
    return F.when(~bad, x).otherwise(F.raise_error(F.concat(F.lit(f"expected {width} finite numbers, got a vector of "), F.size(x).cast("string"))))


def cut(x: Column, start: int, stop: int) -> Column:
    return F.slice(x, start + 1, stop - start)


def padded(x: Column, width: int, to: int) -> Column:
    return F.concat(checked(x, width), F.array_repeat(F.lit(0.0), to - width))


def fused(*parts: Column) -> Column:
    return F.concat(*parts)


def group_means(df: DataFrame, group: str = "grp", x: str = "x", y: str = "y") -> DataFrame:
    """Long form (group, pos, y, mean): means are partial sums before the shuffle, keyed by position too."""
    rows = df.select(group, y, F.posexplode(x).alias("pos", "v"))
    return rows.groupBy(group, "pos").agg(one_label(y).alias("y"), F.avg("v").alias("mean"))


def as_vectors(long: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Long form back to arrays, in order of position."""
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda s: s[value]).alias("x"))


def corner_summary(df: DataFrame, group: str = "grp", x: str = "x") -> DataFrame:
    """Population deviation and maximum over a group's vectors, per position."""
    return df.select(group, F.posexplode(x).alias("pos", "v")).groupBy(group, "pos").agg(F.stddev_pop("v").alias("std"), F.max("v").alias("top"))


def pooled_tokens(df: DataFrame, group: str = "grp", x: str = "x") -> DataFrame:
    """Of normalised tokens, per position: population deviation and largest distance from the mean."""
    rows = df.select(group, F.posexplode(normalised(F.col(x))).alias("pos", "v"))
    stats = rows.groupBy(group, "pos").agg(F.stddev_pop("v").alias("std"), F.avg("v").alias("m"), F.max("v").alias("hi"), F.min("v").alias("lo"))
    return stats.select(group, "pos", "std", F.greatest(F.col("hi") - F.col("m"), F.col("m") - F.col("lo")).alias("max_dev"))


def tta_mean(df: DataFrame, group: str = "grp", x: str = "x") -> DataFrame:
    """Mean of the unit vectors of a group's views, normalised again; (group, x)."""
    long = df.select(group, F.posexplode(normalised(F.col(x))).alias("pos", "v")).groupBy(group, "pos").agg(F.avg("v").alias("v"))
    return as_vectors(long, [group], "v").withColumn("x", normalised(F.col("x")))


def original_weights(df: DataFrame, group: str = "grp", stratum: Column | None = None) -> DataFrame:
    """A view's weight: 1 / originals in its stratum / views of its original, scaled to mean 1. One row per original and its n_views."""
    s = stratum if stratum is not None else F.concat_ws(":", "domain", "sid")
    per = df.withColumn("stratum", s).groupBy(group).agg(F.count(F.lit(1)).alias("n_views"), F.min("stratum").alias("stratum"))
    sizes = per.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_originals"), F.sum("n_views").alias("views"))
    # weights sum to 1 in each stratum, so the mean is strata over views
    every = Window.partitionBy()
    sizes = sizes.withColumn("mean", F.count(F.lit(1)).over(every) / F.sum("views").over(every))
    return per.join(F.broadcast(sizes), "stratum").select(group, "stratum", "n_views", (1 / F.col("n_originals") / F.col("n_views") / F.col("mean")).alias("weight"))


def class_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """n / (2 x rows of the class)."""
    c = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    return c.select(y, "n", (F.sum("n").over(Window.partitionBy()) / (2 * F.col("n"))).alias("weight"))


def tampered_weight(sid: Column, weight: float = 5.0) -> Column:
    return F.when(sid == 2, weight).otherwise(1.0)


def consistency_rows(df: DataFrame, group: str = "grp", order: str = "view_idx", x: str = "x", y: str = "y") -> DataFrame:
    """For each view but the first of a group: the mean of it and the first; labels are the group's (an error if they differ)."""
    first = df.groupBy(group).agg(one_label(y).alias("__y"), F.min_by(x, order).alias("__x"), F.min(order).alias("__o"))
    rows = df.join(first, group).filter(F.col(order) > F.col("__o"))
    return rows.select(group, order, F.col("__y").alias(y), F.zip_with(x, "__x", lambda a, b: (a + b) / 2).alias(x))


def with_consistency(df: DataFrame, group: str = "grp", order: str = "view_idx", x: str = "x", y: str = "y") -> DataFrame:
    base = df.select(group, order, y, x, F.lit("view").alias("kind"))
    return base.unionByName(consistency_rows(df, group, order, x, y).withColumn("kind", F.lit("consistency")))


def merge_extra_views(base: DataFrame, extra: DataFrame, group: str = "grp", order: str = "view_idx", x: str = "x", y: str = "y", partial: bool = False) -> DataFrame:
    """Put one more view per original into its block: the next free index. Labels, widths and originals must agree. partial: an original without an extra view
    keeps its block as it is; extra views of unknown originals stay an error."""
    last = base.groupBy(group).agg(F.max(order).alias("__last"), one_label(y).alias("__y"), F.max(F.size(x)).alias("__w"))
    both = extra.select(group, F.col(y).alias("__ey"), F.col(x).alias("__ex")).join(last, group, "left" if partial else "full_outer")
    why = F.when(F.col("__last").isNull() | F.col("__ex").isNull(), "the extra views cover other originals").when(F.col("__ey") != F.col("__y"), "labels don't line up").when(F.size("__ex") != F.col("__w"), "widths differ")
    added = both.select(group, (F.col("__last") + 1).alias(order), F.when(why.isNull(), F.col("__y")).otherwise(F.raise_error(why)).alias(y), F.col("__ex").alias(x))
    return base.select(group, order, y, x).unionByName(added)


def scale_stats(df: DataFrame, x: str = "x", weight: Column | None = None) -> DataFrame:
    """Per position: mean and population deviation, weighted or not, by sums of powers."""
    w = F.lit(1.0) if weight is None else weight
    rows = df.withColumn("__w", w).select("__w", F.posexplode(x).alias("pos", "v"))
    s = rows.groupBy("pos").agg(F.sum("__w").alias("sw"), F.sum(F.col("__w") * F.col("v")).alias("s1"), F.sum(F.col("__w") * F.col("v") * F.col("v")).alias("s2"))
    mean = F.col("s1") / F.col("sw")
    return s.select("pos", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("sw") - mean * mean)).alias("std"))


def vector_norm(x: Column) -> Column:
    return norm(x)


def mean_of(views: Column, width: int) -> Column:
    """Element-wise mean of an array of vectors."""
    total = lambda vs: F.aggregate(vs, F.array_repeat(F.lit(0.0), width), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return let(views, lambda vs: F.transform(total(vs), lambda t: t / F.size(vs)))


def pooled(tokens: Column, width: int) -> Column:
    """Of an array of token vectors, normalised: population deviation, then largest distance from the mean, per position."""
    def of(t: Column) -> Column:
        def spread(m: Column) -> Column:
            off = F.transform(t, lambda v: F.zip_with(v, m, lambda a, b: a - b))
            return let(off, lambda o: F.concat(
                F.transform(mean_of(F.transform(o, lambda v: F.transform(v, lambda a: a * a)), width), lambda q: F.sqrt(q)),
                F.aggregate(o, F.array_repeat(F.lit(0.0), width), lambda a, v: F.zip_with(a, v, lambda x, y: F.greatest(x, F.abs(y)))),
            ))

        return let(mean_of(t, width), spread)

    return let(F.transform(tokens, normalised), of)


def composed(views: Column, token: Column, patches: Column, forensic: Column, corners: Column, widths: tuple[int, int] = (512, 384)) -> Column:
    """The whole descriptor of an image: the mean of its views' unit vectors, made unit again; the unit class token; the forensic numbers;
    the pooled patch tokens; the corners' summary. widths: of view vectors and of tokens; 512 and 384 give 924 + 824 = 1748 numbers with 28 and 56."""
    clip = let(mean_of(F.transform(views, normalised), widths[0]), normalised)
    whole = F.concat(clip, normalised(token), forensic, pooled(patches, widths[1]), corners)
    return let(whole, lambda z: F.when(F.forall(z, is_finite), z).otherwise(F.raise_error(F.lit("a descriptor must be finite"))))


def cache_rows(manifest: DataFrame, cache: DataFrame, views: int, index: str = "cache_index", row: str = "row") -> DataFrame:
    """Manifest rows beside their rows of a cache that holds `views` rows per original, one after the other: the i-th original's are i views to
    i views + views - 1. A manifest row whose cache rows are missing is an error."""
    want = manifest.withColumn("view_idx", F.explode(F.sequence(F.lit(0), F.lit(views - 1)))).withColumn(row, F.col(index) * views + F.col("view_idx"))
    found = want.join(cache.withColumn("__there", F.lit(True)), row, "left")
    return found.withColumn(row, F.when(F.col("__there"), F.col(row)).otherwise(F.raise_error(F.lit("a cache row is missing")))).drop("__there")

"""Bootstrap intervals of AUC by shared draws: originals are drawn with replacement per class, and all models and conditions reuse
the draws. Draws are hashes of (seed, repetition, slot), so they need no state and repeat on any cluster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserix.operators.sampling import hash_ranks
from tesserix.runtime import saved

REPS = 2000
#: Repetitions that are counted side by side (256 at most), a byte each.
TOGETHER = 200
#: Slots of a label whose draws are counted together; rows of a part of the order; draws that a task makes and that it packs at once.
SLOTS, PART_ROWS, TASK_DRAWS = 1 << 14, 1 << 14, 1 << 21


def ordinals(originals: DataFrame, group: str = "grp") -> DataFrame:
    """Consecutive numbers from 0 per label, in hash order of the group, and the label's size: by cumulative counts, so that no label is one task."""
    return hash_ranks(originals.select(group, "y").distinct(), ["y"], group, "slots").select(group, "y", (F.col("rank") - 1).cast("int").alias("slot"), "n")


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data cut at its ends (counted in items) to binary values."""
    offsets = np.concatenate([[0], ends]).astype(np.int32) * np.int32(data.itemsize)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def draws(originals: DataFrame, reps: int, seed: str, group: str = "grp") -> DataFrame:
    """(block, group, w): how often an original is drawn in each of a block's repetitions, a byte each. Each slot draws one original of its label.

    A draw is four bytes of the only shuffle: draws of a block that hit the same SLOTS slots are packed into one value. Originals that a block doesn't draw have no row in it."""
    own, side = saved(ordinals(originals, group), "boot-slots"), min(TOGETHER, reps)
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("rep").cast("string"), F.col("y").cast("string"), F.col("slot").cast("string"))), 1, 15), 16, 10).cast("long")
    # a slot is a short row, but makes many draws: dealt out by what they take
    dealt = own.repartition(max(1, -(-own.count() * reps // TASK_DRAWS)))
    drawn = dealt.select("y", "slot", "n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    drawn = drawn.select(F.col("y").cast("int").alias("y"), "rep", F.pmod(h, F.col("n").cast("long")).cast("int").alias("slot"))

    def parcel(held):
        y, rep, slot = (np.concatenate([b.column(k).to_numpy() for b in held]).astype(np.int64) for k in range(3))
        blocks, ranges, low = -(-reps // side), int(slot.max()) // SLOTS + 1, int(y.min())
        key = ((y - low) * ranges + slot // SLOTS) * blocks + rep // side
        packed = np.sort(key << 22 | (slot % SLOTS) * side + rep % side)
        key = packed >> 22
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        key = key[ends - 1]
        columns = (key // (blocks * ranges) + low, key // blocks % ranges, key % blocks)
        return pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), _binaries((packed & ((1 << 22) - 1)).astype("<u4"), ends)], ["y", "range", "block", "drawn"])

    def pack(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= TASK_DRAWS:
                yield parcel(held)
                held, n = [], 0
        if n:
            yield parcel(held)

    def counted(t: pa.Table) -> pa.Table:
        counts = np.bincount(np.frombuffer(b"".join(t["drawn"].to_pylist()), "<u4"))
        counts = np.pad(counts, (0, -len(counts) % side)).reshape(-1, side)
        if counts.max() > 255:
            raise ValueError("an original is drawn over 255 times")
        hit = np.flatnonzero(counts.any(1))
        same = lambda c: pa.array(np.full(len(hit), t[c][0].as_py(), np.int32))
        w = _binaries(counts[hit].astype(np.uint8).reshape(-1), np.arange(1, len(hit) + 1) * side)
        return pa.table([same("y"), same("block"), pa.array((t["range"][0].as_py() * SLOTS + hit).astype(np.int32)), w], ["y", "block", "slot", "w"])

    packed = drawn.mapInArrow(pack, "y int, range int, block int, drawn binary")
    counts = packed.groupBy("y", "range", "block").applyInArrow(counted, "y int, block int, slot int, w binary")
    return counts.join(own.select("y", "slot", group), ["y", "slot"]).select("block", group, "w")


def _in_parts(rows: DataFrame, keys: list[str], group: str) -> DataFrame:
    """rows with __part, __tie, __seg and __open: parts of some PART_ROWS rows in the order of keys and score, however many rows have one score.

    __tie numbers a part's different scores. A segment is what a part holds of one key; a score that goes on in the next part is a segment of its own (__open)."""
    order = [*keys, "score"]
    rows = saved(rows.withColumn("score", F.col("score").cast("double") + F.lit(0.0)), "boot-rows")
    placed = rows.repartitionByRange(max(1, -(-rows.count() // PART_ROWS)), *order, group).withColumn("__part", F.spark_partition_id())
    placed, here = saved(placed, "boot-parts"), F.struct(*order)
    # a row a part
    by, ends = Window.orderBy("__part"), placed.groupBy("__part").agg(F.min(here).alias("__lo"), F.max(here).alias("__hi"))
    ends = ends.select("*", F.lag("__hi").over(by).eqNullSafe(F.col("__lo")).alias("__from"), F.lead("__lo").over(by).eqNullSafe(F.col("__hi")).alias("__on"))
    at = F.when(F.col("__from") & here.eqNullSafe(F.col("__lo")), 0).when(F.col("__on") & here.eqNullSafe(F.col("__hi")), 2).otherwise(1)
    every = Window.partitionBy("__part")
    told = placed.join(F.broadcast(ends), "__part").withColumn("__at", at)
    told = told.select(*rows.columns, "__part", F.dense_rank().over(every.orderBy(*order)).alias("__tie"), F.dense_rank().over(every.orderBy(*keys, "__at")).alias("__seg"), (F.col("__at") != 1).alias("__open"))
    return saved(told, "boot-order")


def bootstrap_aucs(df: DataFrame, keys: list[str], scores: list[str], reps: int, seed: str, group: str = "grp") -> DataFrame:
    """(keys, rep, model, auc): every model on the same draws; an original's draws count in all its conditions.

    Rows are put in order once. A part of the order and a block of repetitions are summed up in arrays, a row read once a block; what comes out, a few sums
    for each segment of a part, is put together by prefix sums over the segments."""
    weights, side = draws(df, reps, seed, group), min(TOGETHER, reps)
    models = F.explode(F.map_from_arrays(F.array(*map(F.lit, scores)), F.array(*scores))).alias("model", "score")
    by = [*keys, "model"]
    rows = _in_parts(df.select(group, *keys, "y", models).filter(F.col("score").isNotNull() & F.col("y").isin(0, 1)), by, group)

    def summed(t: pa.Table) -> pa.Table:
        tie, order = t["__tie"].to_numpy(), np.argsort(t["__tie"].to_numpy(), kind="stable")
        w = np.frombuffer(b"".join(t["w"].to_pylist()), np.uint8).reshape(-1, side)[order]
        tie, seg, one = tie[order], t["__seg"].to_numpy()[order], (t["y"].to_numpy()[order] == 1)[:, None]
        first = np.concatenate([[0], np.flatnonzero(tie[1:] != tie[:-1]) + 1])
        p, n = (np.add.reduceat((w * mine).astype(np.int64), first, axis=0) for mine in (one, ~one))
        seg = seg[first]
        cuts = [0, *(np.flatnonzero(seg[1:] != seg[:-1]) + 1).tolist(), len(seg)]
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            low = n[a:b].cumsum(0) - n[a:b]
            out.append((p[a:b].sum(0), n[a:b].sum(0), (p[a:b] * (2 * low + n[a:b])).sum(0)))
        offsets = np.arange(len(out) + 1, dtype=np.int32) * side
        sums = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(x))) for x in zip(*out, strict=True)]
        same = lambda c: pa.array(np.full(len(out), t[c][0].as_py(), np.int32))
        return pa.table([same("__part"), same("block"), pa.array(seg[cuts[:-1]].astype(np.int32)), *sums], ["__part", "block", "__seg", "p", "n", "s"])

    wide = rows.select(group, "__part", "__seg", "__tie", "y").join(weights, group)
    sums = wide.groupBy("__part", "block").applyInArrow(summed, "__part int, block int, __seg int, p array<long>, n array<long>, s array<long>")
    segments = rows.groupBy("__part", "__seg", "__open", *by).agg(F.min("score").alias("__start"))
    each = sums.join(segments, ["__part", "__seg"]).select(*by, "__start", "__open", "block", F.posexplode(F.arrays_zip("p", "n", "s")).alias("at", "v"))
    each = each.withColumn("rep", F.col("block") * side + F.col("at")).filter(F.col("rep") < reps)
    each = each.groupBy(*by, "rep", "__start", "__open").agg(*[F.sum(f"v.{c}").alias(c) for c in "pns"]).withColumn("s", F.when(F.col("__open"), F.col("p") * F.col("n")).otherwise(F.col("s")))
    low = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "rep").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = F.sum("p").cast("double") * F.sum("n")
    found = each.withColumn("low", low).groupBy(*by, "rep").agg(F.when(pairs > 0, F.sum(F.col("s") + 2 * F.col("p") * F.col("low")) / (2 * pairs)).alias("auc"))
    return found.select(*keys, "rep", "model", "auc")


def percentile_interval(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    g = df.groupBy(*keys) if keys else df.groupBy()
    return g.agg(q.alias("__q"), F.count(value).alias("reps")).withColumn("lo", F.get("__q", 0)).withColumn("hi", F.get("__q", 1)).drop("__q")


def auc_interval(df: DataFrame, keys: list[str], scores: list[str], reps: int = REPS, seed: str = "auc") -> DataFrame:
    return percentile_interval(bootstrap_aucs(df, keys, scores, reps, seed), [*keys, "model"], "auc")


def paired_interval(df: DataFrame, keys: list[str], a: str, b: str, reps: int = REPS, seed: str = "paired") -> DataFrame:
    """Interval of AUC(b) - AUC(a) on the same draws."""
    d = bootstrap_aucs(df, keys, [a, b], reps, seed).groupBy(*keys, "rep").agg((F.max(F.when(F.col("model") == b, F.col("auc"))) - F.max(F.when(F.col("model") == a, F.col("auc")))).alias("delta"))
    return percentile_interval(d, keys, "delta")


def block_interval(df: DataFrame, condition: str, a: str, b: str, reps: int = REPS, seed: str = "block") -> DataFrame:
    """Interval of the mean over conditions of AUC(b) - AUC(a); an original keeps all its conditions when drawn."""
    sign = F.when(F.col("model") == b, F.col("auc")).otherwise(-F.col("auc"))
    d = bootstrap_aucs(df, [condition], [a, b], reps, seed).groupBy("rep", condition).agg(F.sum(sign).alias("d")).groupBy("rep").agg(F.avg("d").alias("delta"))
    return percentile_interval(d, [], "delta")

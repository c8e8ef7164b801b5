"""Receipts, locks, fingerprints and shape guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserix.functions.hashing import canonical_json, fingerprint

REVISION = r"^[0-9a-f]{40}$"


def receipt_mismatches(expected: DataFrame, actual: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """Paths that are missing, unexpected or changed; empty if all digests agree."""
    both = expected.select(key, F.col(digest).alias("expected")).join(actual.select(key, F.col(digest).alias("actual")), key, "full_outer")
    return both.filter(~F.col("expected").eqNullSafe(F.col("actual"))).withColumn("problem", F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").otherwise("changed"))


def locked(df: DataFrame, expected: DataFrame, actual: DataFrame) -> DataFrame:
    """df, if the receipts agree; else an error before any of its rows is read."""
    bad = receipt_mismatches(expected, actual).limit(3).collect()
    if bad:
        raise ValueError(f"the lock doesn't hold: {[r['path'] for r in bad]}")
    return df


def locked_parts(df: DataFrame, expected: DataFrame, actual: DataFrame, part: str, key: str = "path", digest: str = "sha256") -> DataFrame:
    """Rows of the parts whose receipts agree in every path; a part with a missing, unexpected or changed path gives none."""
    side = lambda rows, name: rows.select(part, key, F.col(digest).alias(name))
    both = side(expected, "expected").join(side(actual, "actual"), [part, key], "full_outer")
    bad = both.filter(~F.col("expected").eqNullSafe(F.col("actual"))).select(part).distinct()
    return df.join(bad, part, "left_anti")


def packaging_mismatches(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows whose values differ, or that only one side has."""
    both = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys, "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b")))


def grid_problems(df: DataFrame, group: str, condition: str, n_conditions: int) -> DataFrame:
    """Originals without exactly one row in each of n conditions."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(condition).alias("n_conditions")).filter((F.col("n_rows") != n_conditions) | (F.col("n_conditions") != n_conditions))


def agreeing(df: DataFrame, version: str) -> DataFrame:
    """df, if all its rows carry one version; else an error."""
    seen = df.agg(F.countDistinct(version).alias("n")).first()["n"]
    if seen > 1:
        raise ValueError(f"{seen} versions of {version}")
    return df


def valid_snapshots(m: Column) -> Column:
    """A map of revisions: not empty, each a 40-digit hexadecimal number."""
    return (F.size(m) > 0) & F.forall(F.map_values(m), lambda v: v.rlike(REVISION))


def versioned(df: DataFrame, tag: str, payload: Column, snapshots: Column) -> DataFrame:
    return df.withColumn("snapshots_json", canonical_json(snapshots)).withColumn("fingerprint", fingerprint(tag, payload, snapshots))


def max_drift(a: Column, b: Column, prefix: int) -> Column:
    """Largest change of two vectors beyond a prefix that must be equal; null if the prefix isn't."""
    same = F.slice(a, 1, prefix) == F.slice(b, 1, prefix)
    tail = F.zip_with(F.slice(a, prefix + 1, 1 << 20), F.slice(b, prefix + 1, 1 << 20), lambda x, y: F.abs(x - y))
    return F.when(same & (F.size(a) == F.size(b)), F.coalesce(F.array_max(tail), F.lit(0.0)))


def one_provenance(parts: list[DataFrame], columns: list[str]) -> DataFrame:
    """The parts in one table, if all their rows carry the same values in columns (snapshots, fingerprints); else an error."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    seen = rows.select(*columns).distinct().limit(2).count()
    if seen > 1:
        raise ValueError(f"the parts differ in {', '.join(columns)}")
    return rows


def provenance_by(df: DataFrame, by: str, part: str, columns: list[str]) -> DataFrame:
    """Per `by`: how many parts its rows come from, how many values of columns they carry, and their number where that is one (else 0: they do not go together)."""
    found = df.groupBy(by).agg(F.countDistinct(part).cast("int").alias("n_parts"), F.countDistinct(F.struct(*columns)).alias("n_revisions"), F.count(F.lit(1)).alias("n"))
    return found.select(by, "n_parts", "n_revisions", F.when(F.col("n_revisions") == 1, F.col("n")).otherwise(F.lit(0)).alias("n_rows"))


def role_conflicts(df: DataFrame, held_out: list[str], model: str = "model", role: str = "role", training: tuple[str, ...] = ("train", "cal", "dev")) -> DataFrame:
    """Rows of generators that are held out for the test, in a role before it."""
    return df.filter(F.col(model).isin(*held_out) & F.col(role).isin(*training))


def source_status(receipts: DataFrame, registry: DataFrame, digests: DataFrame) -> DataFrame:
    """(path, status) of every source that a receipt names, by joins of three tables.

    receipts (path, sha256): what a result was made with. registry (path, current, archived, snapshot): sources that have changed since, with the digests then and now and
    where the old one is kept. digests (path, sha256): what is there now. Status: current (there as recorded), archived (its snapshot is there as recorded), or what is
    wrong: outside (an absolute path, or one with a parent folder in it), missing, changed, unrecorded (the registry tells of another old version), snapshot missing, snapshot
    changed. Null digests in a receipt accept any version."""
    there = digests.select(F.col("path").alias("__at"), F.col("sha256").alias("__now"))
    rows = receipts.select("path", F.col("sha256").alias("__want")).join(registry.select("path", "current", "archived", "snapshot", F.lit(True).alias("__kept")), "path", "left")
    rows = rows.join(there, F.col("path") == F.col("__at"), "left").drop("__at")
    old = there.select(F.col("__at").alias("__old_at"), F.col("__now").alias("__old"))
    rows = rows.join(old, F.col("snapshot") == F.col("__old_at"), "left")
    leaves = lambda c: F.coalesce(c.rlike(r"^/|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)"), F.lit(False))
    problems = (
        (leaves(F.col("path")) | leaves(F.col("snapshot")), "outside"), (F.col("__now").isNull(), "missing"), (F.col("__now") != F.coalesce("current", "__want", "__now"), "changed"),
        (F.col("__want") != F.coalesce("archived", "__want"), "unrecorded"), (F.col("__kept") & F.col("__old").isNull(), "snapshot missing"), (F.col("__kept") & (F.col("__old") != F.col("archived")), "snapshot changed"),
    )
    return rows.select("path", F.coalesce(*[F.when(bad, what) for bad, what in problems], F.when(F.col("__kept"), "archived").otherwise("current")).alias("status"))

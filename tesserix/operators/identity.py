"""Content identity: exact and near duplicates, protected sets, role and label guards."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tesserix.functions.hashing import hamming, let
from tesserix.runtime import BROADCAST_ROWS, checked_side


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key. Ranks are limited before the shuffle, so a key with many rows sends few."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def exclude_seen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose identity isn't in seen."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def bands(hash64: Column, radius: int, bits: int = 64) -> Column:
    """radius + 1 pieces of a hash: two hashes within the radius share one of them."""
    n, out, at = radius + 1, [], 0
    for i in range(n):
        wide = bits // n + (1 if i < bits % n else 0)
        piece = F.shiftrightunsigned(hash64, at).bitwiseAND(F.lit((1 << wide) - 1).cast("long"))
        out.append(F.struct(F.lit(i).alias("band"), piece.alias("piece")))
        at += wide
    return F.explode(F.array(*out)).alias("__b")


def hash_groups(df: DataFrame) -> DataFrame:
    """(id, p, d) to (rep, p, d, n): one row per pair of hashes, with its smallest id, so that equal images (blank ones, say) are compared once."""
    return df.groupBy("p", "d").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))


def hash_members(df: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, rep, n): whom each row stands with."""
    return df.join(groups, ["p", "d"]).select("id", "rep", "n")


def near_pairs(left: DataFrame, right: DataFrame, p_radius: int = 4, d_radius: int = 2, bits: int = 64) -> DataFrame:
    """Pairs (a, b) with phash within p_radius and dhash within d_radius; inputs are (id, p, d). Give it hash_groups() where hashes repeat.

    An equi-join on bands of d composed with bands of p (a pair shares one of each), then the exact test; bands of both keep
    a hot band from meeting in one place."""
    def cut(df, name):
        rows = df.select(F.col("id").alias(name), F.col("p").alias(f"{name}_p"), F.col("d").alias(f"{name}_d"))
        rows = rows.select("*", bands(F.col(f"{name}_d"), d_radius, bits)).select("*", F.col("__b.band").alias("db"), F.col("__b.piece").alias("dp")).drop("__b")
        return rows.select("*", bands(F.col(f"{name}_p"), p_radius, bits)).select("*", F.col("__b.band").alias("pb"), F.col("__b.piece").alias("pp")).drop("__b")

    dist_p, dist_d = hamming(F.col("a_p"), F.col("b_p")), hamming(F.col("a_d"), F.col("b_d"))
    pairs = cut(left, "a").join(cut(right, "b"), ["db", "dp", "pb", "pp"]).filter((dist_p <= p_radius) & (dist_d <= d_radius))
    return pairs.select("a", "b", dist_p.alias("p_dist"), dist_d.alias("d_dist")).distinct()


def near_groups(df: DataFrame, p_radius: int = 4, d_radius: int = 2) -> DataFrame:
    """near_pairs() between the representatives of different hashes, each pair once (a < b); hash_members() tells the rest."""
    reps = hash_groups(df).select(F.col("rep").alias("id"), "p", "d")
    return near_pairs(reps, reps, p_radius, d_radius).filter("a < b")


def protected_matches(protected: DataFrame, training: DataFrame, p_radius: int = 4, d_radius: int = 2) -> DataFrame:
    """Ids of protected originals whose content is in training: equal digests, or both hashes within their radii. Inputs are (id, sha, p, d);
    training is compared by its different digests and hashes."""
    exact = protected.join(training.select("sha").distinct(), "sha", "left_semi").select("id")
    own, theirs = (hash_groups(df).select(F.col("rep").alias("id"), "p", "d") for df in (protected, training))
    near = near_pairs(own, theirs, p_radius, d_radius).select(F.col("a").alias("rep")).distinct()
    return hash_members(protected, hash_groups(protected)).join(near, "rep", "left_semi").select("id").union(exact).distinct()


def role_overlap(df: DataFrame, group: str = "sha", role: str = "role") -> DataFrame:
    """Groups that occur in more than one role."""
    return df.groupBy(group).agg(F.countDistinct(role).alias("n_roles"), F.count(F.lit(1)).alias("n_rows")).filter("n_roles > 1")


def audit(df: DataFrame, training: str = "train") -> DataFrame:
    """Per role: rows, training copies dropped, rows of other roles excluded because training holds their content, rows kept."""
    ranked = df.withColumn("__first", F.row_number().over(Window.partitionBy("role", "sha").orderBy("ord")) == 1)
    train = df.filter(F.col("role") == training).select("sha").distinct().withColumn("__in_train", F.lit(True))
    rows = ranked.join(train, "sha", "left")
    copy = (F.col("role") == training) & ~F.col("__first")
    leak = (F.col("role") != training) & F.col("__in_train").isNotNull()
    return rows.groupBy("role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(copy.cast("long")).alias("training_copies"), F.sum(leak.cast("long")).alias("leaks_excluded"), F.sum((~copy & ~leak).cast("long")).alias("n_kept")
    )


def identity_mismatches(df: DataFrame, frozen: str, actual: Column) -> DataFrame:
    """Rows whose content's digest isn't the frozen one."""
    return df.filter(~F.col(frozen).eqNullSafe(actual))


def _runs(w: Column, n: int) -> Column:
    """(n, digest) of each run of n words."""
    of = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(F.slice(w, i, n)).alias("key")))
    return F.when(F.size(w) >= n, of).otherwise(F.array().cast("array<struct<n:int,key:bigint>>"))


def _by_words(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold passages with a key: an equi-join on digests of runs of words, then exact containment."""
    keyed = checked_side(items.select("item_id", "passage", F.size("key").alias("n"), F.xxhash64("key").alias("key")), "protected-keys")
    sizes = sorted(r["n"] for r in keyed.select("n").distinct().collect())  # at most as many numbers as a key has words
    # the digests of all runs of n words, computed from words that were cut once
    runs = F.array_distinct(let(_words(F.col("text")), lambda w: F.flatten(F.array(*[_runs(w, n) for n in sizes]))))
    keys = docs.select("doc_id", F.explode(runs).alias("k")).select("doc_id", "k.n", "k.key")
    near = checked_side(keys.join(keyed, ["n", "key"]).select("doc_id", "item_id", "passage").distinct(), "protected-near", 100_000)
    return docs.join(near, "doc_id").filter(F.contains("text", F.col("passage"))).select("doc_id", "item_id")


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+)"), 1)


_AUTOMATA: dict = {}


def automaton(name: str, passages: dict[str, list[int]]):
    """An automaton over passages that finds all of them in one reading of a text; one per Python worker and name."""
    if name not in _AUTOMATA:
        import ahocorasick

        made = ahocorasick.Automaton()
        for p, numbers in passages.items():
            made.add_word(p, numbers)
        made.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[name] = made
    return _AUTOMATA[name]


def _by_automaton(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold passages, each text read once per block of passages of BLOCK_CHARS characters."""
    spark = docs.sparkSession
    rows = items.select("item_id", "passage").collect()  # the caller has summed their lengths
    blocks, size = [{}], 0
    for k, r in enumerate(rows):
        if size > BLOCK_CHARS:
            blocks.append({})
            size = 0
        blocks[-1].setdefault(r["passage"], []).append(k)
        size += len(r["passage"])
    told, names = spark.sparkContext.broadcast(blocks), [uuid.uuid4().hex for _ in blocks]

    def run(batches):
        from tesserix.operators import identity

        for b in batches:
            at, found = [], []
            texts = b.column(1).to_pylist()
            for name, passages in zip(names, told.value, strict=True):
                own = identity.automaton(name, passages)
                for i, t in enumerate(texts):
                    for k in {x for _, numbers in own.iter(t or "") for x in numbers}:
                        at.append(i)
                        found.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.int64())], ["doc_id", "k"])

    schema = StructType([docs.schema["doc_id"], StructField("k", LongType())])
    ids = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], StructType([StructField("k", LongType()), items.schema["item_id"]]))
    held = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)
    return held.join(F.broadcast(ids) if len(rows) <= BROADCAST_ROWS else ids, "k").select("doc_id", "item_id")


#: Characters of passages that one automaton holds (some 100 bytes each), and that are looked for by automata at all.
BLOCK_CHARS, MOST_CHARS = 500_000, 4_000_000


def protected_contamination(docs: DataFrame, protected: DataFrame, words: int = 8) -> DataFrame:
    """Documents that hold a protected passage, to the letter and wherever it begins: (doc_id, item_id), each pair once.

    docs (doc_id, text), protected (item_id, text); empty and null passages are in nothing, null texts hold nothing. Up to MOST_CHARS characters of passages, counted first, are sent to
    the tasks, which read each text once and shuffle only what they have found. More are joined by a key: a passage's first and last word may be parts of longer ones in a
    document, so the key is made of the next `words` words inside, without signs; those without a word inside (a few characters each) are still looked for by automata, in blocks."""
    rows = docs.select("doc_id", "text")
    items = protected.select("item_id", F.col("text").alias("passage")).filter(F.length("passage") > 0)
    if (items.agg(F.sum(F.length("passage"))).first()[0] or 0) <= MOST_CHARS:
        return _by_automaton(rows, items).distinct()
    items = items.withColumn("key", let(_words(F.col("passage")), lambda w: F.slice(w, 2, F.least(F.lit(words), F.greatest(F.size(w) - 2, F.lit(0))))))
    return _by_words(rows, items.filter(F.size("key") > 0)).union(_by_automaton(rows, items.filter(F.size("key") == 0))).distinct()

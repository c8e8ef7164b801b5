"""Operator 13: importance resampling towards a target distribution, with hashed n-gram features.

Texts become bags of words and of pairs of consecutive words, each hashed to one of BUCKETS. A bucket's gain is the floored log of how much
likelier it is in the target than in the corpus (both smoothed by one occurrence a bucket); a document's weight is the floored mean
gain of its features; the weight plus hash-drawn Gumbel noise is its score, and the SHARE percent with the highest scores are drawn without replacement.

Features are read in batches: the texts of a batch are joined with a separator that no word holds, one regex pass finds all words and separators,
searchsorted over the separators' places gives each word's document and masks pairs that would reach over two texts, and bincount counts. The checksum
of a pair follows from those of its words by table look-ups (checksums are linear), so no pair is ever built as a string. The corpus is read twice (counts, then
weights); counts are BUCKETS numbers a task, summed before the shuffle. The global rank is a range-ordered table with prefix sums of its partitions' sizes.

Null texts have no words; documents without features weigh 0; those with fewer than LEAST_WORDS words are never drawn. A null doc_id counts as the empty
string in the draw and comes last among ties; rows alike in score, doc_id and features are ranked in any order. Texts of any length are read whole, a slice of the
batch at a time. An empty corpus gives an empty result, an empty target gains from smoothing alone. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserix.llm.words import Memo
from tesserix.runtime import forget, saved

BUCKETS, SHARE, LEAST_WORDS, SEED = 10_000, 25, 20, "7"
#: ASCII digits and letters, and every byte of characters beyond ASCII.
WORD_BYTES = rb"0-9a-z\x80-\xff"
TOKENS = re.compile(rb"[" + WORD_BYTES + rb"]+|\x00")
GAP = re.compile(rb"[^" + WORD_BYTES + rb"]")
#: Bytes of a batch that are cut into words at once (to the end of the last word).
SLICE = 4 << 20
#: Words up to this number of bytes are paired by tables, longer ones one by one.
TABLED = 64


def shift_tables() -> np.ndarray:
    """[n, k, b]: what byte b at place k of a checksum becomes when n more zero bytes are read; the checksum of AB is that of A so shifted, xor that of B."""
    out = np.zeros((TABLED + 1, 4, 256), np.uint32)
    for n in range(TABLED + 1):
        zeros, base = bytes(n), zlib.crc32(bytes(n))
        bits = [zlib.crc32(zeros, 1 << i) ^ base for i in range(32)]
        for k in range(4):
            for i in range(8):
                step = 1 << i
                out[n, k, step : 2 * step] = out[n, k, :step] ^ np.uint32(bits[8 * k + i])
    return out


class Features:
    """Batches of texts to the buckets of their features."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.tables = buckets, shift_tables().reshape(-1)
        # length (up to 2^30) and checksum in one number
        self.word = Memo(lambda w: -1 if w == b"\0" else min(len(w), 1 << 30) << 32 | zlib.crc32(w), 48 << 20)

    def shifted(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        """sums as they are after n (up to TABLED) more bytes of zeros."""
        at = n.astype(np.int64) << 10
        out = self.tables[at + (sums & 255)]
        for k in (1, 2, 3):
            out ^= self.tables[at + (256 * k) + ((sums >> np.uint32(8 * k)) & np.uint32(255))]
        return out

    def pairs(self, first: np.ndarray, second: np.ndarray, size: np.ndarray, words: list[bytes]) -> np.ndarray:
        """Checksums of "first second", from the words' checksums; words: the second ones, for those too long for the tables."""
        spaced = self.shifted(first, np.ones(len(first), np.int64)) ^ np.uint32(zlib.crc32(b" "))
        out = self.shifted(spaced, np.minimum(size, TABLED)) ^ second
        for i in np.flatnonzero(size > TABLED).tolist():
            out[i] = zlib.crc32(words[i], int(spaced[i]))
        return out

    def slices(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(documents of the words, documents of the features, buckets of the features), slice by slice; documents by their place in texts."""
        joined, at, done, before = b"\0".join([t.replace(b"\0", b" ") for t in texts]).lower(), 0, 0, None
        while at < len(joined):
            gap = GAP.search(joined, at + SLICE)
            end = gap.start() if gap else len(joined)
            tokens = TOKENS.findall(joined, at, end)
            at = end
            carried = before is not None
            if carried:  # the last word of the slice before, so that its pair with the next one is seen
                tokens.insert(0, before)
            code = np.fromiter(map(self.word.__getitem__, tokens), np.int64, len(tokens))
            ends = np.flatnonzero(code < 0)
            words = np.flatnonzero(code >= 0)
            doc = done + np.searchsorted(ends, words)  # separators before a word: its document
            sums, size = (code & 0xFFFFFFFF).astype(np.uint32), code >> 32
            # neighbours among the words that are neighbours among the tokens too belong to one document
            left = words[:-1][words[1:] == words[:-1] + 1] if len(words) else words
            both = self.pairs(sums[left], sums[left + 1], size[left + 1], [tokens[i + 1] for i in left.tolist()] if (size > TABLED).any() else [])
            one = slice(1, None) if carried else slice(None)  # the carried word was counted
            pair_docs = doc[np.searchsorted(words, left)]
            yield doc[one], np.concatenate([doc[one], pair_docs]), (np.concatenate([sums[words][one], both]) % np.uint32(self.buckets)).astype(np.int64)
            done += len(ends)
            before = tokens[-1] if len(tokens) and code[-1] >= 0 else None


def _texts(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) for c in columns], F.col("text").cast("string").alias("text"))


def _raw(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def bucket_counts(df: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts of df: an array of fixed size."""

    def run(batches):
        features, total = Features(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, found in features.slices(_raw(b.column(0))):
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    counted = _texts(df).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in counted:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of (smoothed share in the target over smoothed share in the corpus)) of every bucket."""
    n = len(corpus)
    ratio = (target + 1).astype(np.float64) * float(int(corpus.sum()) + n) / ((corpus + 1).astype(np.float64) * float(int(target.sum()) + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_features, n_words, weight of every row."""
    model = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def run(batches):
        gain = model.value
        features = Features(len(gain))
        for b in batches:
            n_words, n_features, total = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for words, of, found in features.slices(_raw(b.column(1))):
                n_words += np.bincount(words, minlength=b.num_rows)
                n_features += np.bincount(of, minlength=b.num_rows)
                # sums below 2^53 are exact in bincount's doubles; a slice can't hold more
                total += np.bincount(of, gain[found], b.num_rows).astype(np.int64)
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n_features, n_words, weight))], ["doc_id", "n_features", "n_words", "weight"])

    return _texts(docs, "doc_id").mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")


def gumbel(doc_id, seed: str = SEED):
    """floor(-1000 ln(-ln u)), u drawn from a hash of doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows (doc_id, n_features, n_words, weight, score) with rank: 1, 2, 3... of the drawn, null for all others. No task sees more than a range of scores."""
    spark = rows.sparkSession
    fits = F.col("n_words") >= least_words
    keyed = saved(rows.withColumn("__row", F.monotonically_increasing_id()), "resample-scores")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("__row")]
    local = F.monotonically_increasing_id()
    ordered = keyed.filter(fits).orderBy(*order).withColumn("__part", F.shiftright(local, 33).cast("int")).withColumn("__at", local.bitwiseAND((1 << 33) - 1))
    ordered = saved(ordered, "resample-order")
    sizes = {r["__part"]: r["n"] for r in ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number a partition
    total, base, sums = sum(sizes.values()), 0, []
    for part in sorted(sizes):
        sums.append((part, base))
        base += sizes[part]
    bases = F.broadcast(spark.createDataFrame(sums, "__part int, __base long"))
    drawn = share * total // 100
    rank = F.col("__base") + F.col("__at") + 1
    best = ordered.join(bases, "__part").withColumn("rank", F.when(rank <= drawn, rank))
    rest = keyed.filter(~fits).withColumn("rank", F.lit(None).cast("long"))
    out = saved(best.select(*rows.columns, "rank").unionByName(rest.select(*rows.columns, "rank")), "resample-ranks")
    for t in (keyed, ordered):
        forget(spark, t)
    return out


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words of every row of docs; rows with a rank are the sample. target: a table with texts."""
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    rows = weigh(docs, gains).withColumn("score", (F.col("weight") + gumbel(F.col("doc_id"), seed)).cast("long"))
    return ranked(rows, share, least_words).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def resample_filter(docs: DataFrame, target: DataFrame, share: int = SHARE) -> DataFrame:
    """The drawn documents, with the columns of docs. For tables whose doc_ids are unique: rows that share one are drawn together."""
    drawn = resample(docs, target, share=share).filter("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(drawn, docs["doc_id"].cast("long").eqNullSafe(F.col("__drawn")), "left_semi")

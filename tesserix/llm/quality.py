"""Operator 12: quality by a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector of three parts: its words and runs of signs, each hashed to one of BUCKETS, by the log of their counts scaled to length 1; STATS
numbers of the text's structure (length, kinds of characters, their entropy, word lengths, repeated words and lines), standardised on the
sample; and indicators of its metadata (order of magnitude of n_chars, whether it fits the text). The score's logit is a bias, a linear term, and
the interactions of all pairs of features through FACTORS latent numbers each, in linear time: half of the square of the sum less the sum of squares. Bias,
weights and factors are trained jointly by Adagrad on the log loss of a bounded sample (PER_LABEL documents of each label). A logistic curve over the
machine's output, fitted on documents it didn't learn from, makes the output a probability with the labels' true shares.

Every word of the whole text counts; long texts are read a slice at a time. Null texts count as empty and are scored by what is left, the metadata; without labels of
both classes every score is the base rate. Labels other than 0 and 1 are ignored; repeated rows get equal scores; n_chars may be missing, null or of another
type. An empty table gives an empty result; other columns pass through the filter whatever their names.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tesserix.llm.sampling import sampled_texts
from tesserix.llm.toxicity import logistic
from tesserix.llm.words import Memo
from tesserix.runtime import free_name

BUCKETS, FACTORS = 1 << 16, 6
PER_LABEL, EPOCHS, RATE, PULL, BATCH, CROSS = 2000, 6, 0.08, 2e-3, 64, 3
#: Features in fewer documents of the sample aren't learned.
RARE = 4
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Bytes cut into words at once (to the end of the last one).
SLICE = 4 << 20
TOKENS = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\s]+")
SPACE = re.compile(rb"\s")
STATS, MAGNITUDES = 16, 40
#: Places of the parts in the vector.
META = BUCKETS + STATS
SIZE = META + MAGNITUDES + 3


def _kinds() -> np.ndarray:
    """One row a kind of byte: lower case, upper case, digit, white space, sign, beyond ASCII."""
    out = np.zeros((6, 256))
    for b in range(256):
        c = chr(b)
        out[5 if b > 127 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 4, b] = 1
    return out


KINDS = _kinds()


class Vectors:
    """Texts and their n_chars to sparse vectors."""

    def __init__(self):
        self.bucket = Memo(lambda w: zlib.crc32(w) & (BUCKETS - 1), 40 << 20)

    def codes(self, raw: bytes) -> np.ndarray:
        """Buckets of all words and runs of signs, in order."""
        low, at, parts = raw.lower(), 0, []
        while at < len(low):
            gap = SPACE.search(low, at + SLICE)
            end = gap.start() if gap else len(low)
            words = TOKENS.findall(low, at, end)
            parts.append(np.fromiter(map(self.bucket.__getitem__, words), np.int32, len(words)))
            at = end
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.int32)

    def stats(self, raw: bytes, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """STATS numbers of the text's structure; all 0 but the lengths for an empty text."""
        out = np.zeros(STATS)
        n, words = len(raw), len(codes)
        out[0], out[1] = np.log1p(n), np.log1p(words)
        if n:
            seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
            out[2:8] = KINDS @ seen / n
            share = seen[seen > 0] / n
            out[8] = -(share * np.log(share)).sum()
            lines = raw.split(b"\n")
            out[9], out[10] = np.log1p(len(lines)), 1 - len(set(lines)) / len(lines)
        if words:
            out[11] = np.log1p(n / words)
            out[12] = np.log(len(counts) / words)
            out[13] = counts.max() / words
            out[14] = (codes[1:] == codes[:-1]).mean() if words > 1 else 0
            out[15] = (counts > 1).mean()
        return out

    def vector(self, raw: bytes, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places and values of words and metadata, statistics not yet standardised)."""
        codes = self.codes(raw)
        place, counts = np.unique(codes, return_counts=True)
        value = np.log1p(counts)
        value /= max(1e-9, np.sqrt((value**2).sum()))
        size = -1 if n_chars is None or n_chars < 0 else min(MAGNITUDES - 1, int(n_chars).bit_length())
        length = len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))
        meta = [META + MAGNITUDES if size < 0 else META + size, META + MAGNITUDES + (1 if size >= 0 and n_chars == length else 2)]
        return np.concatenate([place, meta]).astype(np.int64), np.concatenate([value, [0.5, 0.5]]), self.stats(raw, codes, counts)


class Machine:
    """bias, weights (SIZE) and factors (SIZE, FACTORS); centre and scale of the statistics; the curve (slope, shift)."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.bias, self.weights = 0.0, np.zeros(SIZE, np.float32)
        self.factors = rng.normal(0, 0.05, (SIZE, FACTORS)).astype(np.float32)
        self.centre, self.scale, self.curve = np.zeros(STATS), np.ones(STATS), np.array([1.0, 0.0])

    def rows(self, vectors: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, values, starts) of several documents' whole vectors, one after the other."""
        at = np.arange(BUCKETS, META)
        stats = np.clip((np.stack([v[2] for v in vectors]) - self.centre) / self.scale, -4, 4) / np.sqrt(STATS)
        places = np.concatenate([x for v in vectors for x in (v[0], at)])
        values = np.concatenate([x for v, s in zip(vectors, stats, strict=True) for x in (v[1], s)]).astype(np.float32)
        sizes = np.array([len(v[0]) + STATS for v in vectors])
        return places, values, np.cumsum(sizes) - sizes

    def logits(self, places: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each document's logit and its sums of factors: the pairs' interactions are (square of the sum - sum of the squares) / 2."""
        scaled = self.factors[places] * values[:, None]
        sums = np.add.reduceat(scaled, starts, 0)
        squares = np.add.reduceat((scaled**2).sum(1), starts)
        linear = np.add.reduceat(self.weights[places] * values, starts)
        return self.bias + linear + ((sums**2).sum(1) - squares) / 2, sums

    def fit(self, vectors: list, y: np.ndarray, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        stats = np.stack([v[2] for v in vectors])
        self.centre, self.scale = stats.mean(0), np.maximum(stats.std(0), 1e-3)
        seen = np.zeros(SIZE)
        for v in vectors:
            seen[v[0]] += 1
        seen[BUCKETS:META] = len(vectors)
        self.factors[seen < RARE] = 0
        known = (seen >= RARE).astype(np.float32)
        self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        g_w, g_v, g_b = np.full(SIZE, 1e-4, np.float32), np.full(SIZE, 1e-4, np.float32), 1e-4
        for _ in range(EPOCHS):
            order = rng.permutation(len(vectors))
            for low in range(0, len(order), BATCH):
                some = order[low : low + BATCH]
                places, values, starts = self.rows([vectors[i] for i in some])
                z, sums = self.logits(places, values, starts)
                slope = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[some]) / len(some)
                row = np.repeat(np.arange(len(some)), np.diff(np.append(starts, len(places))))
                used, at = np.unique(places, return_inverse=True)
                d_w = np.bincount(at, slope[row] * values, len(used)).astype(np.float32)
                each = slope[row, None] * values[:, None] * (sums[row] - self.factors[places] * values[:, None])
                d_v = np.stack([np.bincount(at, each[:, k], len(used)) for k in range(FACTORS)], 1).astype(np.float32)
                g_w[used] += d_w**2
                g_v[used] += (d_v**2).mean(1)
                fit = known[used] * RATE
                self.weights[used] -= fit * (d_w / np.sqrt(g_w[used]) + PULL * self.weights[used])
                self.factors[used] -= fit[:, None] * (d_v / np.sqrt(g_v[used])[:, None] + PULL * self.factors[used])
                g_b += slope.sum() ** 2
                self.bias -= RATE * slope.sum() / np.sqrt(g_b)

    def raw_scores(self, vectors: list) -> np.ndarray:
        return self.logits(*self.rows(vectors))[0].astype(np.float64) if vectors else np.empty(0)

    def probabilities(self, vectors: list) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * self.raw_scores(vectors) + self.curve[1], -40, 40)))


def pair_sum(machine: Machine, places: np.ndarray, values: np.ndarray) -> float:
    """The logit with every pair written out: what logits() must equal."""
    out = machine.bias + float(machine.weights[places] @ values)
    for i in range(len(places)):
        for j in range(i):
            out += float(machine.factors[places[i]] @ machine.factors[places[j]]) * values[i] * values[j]
    return out


def train(sample: list[tuple[str, int, int | None]], seed: int = 3) -> Machine:
    """sample: (text, 0 or 1, n_chars), bounded. The curve is fitted on outputs of machines that didn't learn from the document."""
    y = np.array([x[1] for x in sample], np.int64)
    counts, machine = np.bincount(y, minlength=2), Machine(seed)
    if counts.min() < CROSS:
        base = float(y.mean()) if len(y) else 0.5
        machine.factors[:] = 0
        machine.curve = np.array([0.0, np.log((base + 1e-3) / (1 - base + 1e-3))])
        return machine
    make = Vectors()
    vectors = [make.vector(t.encode("utf-8", "replace"), n) for t, _, n in sample]
    part, out = np.empty(len(y), np.int64), np.empty(len(y))
    for c in (0, 1):
        part[y == c] = np.arange(counts[c]) % CROSS
    for k in range(CROSS):
        own, aside = Machine(seed), np.flatnonzero(part == k)
        own.fit([vectors[i] for i in np.flatnonzero(part != k)], y[part != k], seed)
        out[aside] = own.raw_scores([vectors[i] for i in aside])
    slope, shift = logistic(np.stack([out, np.ones(len(y))], 1), y)
    machine.fit(vectors, y, seed)
    machine.curve = np.array([max(slope, 0.0), shift])
    return machine


def fold(doc_id, k: int = FOLDS):
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % k


def _n_chars(docs: DataFrame):
    return F.col("n_chars").try_cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")


def fitted(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Machine:
    """Learns from labelled rows outside the held-out fold."""
    known = labels.filter((fold(F.col("doc_id")) != HELD_OUT) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("string").alias("label"))
    rows = docs.select("doc_id", "text", _n_chars(docs).alias("n_chars"))
    sample = [(t, int(y), n) for t, y, n in sampled_texts(rows, known, per_label, "quality", carry=("n_chars",))]
    machine, n = train(sample), {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    m = np.bincount([y for _, y, _ in sample], minlength=2)
    if m.min() and len(n) == 2:
        machine.curve[1] += np.log(n["1"] / n["0"]) - np.log(m[1] / m[0])  # the table's shares of the labels
    return machine


_VECTORS: list[Vectors] = []


def shared_vectors() -> Vectors:
    """One per Python worker, so that words stay looked up from task to task."""
    if not _VECTORS:
        _VECTORS.append(Vectors())
    return _VECTORS[0]


def score_documents(docs: DataFrame, machine: Machine, columns: list[str]) -> DataFrame:
    """columns of docs, and the score as a last column under a free name."""
    parts = (machine.bias, machine.weights, machine.factors, machine.centre, machine.scale, machine.curve)
    model = docs.sparkSession.sparkContext.broadcast(parts)  # 4 bytes x SIZE x (FACTORS + 1), whatever the corpus
    name = free_name(docs, "__score")
    schema = StructType([*docs.select(*[docs[c] for c in columns]).schema.fields, StructField(name, DoubleType())])
    text, size = free_name(docs, "__text"), free_name(docs, "__size")
    rows, n = docs.select(*columns, F.col("text").cast("string").alias(text), _n_chars(docs).alias(size)), len(columns)

    def run(batches):
        from tesserix.llm import quality

        own, make = quality.Machine(), quality.shared_vectors()
        own.bias, own.weights, own.factors, own.centre, own.scale, own.curve = model.value
        for b in batches:
            scores = []
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                raw = part.column(n).cast(pa.binary()).to_pylist()
                scores.append(own.probabilities([make.vector(t or b"", k) for t, k in zip(raw, part.column(n + 1).to_pylist(), strict=True)]))
            found = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(found, pa.float64())], [*b.schema.names[:n], name])

    return rows.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = score_documents(docs.withColumn("doc_id", F.col("doc_id").cast("long")), fitted(docs, labels, per_label), ["doc_id"])
    score = F.col(scored.columns[-1])
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of good quality, with the columns of docs."""
    scored = score_documents(docs, fitted(docs, labels), docs.columns)
    return scored.filter(F.col(scored.columns[-1]) >= threshold).select(*docs.columns)

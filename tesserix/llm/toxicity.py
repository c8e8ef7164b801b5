"""Operator 5: toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5, with word ends) and itself, each hashed to a row of an embedding table. A
window of WINDOW words is the mean of its subwords' embeddings; a linear softmax over it gives P(toxic). Table and softmax are
trained together by Adagrad on windows of a bounded sample of labelled documents (PER_LABEL each): as labels are of documents, each
toxic document gives its most toxic windows under the model at hand, each clean one its most toxic and some others, in ROUNDS rounds.
A document's score is a logistic curve over its most toxic windows and its length, fitted on documents that the windows' model didn't learn
from. Every window of the whole text counts (very long words in overlapping pieces, to their end), and one word is enough in a long one. Misspellings unseen in training share n-grams
with known words, hence their vectors.

Null and empty texts, and texts without words, score 0: nothing in them is toxic. Labels other than 0 and 1 are ignored; without both classes every
score is the base rate. Repeated rows get equal scores; an empty table gives an empty result; other columns pass through the filter whatever their names.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tesserix.llm.sampling import sampled_texts
from tesserix.llm.words import WORD, Memo
from tesserix.runtime import free_name

BUCKETS, DIM, WINDOW, STRIDE = 1 << 17, 8, 2, 1
#: Subwords in fewer training documents aren't learned; DECAY pulls the others to 0; TRIM: share of toxic documents' windows left out.
RARE, DECAY, TRIM = 12, 1e-2, 0.15
#: Documents (of each label), rounds of choosing windows, passes in each, and parts for the document curve.
PER_LABEL, ROUNDS, EPOCHS, CROSS = 1800, 3, 4, 3
FOLDS, HELD_OUT = 5, 0
#: Words of more than LONG letters are read in pieces; where no underscore parts them, of PIECE letters, one beginning every STEP.
LONG, PIECE, STEP = 40, 12, 4


def subwords(word: str) -> np.ndarray:
    """Buckets of the whole word and its n-grams."""
    w = f"<{word}>"
    grams = {w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)} | {f"={word}"}
    return np.unique(np.array([zlib.crc32(g.encode("utf-8")) & (BUCKETS - 1) for g in grams], np.int64))


def pieces(word: str) -> list[str]:
    """A word of more than LONG letters cut at underscores; what is still as long, as overlapping pieces of PIECE letters. So a term anywhere
    in it stands out as in a short word."""
    if len(word) <= LONG:
        return [word]
    return [p for w in word.split("_") if w for p in ([w] if len(w) <= LONG else [w[i : i + PIECE] for i in range(0, len(w) - PIECE + STEP, STEP)])] or [word]


class SubwordBag:
    """The model: embeddings, softmax weights and bias."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.table = np.zeros((BUCKETS, DIM), np.float32)  # what no training window holds adds nothing
        self.weights = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.known = np.ones(BUCKETS, np.float32)  # 0: too rare to be learned

    def bucket_logits(self) -> np.ndarray:
        """What each bucket adds to the logit of toxic against clean."""
        return self.table @ (self.weights[:, 1] - self.weights[:, 0])

    def fit(self, windows: list[np.ndarray], y: np.ndarray, rng, epochs: int, rate: float = 0.3, batch: int = 256) -> None:
        """windows: arrays of subword buckets. Weighted so that both classes count alike."""
        share = max(1e-6, y.mean()), max(1e-6, 1 - y.mean())
        weight = np.where(y == 1, 0.5 / share[0], 0.5 / share[1]).astype(np.float32)
        known = self.known
        g_table, g_weights, g_bias = np.full(BUCKETS, 1e-4, np.float32), np.full_like(self.weights, 1e-4), np.full_like(self.bias, 1e-4)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for lo in range(0, len(order), batch):
                some = order[lo : lo + batch]
                parts = [windows[i] for i in some]
                sizes = np.array([len(p) for p in parts])
                flat, row = np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes)
                starts = np.cumsum(sizes) - sizes
                mean = np.add.reduceat(self.table[flat], starts, 0) / sizes[:, None]
                z = mean @ self.weights + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(some)), y[some]] -= 1
                p *= weight[some, None] / len(some)
                d_weights, d_bias, d_mean = mean.T @ p, p.sum(0), (p @ self.weights.T) / sizes[:, None]
                used, at = np.unique(flat, return_inverse=True)
                d_table = np.stack([np.bincount(at, d_mean[row, k], len(used)) for k in range(DIM)], 1).astype(np.float32)
                g_table[used] += (d_table**2).mean(1)
                self.table[used] -= rate * known[used, None] * (d_table / np.sqrt(g_table[used])[:, None] + DECAY * self.table[used])
                g_weights += d_weights**2
                self.weights -= rate * d_weights / np.sqrt(g_weights)
                g_bias += d_bias**2
                self.bias -= rate * d_bias / np.sqrt(g_bias)


def evidence(z: np.ndarray) -> np.ndarray:
    """What the document curve reads of a document's window logits: the largest, means of the largest 4 and 12, and their number."""
    n = len(z)
    top = np.sort(z if n <= 12 else np.partition(z, n - 12)[n - 12 :])[::-1]
    few = lambda k: float(top[:k].sum() / min(k, n))
    return np.array([top[0], few(4), few(12), np.log1p(n), 1.0])


def window_logits(sums: np.ndarray) -> np.ndarray:
    """sums: per word, its buckets' sum and number. The mean logit of each window of WINDOW words."""
    n = len(sums)
    at = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
    total = np.concatenate([np.zeros((1, 2)), sums.cumsum(0)])
    found = total[np.minimum(at + WINDOW, n)] - total[at]
    return found[:, 0] / found[:, 1]


def spoken(text: str) -> list[str]:
    """Lower-case words; a word repeated at once counts once."""
    words = WORD.findall(text.lower())
    if len(text) > LONG and max(map(len, words), default=0) > LONG:
        words = [p for w in words for p in pieces(w)]
    return [w for w, before in zip(words, [None, *words], strict=False) if w != before]


class Scorer:
    """Documents' scores, by the sums that words add to windows; each word is looked up once."""

    def __init__(self, logits: np.ndarray, bias: float, curve: np.ndarray):
        self.logits, self.bias, self.curve = logits, bias, np.asarray(curve, np.float64)

        def of(word):
            s = subwords(word)
            return float(logits[s].sum()), len(s)

        self.word = Memo(of, 88 << 20)

    def score(self, text: str) -> float:
        words = spoken(text)
        if not words:
            return 0.0
        sums = np.fromiter(chain.from_iterable(map(self.word.__getitem__, words)), np.float64, 2 * len(words)).reshape(-1, 2)
        z = window_logits(sums) + self.bias
        return float(1 / (1 + np.exp(-np.clip(evidence(z) @ self.curve, -40, 40))))


class Trainer:
    """Documents as word numbers, words as bags of subwords."""

    def __init__(self, sample: list[tuple[str, int]], seed: int):
        self.y, self.seed, memo, self.bags, self.docs = np.array([y for _, y in sample], np.int64), seed, {}, [], []
        for text, _ in sample:
            out = []
            for w in spoken(text):
                k = memo.get(w)
                if k is None:
                    k = memo[w] = len(self.bags)
                    self.bags.append(subwords(w))
                out.append(k)
            self.docs.append(np.array(out, np.int64))
        self.sizes = np.array([len(s) for s in self.bags])
        self.starts, self.flat = np.cumsum(self.sizes) - self.sizes, np.concatenate(self.bags) if self.bags else np.empty(0, np.int64)

    def sums(self, logits: np.ndarray) -> np.ndarray:
        return np.stack([np.add.reduceat(logits[self.flat], self.starts), self.sizes], 1)

    def fit(self, learned: np.ndarray) -> tuple[np.ndarray, float]:
        """Bucket logits and bias, from the documents numbered in learned."""
        rng, seen = np.random.default_rng(self.seed), np.zeros((2, BUCKETS))
        learned = [i for i in learned if len(self.docs[i])]
        for i in learned:
            seen[self.y[i], np.unique(np.concatenate([self.bags[k] for k in np.unique(self.docs[i])]))] += 1
        n = np.bincount(self.y[learned], minlength=2)
        # a first ranking of windows: how much more often a word's n-grams occur in toxic documents
        logits = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
        logits[seen.sum(0) < RARE] = 0
        model = SubwordBag(self.seed)
        model.known = (seen.sum(0) >= RARE).astype(np.float32)
        for _ in range(ROUNDS):
            per_word, windows, y, strength = self.sums(logits), [], [], []
            for i in learned:
                d, toxic = self.docs[i], self.y[i]
                z = window_logits(per_word[d])
                top = np.argsort(-z, kind="stable")[: 2 if toxic else 3]
                for w in top if toxic else np.unique(np.concatenate([top, rng.choice(len(z), min(2, len(z)))])):
                    windows.append(np.concatenate([self.bags[k] for k in d[w * STRIDE : w * STRIDE + WINDOW]]))
                    y.append(toxic)
                    strength.append(z[w])
            y, strength = np.array(y), np.array(strength)
            # labels are noisy, and not all top windows are toxic: the weakest stay out
            keep = np.flatnonzero((y == 0) | (strength >= np.quantile(strength[y == 1], TRIM)))
            model.fit([windows[k] for k in keep], y[keep], rng, EPOCHS)
            logits = model.bucket_logits()
        return logits, float(model.bias[1] - model.bias[0])

    def evidence(self, logits: np.ndarray, bias: float, which: np.ndarray) -> np.ndarray:
        per_word = self.sums(logits)
        return np.stack([evidence((window_logits(per_word[self.docs[i]]) if len(self.docs[i]) else np.zeros(1)) + bias) for i in which])


def train(sample: list[tuple[str, int]], seed: int = 11) -> Scorer:
    """sample: (text, 0 or 1), bounded. The document curve is fitted on evidence from models that didn't learn from the document."""
    y = np.array([y for _, y in sample], np.int64)
    counts = np.bincount(y, minlength=2)
    if counts.min() < CROSS:
        base = float(y.mean()) if len(y) else 0.0
        return Scorer(np.zeros(BUCKETS), 0.0, np.array([0, 0, 0, 0, np.log((base + 1e-3) / (1 - base + 1e-3))]))
    own, part = Trainer(sample, seed), np.empty(len(y), np.int64)
    for c in (0, 1):
        part[y == c] = np.arange(counts[c]) % CROSS
    x = np.empty((len(y), 5))
    for k in range(CROSS):
        aside = np.flatnonzero(part == k)
        x[aside] = own.evidence(*own.fit(np.flatnonzero(part != k)), aside)
    curve = logistic(x, y)
    logits, bias = own.fit(np.arange(len(y)))
    return Scorer(logits, bias, curve)


def logistic(x: np.ndarray, y: np.ndarray, pull: float = 1e-2, steps: int = 200) -> np.ndarray:
    """Logistic regression by damped Newton steps; the classes as frequent as they are in the sample."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    x, w = x / scale, np.zeros(x.shape[1])
    loss = lambda w: np.logaddexp(0, -np.where(y == 1, 1, -1) * (x @ w)).sum() + pull * (w @ w) / 2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (p - y) + pull * w
        h = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step, rate = np.linalg.solve(h, g), 1.0
        while rate > 1e-4 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-8:
            break
    return w / scale


def fold(doc_id, k: int = FOLDS):
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % k


def fitted(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Scorer:
    """Learns from labelled rows outside the held-out fold."""
    known = labels.filter((fold(F.col("doc_id")) != HELD_OUT) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("string").alias("label"))
    sample = [(t, int(y)) for t, y in sampled_texts(docs.select("doc_id", "text"), known, per_label, "toxic")]
    scorer, n = train(sample), {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    m = np.bincount([y for _, y in sample], minlength=2)
    if m.min() and len(n) == 2:
        # the sample holds the labels in other shares than the table; a missed toxic document counts as sqrt(clean / toxic) clean ones
        scorer.curve[-1] += np.log(n["1"] / n["0"]) / 2 - np.log(m[1] / m[0])
    return scorer


def score_documents(docs: DataFrame, scorer: Scorer, columns: list[str] | None = None) -> DataFrame:
    """columns (doc_id unless given) of docs, and __score (or a longer name, if docs has that), which is last."""
    spark, kept = docs.sparkSession, columns or ["doc_id"]
    # a table of 1 MB, whatever the corpus
    model = spark.sparkContext.broadcast((scorer.logits.astype(np.float32), scorer.bias, scorer.curve))
    name = free_name(docs, "__score")
    schema = StructType([*docs.select(*[docs[c] for c in kept]).schema.fields, StructField(name, DoubleType())])
    # a text that is kept anyway is read where it lies
    own_text = "text" in kept and docs.schema["text"].dataType.simpleString() == "string"
    rows = docs.select(*kept) if own_text else docs.select(*kept, F.col("text").cast("string").alias(free_name(docs, "__text")))
    at = kept.index("text") if own_text else len(kept)

    def run(batches):
        from tesserix.llm import toxicity

        own = toxicity.shared_scorer(model.value)
        for b in batches:
            scores = pa.array([own.score(t.as_py() or "") for t in b.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], scores], [*b.schema.names[: len(kept)], name])

    return rows.mapInArrow(run, schema)


_SCORERS: dict = {}


def shared_scorer(model) -> Scorer:
    """One scorer per Python worker and model, so that its words stay looked up from task to task."""
    key = (float(model[0].sum()), model[1], *map(float, model[2]))
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(*model)
    return _SCORERS[key]


def toxicity(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = score_documents(docs.withColumn("doc_id", F.col("doc_id").cast("long")), fitted(docs, labels, per_label))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def toxicity_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted toxic, with the columns of docs."""
    scored = score_documents(docs, fitted(docs, labels), docs.columns)
    return scored.filter(F.col(scored.columns[-1]) < 0.5).select(*docs.columns)

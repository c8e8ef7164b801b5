"""Operator 10: language identification with a linear-chain conditional random field over words.

Each word (a run of letters) is labelled with a language. Emissions sum weights of hashed features: prefixes and suffixes of up
to three letters, character trigrams with word ends, the word itself, and the languages in whose lexicon (the LEXICON commonest words of the training texts) it
is. Transitions are learned too. Training is stochastic gradient on sequences of SPAN words cut from whole texts of a bounded sample (PER_LANG documents
of each language, however many languages there are; 24 million characters in all, shared evenly); each pass draws SPANS sequences of each language. Some
sequences are joined from two texts, so that switches occur. Marginals come from forward-backward; a document's language has
the largest mean marginal over all its words, which is its score.

Exact forward-backward on long texts runs in blocks: the transfer matrices of all blocks of a batch are multiplied side by
side, carried from block to block, and each block is then filled in. With more than FEW languages such matrices cost too much: the texts of a batch are then gone through side by side, word by
word. Memory is bounded in bytes whatever the texts and languages are: batches hold about CELLS numbers, a longer text is read in parts (forward with the state at each part's
beginning kept, then backward), words' emissions are kept up to KEPT bytes of words and numbers, and the table of feature weights has fewer buckets where there are many languages (WEIGHTS bytes). Both
ways give the same marginals.

und with score 0 if a text is null or has no letter, or if nothing could be learned. Ties go to the first language by name.
Repeated rows get equal labels; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserix.llm.sampling import sampled_texts
from tesserix.llm.words import letter_runs

BUCKETS, SPAN, BLOCK = 1 << 16, 48, 32
PER_LANG, SPANS, EPOCHS, LEXICON = 400, 1500, 2, 300
FOLDS, HELD_OUT = 4, 2
#: Numbers (words x languages) handled at once, bytes of words whose emissions are kept, and bytes of feature weights.
CELLS, KEPT, WEIGHTS = 1_600_000, 96 << 20, 64 << 20
#: Languages up to which blocks are multiplied.
FEW = 12


def buckets_for(languages: int) -> int:
    """Feature buckets: BUCKETS, or the power of two whose weights fit into WEIGHTS bytes."""
    return min(BUCKETS, 1 << max(10, (WEIGHTS // (4 * max(1, languages))).bit_length() - 1))


def features(word: str, lexicon: dict[str, int], buckets: int = BUCKETS) -> np.ndarray:
    e = f"<{word}>"
    names = {f"p{word[:k]}" for k in (1, 2, 3)} | {f"s{word[-k:]}" for k in (1, 2, 3)} | {f"t{e[i : i + 3]}" for i in range(len(e) - 2)} | {f"w{word}"}
    known = lexicon.get(word, 0)
    names |= {f"l{k}" for k in range(known.bit_length()) if known >> k & 1}
    return np.unique(np.array([zlib.crc32(n.encode("utf-8")) & (buckets - 1) for n in names], np.int64))


def chain_marginals(emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward for sequences of one length. emit: (steps, sequences, labels), exponentials; move: label to label; start:
    (sequences, labels). Gives marginals, expected moves summed over all, and the log of each sequence's sum."""
    n = len(emit)
    ahead, scale = np.empty_like(emit), np.empty(emit.shape[:2])
    a = start * emit[0]
    for t in range(n):
        if t:
            a = (ahead[t - 1] @ move) * emit[t]
        scale[t] = a.sum(1)
        ahead[t] = a / scale[t][:, None]
    back, moves = np.ones_like(emit), np.zeros_like(move)
    for t in range(n - 2, -1, -1):
        x = emit[t + 1] * back[t + 1] / scale[t + 1][:, None]
        moves += move * (ahead[t].T @ x)
        back[t] = x @ move.T
    return ahead * back, moves, np.log(scale).sum(0)


class Crf:
    """langs, feature weights (buckets, labels), log transitions and log starts."""

    def __init__(self, langs: list[str], lexicon: dict[str, int]):
        k = len(langs)
        self.langs, self.lexicon = langs, lexicon
        self.weights = np.zeros((buckets_for(k), k), np.float32)
        self.moves, self.starts = np.zeros((k, k)), np.zeros(k)

    def fit(self, texts: list[tuple[list[str], int]], seed: int = 5, epochs: int = EPOCHS, rate: float = 0.25, batch: int = 64) -> None:
        rng, memo, ids = np.random.default_rng(seed), {}, []

        def number(w):
            i = memo.get(w)
            if i is None:
                i = memo[w] = len(ids)
                ids.append(features(w, self.lexicon, len(self.weights)))
            return i

        spans, k = [], len(self.langs)
        for words, y in texts:
            x = np.array([number(w) for w in words], np.int64)
            for at in range(0, len(x), SPAN):
                part = x[at : at + SPAN]
                if len(part) < SPAN:
                    part = np.resize(part, SPAN)  # a short rest repeats
                spans.append((part, np.full(SPAN, y)))
        if not spans:
            return
        by_label = {y: [i for i, s in enumerate(spans) if s[1][0] == y] for y in range(k)}
        live = [y for y in range(k) if by_label[y]]
        each = max(1, min(len(spans) // len(live), SPANS))
        sizes = np.array([len(f) for f in ids])
        starts, flat = np.cumsum(sizes) - sizes, np.concatenate(ids)
        g_w, g_m, g_s = np.full(len(self.weights), 1e-3, np.float32), np.full((k, k), 1e-3), np.full(k, 1e-3)
        for _ in range(epochs):
            chosen = rng.permutation(np.concatenate([rng.choice(by_label[y], each) for y in live]))
            for lo in range(0, len(chosen), batch):
                x = np.stack([spans[i][0] for i in chosen[lo : lo + batch]]).T
                y = np.stack([spans[i][1] for i in chosen[lo : lo + batch]]).T
                x, y = x.copy(), y.copy()
                for j in range(0, x.shape[1] - 1, 4):  # every fourth sequence goes on as another one
                    cut = int(rng.integers(8, SPAN - 8))
                    x[cut:, j], y[cut:, j] = x[cut:, j + 1], y[cut:, j + 1]
                used, at = np.unique(x, return_inverse=True)
                feats = [ids[i] for i in used]
                n = np.array([len(f) for f in feats])
                every = np.concatenate(feats)
                emission = np.add.reduceat(self.weights[every], np.cumsum(n) - n, 0).astype(np.float64)
                e = emission[at.reshape(x.shape)]
                e -= e.max(2, keepdims=True)
                start = np.exp(self.starts - self.starts.max())
                p, moves, _ = chain_marginals(np.exp(e), np.exp(self.moves), np.tile(start, (x.shape[1], 1)))
                p /= p.sum(2, keepdims=True)
                p[np.arange(SPAN)[:, None], np.arange(x.shape[1])[None, :], y] -= 1
                p /= x.size
                grad = np.stack([np.bincount(at.reshape(-1), p[:, :, c].reshape(-1), len(used)) for c in range(k)], 1)
                spread = np.repeat(grad, n, 0)
                where, slot = np.unique(every, return_inverse=True)
                g = np.stack([np.bincount(slot, spread[:, c], len(where)) for c in range(k)], 1).astype(np.float32)
                g_w[where] += (g**2).sum(1)
                self.weights[where] -= rate * g / np.sqrt(g_w[where])[:, None]
                seen = np.zeros((k, k))
                np.add.at(seen, (y[:-1].reshape(-1), y[1:].reshape(-1)), 1)
                d = (moves - seen) / x.size + 1e-3 * self.moves
                g_m += d**2
                self.moves -= 0.1 * d / np.sqrt(g_m)
                d = (p[0].sum(0)) + 1e-3 * self.starts
                g_s += d**2
                self.starts -= 0.1 * d / np.sqrt(g_s)


class Labeller:
    """A fitted field applied to texts. Words' emissions are kept in a growing table, emptied at a bound of bytes."""

    def __init__(self, crf: Crf, most: int = KEPT, cells: int = CELLS):
        self.crf, self.k, self.most = crf, len(crf.langs), most
        self.span = max(BLOCK, cells // max(1, self.k) // BLOCK * BLOCK)  # words handled at once
        if self.k:
            self.move, start = np.exp(crf.moves - crf.moves.max()), np.exp(crf.starts - crf.starts.max())
            self.start = start / start.sum()
        self._empty()

    def _empty(self):
        self.at: dict[str, int] = {}
        self.emit, self.held = np.empty((1024, self.k)), 0

    def rows(self, words: list[str]) -> np.ndarray:
        """Exponentials of the words' emissions, the largest of each word 1."""
        at, out = self.at, []
        try:
            return self.emit[np.fromiter(map(at.__getitem__, words), np.int64, len(words))]
        except KeyError:
            pass
        new = [w for w in dict.fromkeys(words) if w not in at]
        size = sum(map(len, new)) + len(new) * (8 * self.k + 120)
        if self.held + size > self.most and at:
            self._empty()
            at = self.at
            new = list(dict.fromkeys(words))
            size = sum(map(len, new)) + len(new) * (8 * self.k + 120)
        if new:
            self.held += size
            e = self._emissions(new)
            while len(at) + len(new) > len(self.emit):
                self.emit = np.concatenate([self.emit, np.empty_like(self.emit)])
            self.emit[len(at) : len(at) + len(new)] = e
            for w in new:
                at[w] = len(at)
        out = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
        return self.emit[out]

    def _emissions(self, words: list[str]) -> np.ndarray:
        """Exponentials of the words' emissions, computed for about self.span features at a time; a word may be as long as a text."""
        out, group, n = np.empty((len(words), self.k)), [], 0

        def flush():
            if group:
                sizes = np.array([len(f) for _, f in group])
                flat = np.concatenate([f for _, f in group])
                out[[i for i, _ in group]] = np.add.reduceat(self.crf.weights[flat].astype(np.float64), np.cumsum(sizes) - sizes, 0)
            group.clear()

        for i, w in enumerate(words):
            found = features(w, self.crf.lexicon, len(self.crf.weights))
            if len(found) > self.span:
                out[i] = sum(self.crf.weights[found[low : low + self.span]].sum(0, dtype=np.float64) for low in range(0, len(found), self.span))
                continue
            if n + len(found) > self.span:
                flush()
                n = 0
            group.append((i, found))
            n += len(found)
        flush()
        return np.exp(np.maximum(out - out.max(1, keepdims=True), -30))

    def means(self, texts: list[list[str]]) -> np.ndarray:
        """The mean marginals of each text's words (none empty), in groups of about self.span words; longer texts in parts."""
        out = np.empty((len(texts), self.k))
        group, size = [], 0

        def flush():
            nonlocal size
            if group:
                emits = [self.rows(texts[i]) for i in group]
                for i, m in zip(group, self.marginals(emits) if self.k <= FEW else self._side_by_side(emits), strict=True):
                    out[i] = m.mean(0)
            group.clear()
            size = 0

        for i, words in enumerate(texts):
            if len(words) > self.span:
                out[i] = self._in_parts(words)
                continue
            if size + len(words) > self.span:
                flush()
            group.append(i)
            size += len(words)
        flush()
        return out

    def _in_parts(self, words: list[str]) -> np.ndarray:
        """The mean marginals of a text of any length: forward with the state before each part, then backward part by part."""
        parts, before, a = range(0, len(words), self.span), [], None
        for low in parts:
            before.append(a)
            for e in self.rows(words[low : low + self.span]):
                a = (self.start if a is None else a @ self.move) * e
                a /= a.sum()
        total, b = np.zeros(self.k), np.ones(self.k)
        for low, a in zip(reversed(parts), reversed(before), strict=True):
            emit = self.rows(words[low : low + self.span])
            ahead = np.empty_like(emit)
            for t, e in enumerate(emit):
                a = (self.start if a is None else a @ self.move) * e
                a /= a.sum()
                ahead[t] = a
            for t in range(len(emit) - 1, -1, -1):
                p = ahead[t] * b
                total += p / p.sum()
                b = self.move @ (emit[t] * b)
                b /= b.sum()
        return total / len(words)

    def _side_by_side(self, emits: list[np.ndarray]) -> list[np.ndarray]:
        """marginals() for many labels: the longest text first, so that those that go on at a step are the first ones."""
        order = sorted(range(len(emits)), key=lambda i: -len(emits[i]))
        sizes = np.array([len(emits[i]) for i in order])
        live = [int((sizes > t).sum()) for t in range(sizes[0])]
        begin = np.cumsum([0, *live])
        x = np.empty((begin[-1], self.k))
        for j, i in enumerate(order):
            x[begin[: len(emits[i])] + j] = emits[i]
        ahead, a = np.empty_like(x), np.tile(self.start, (live[0], 1))
        for t, n in enumerate(live):
            a = (a[:n] if t == 0 else a[:n] @ self.move) * x[begin[t] : begin[t] + n]
            a /= a.sum(1, keepdims=True)
            ahead[begin[t] : begin[t] + n] = a
        b = np.ones((live[0], self.k))
        for t in range(len(live) - 1, -1, -1):
            own = slice(begin[t], begin[t] + live[t])
            p = ahead[own] * b[: live[t]]
            ahead[own] = p / p.sum(1, keepdims=True)
            back = (x[own] * b[: live[t]]) @ self.move.T
            b[: live[t]] = back / back.sum(1, keepdims=True)
        out: list = [None] * len(emits)
        for j, i in enumerate(order):
            out[i] = ahead[begin[: len(emits[i])] + j]
        return out

    def marginals(self, emits: list[np.ndarray]) -> list[np.ndarray]:
        """Exact marginals of each text's words; emits: (words, labels) each, none empty."""
        k, move = self.k, self.move
        n_blocks = [-(-len(e) // BLOCK) for e in emits]
        total, first = sum(n_blocks), np.cumsum([0, *n_blocks])
        x, on = np.ones((total * BLOCK, k)), np.zeros(total * BLOCK, bool)
        for e, f in zip(emits, first[:-1], strict=True):
            x[f * BLOCK : f * BLOCK + len(e)], on[f * BLOCK : f * BLOCK + len(e)] = e, True
        x, on = np.ascontiguousarray(x.reshape(total, BLOCK, k).swapaxes(0, 1)), np.ascontiguousarray(on.reshape(total, BLOCK).T)
        opens = np.zeros(total, bool)
        opens[first[:-1]] = True
        whole = on.all(1)
        # the product of each block's transfer matrices; the first word of a text has no move before it
        product = np.tile(np.eye(k), (total, 1, 1))
        for t in range(BLOCK):
            after = (product.reshape(-1, k) @ move).reshape(total, k, k)
            if t == 0:
                after[opens] = product[opens]
            after *= x[t][:, None, :]
            after /= after.sum((1, 2), keepdims=True)
            product = after if whole[t] else np.where(on[t][:, None, None], after, product)
        ahead, behind = np.empty((total, k)), np.empty((total, k))
        counts = np.array(n_blocks)
        a, b = np.tile(self.start, (len(emits), 1)), np.ones((len(emits), k))
        for j in range(counts.max()):
            some = np.flatnonzero(counts > j)
            at = first[:-1][some] + j
            ahead[at] = a[some]
            a[some] = np.einsum("ni,nij->nj", a[some], product[at])
            a[some] /= a[some].sum(1, keepdims=True)
            at = first[1:][some] - 1 - j
            behind[at] = b[some]
            b[some] = np.einsum("nij,nj->ni", product[at], b[some])
            b[some] /= b[some].sum(1, keepdims=True)
        forward, a = np.empty_like(x), ahead
        for t in range(BLOCK):
            step = a @ move
            if t == 0:
                step[opens] = a[opens]
            step *= x[t]
            step /= step.sum(1, keepdims=True)
            a = step if whole[t] else np.where(on[t][:, None], step, a)
            forward[t] = a
        b = behind
        for t in range(BLOCK - 1, -1, -1):
            p = forward[t] * b
            forward[t] = p / p.sum(1, keepdims=True)
            step = (x[t] * b) @ move.T
            step /= step.sum(1, keepdims=True)
            b = step if whole[t] else np.where(on[t][:, None], step, b)
        flat = forward.swapaxes(0, 1).reshape(total * BLOCK, k)
        return [flat[f * BLOCK : f * BLOCK + len(e)] for e, f in zip(emits, first[:-1], strict=True)]

    def label_words(self, text: str) -> list[tuple[str, str]]:
        """Each word of a text with its likeliest language: for code-switched text."""
        words = letter_runs(text.lower())
        if not words:
            return []
        return [(w, self.crf.langs[i]) for w, i in zip(words, self.marginals([self.rows(words)])[0].argmax(1).tolist(), strict=True)]

    def documents(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        held, found, size = [], [], 0

        def flush():
            nonlocal size
            for i, mean in zip(held, self.means(found) if found else [], strict=True):
                best = int(mean.argmax())
                out[i] = (self.crf.langs[best], float(min(1.0, mean[best])))
            held.clear()
            found.clear()
            size = 0

        for i, text in enumerate(texts):
            words = letter_runs((text or "").lower())
            if words and self.k:
                held.append(i)
                found.append(words)
                size += len(words)
                if size > self.span:
                    flush()
        flush()
        return out


def train(sample: list[tuple[str, str]]) -> Crf:
    """sample: (text, lang), bounded."""
    langs = sorted({y for _, y in sample})
    texts = [(letter_runs(t.lower()), langs.index(y)) for t, y in sample]
    common = [Counter() for _ in langs]
    for words, y in texts:
        common[y].update(words)
    lexicon: dict[str, int] = {}
    for y, c in enumerate(common):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon[w] = lexicon.get(w, 0) | 1 << y
    crf = Crf(langs, lexicon)
    crf.fit(texts)
    return crf


def fold(doc_id, k: int = FOLDS):
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % k


def fitted(docs: DataFrame, per_lang: int = PER_LANG) -> Crf:
    known = docs.filter((fold(F.col("doc_id")) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("label"))
    return train(sampled_texts(known, known.select("doc_id", "label"), per_lang, "lang"))


_LABELLERS: dict = {}


def shared_labeller(key: str, crf: Crf) -> Labeller:
    """One per Python worker and model."""
    if key not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[key] = Labeller(crf)
    return _LABELLERS[key]


def languages(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    crf = crf or fitted(docs)
    # feature weights: 4 bytes x BUCKETS x languages, whatever the corpus
    model = docs.sparkSession.sparkContext.broadcast((crf.langs, crf.lexicon, crf.weights, crf.moves, crf.starts))
    key = f"{id(crf)}-{float(np.abs(crf.weights).sum())}"

    def run(batches):
        from tesserix.llm import langid

        langs, lexicon, weights, moves, starts = model.value
        own = langid.Crf(langs, lexicon)
        own.weights, own.moves, own.starts = weights, moves, starts
        labeller = langid.shared_labeller(key, own)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                found = labeller.documents(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "lang_pred", "score")

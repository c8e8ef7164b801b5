"""Operator 8: byte-pair encoding and decoding with a word-end vocabulary, and what operator 2 needs of it.

A text is split at special tokens, normalised (NFC, lower case) and cut into words; each word's bytes become symbols, the last
one with </w>. Characters that Python's Unicode tables don't know are left to the library's own cutting into words. Short words are merged in a contiguous array: part boundaries and the ranks of adjacent pairs; the least rank is
searched by scanning, its boundary is deleted, and the two neighbouring ranks are looked up again. Words over LONG symbols
use the same merges with a heap, so that their time doesn't grow with the square. Encoded words are kept in a bounded memo.

Null text: empty, no ids, decoded text "". Ids and decoded text equal the tokenizers library's (no decoder is configured, so
decode joins tokens by one space). Rows with equal texts give equal values; an empty table an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserix.llm.words import Memo

LONG = 64
#: How the vocabulary's file says that texts are normalised and cut (fixed by the file); other files are refused.
EXPECTED = {"normalizers": ["NFC", "Replace", "Lowercase"], "pretokenizers": ["Split", "ByteLevel"], "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
#: White space as the vocabulary's library sees it; the separators 1C to 1F aren't in it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The vocabulary's pattern (fixed by its file).
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
#: The last code point that the quick way takes, lower-cased or not.
LAST = 0x24F
#: Letters up to LAST in lower case.
LOW_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-" + chr(LAST)
LOW_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: What the quick way takes: white space of ASCII, printable ASCII, and from U+00A1 to LAST whatever stays there when it is lower-cased.
QUICK = "\t\n\x0b\x0c\r\x20-\x7e" + "".join(chr(c) for c in range(0xA1, LAST + 1) if all(ord(x) <= LAST for x in chr(c).lower()))
#: Anything else takes the slow way.
UNUSUAL = re.compile(f"[^{QUICK}]|<\\|")
#: The pattern for lower-cased text without unusual characters, where letters and numbers are plain ranges.
USUAL = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LOW_LETTERS}]+|[{LOW_NUMBERS}]|[^{LOW_LETTERS}{LOW_NUMBERS}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def splits_at_spaces(path: str) -> bool:
    """Whether a vocabulary file normalises and cuts as EXPECTED says, which is what this module does."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal, cut = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = [s["type"] for s in normal.get("normalizers", [])]
    parts = cut.get("pretokenizers", [])
    return (
        steps == EXPECTED["normalizers"] and [p["type"] for p in parts] == EXPECTED["pretokenizers"] and parts[0]["pattern"].get("Regex") == EXPECTED["pattern"]
        and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not parts[1]["add_prefix_space"] and spec["model"]["type"] == "BPE"
    )


class Bpe:
    def __init__(self, path: str):
        if not splits_at_spaces(path):
            raise ValueError(f"{path} normalises or cuts texts in another way than this encoder")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            if a in self.vocab and b in self.vocab and a + b in self.vocab:
                self.pairs.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.symbols, self.path = byte_symbols(), path
        self.word = Memo(self._encode_word, 56 << 20)
        self.chunk = Memo(self._encode_chunk, 32 << 20)

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _encode_word(self, word: str) -> bytes:
        return self._encode_marks([self.symbols[b] for b in word.encode("utf-8")])

    def _encode_marks(self, marks: list[str]) -> bytes:
        marks[-1] += self.end
        ids = [i for m in marks if (i := self.vocab.get(m)) is not None]
        ids = self._merge_short(ids) if len(ids) <= LONG else self._merge_long(ids)
        return np.array(ids, "<u4").tobytes()

    def _merge_short(self, ids: list[int]) -> list[int]:
        """ids[i] is the part that begins at boundary i; ranks[i] the rank of parts i and i + 1."""
        none, pairs = (1 << 60, -1), self.pairs
        ranks = [pairs.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            at = ranks.index(best)
            ids[at] = best[1]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = pairs.get((ids[at], ids[at + 1]), none)
            if at:
                ranks[at - 1] = pairs.get((ids[at - 1], ids[at]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, pairs = len(ids), self.pairs
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], after[i] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) < n and (r := pairs.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[y], r[1]))
        return [x for x, ok in zip(ids, live, strict=True) if ok]

    def _encode_chunk(self, chunk: bytes) -> bytes | None:
        text = chunk.decode("utf-8")
        return None if UNUSUAL.search(text) else b"".join(map(self.word.__getitem__, USUAL.findall(text.lower())))

    def _encode_unusual(self, text: str) -> bytes:
        out = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            if any(unicodedata.category(c) == "Cn" for c in set(part)):
                # Python's tables don't know this character, the library's may: it cuts the words
                cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                out += [self._encode_marks(list(w)) for w, _ in cut]
                continue
            low = "".join([c.lower() for c in unicodedata.normalize("NFC", part)])  # letter by letter: no final-sigma rule
            out += [self.word[w] for w in PATTERN.findall(low)]
        return b"".join(out)

    def encode_bytes(self, raw: bytes) -> bytes:
        """UTF-8 to ids as little-endian unsigned 32-bit integers. bytes.split() cuts at ASCII white space only, which the vocabulary
        drops too; a piece with unusual characters has no entry, and its whole text goes the slow way."""
        try:
            return b"".join(map(self.chunk.__getitem__, raw.split()))
        except TypeError:
            return self._encode_unusual(raw.decode("utf-8"))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text.encode("utf-8")), "<u4")

    def decode(self, ids) -> str:
        get = self.tokens.get
        return " ".join([t for i in ids if (t := get(i)) is not None])


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """One per Python worker: the vocabulary is read once."""
    return Bpe(path)


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs (doc_id, text, ...) to (doc_id, ids array<int>)."""

    def run(batches):
        coder = bpe(vocabulary)
        for b in batches:
            found = [coder.encode(t or "") for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)])
            flat = np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, ids, decoded)."""

    def run(batches):
        coder = bpe(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([coder.decode(i or ()) for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, decoded and digested in one pass."""

    def run(batches):
        coder = bpe(vocabulary)
        for b in batches:
            counts, ids_hex, text_hex = [], [], []
            for text in b.column(1).cast(pa.binary()):
                raw = coder.encode_bytes(text.as_py() or b"")
                counts.append(len(raw) // 4)
                ids_hex.append(hashlib.sha256(raw).hexdigest())
                text_hex.append(hashlib.sha256(coder.decode(np.frombuffer(raw, "<u4").tolist()).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

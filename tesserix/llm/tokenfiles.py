"""Operator 2: token-id output. Shards of flat unsigned integers with 64-bit document offsets, and their reader.

A store is a folder with, per shard, tokens-<shard>.bin (ids, little-endian; 16 bits where the vocabulary fits, else 32) and
offsets-<shard>.bin (signed 64-bit: doc ids, then n + 1 offsets in ids). Shards hold ascending ranges of doc_id; the manifest
table gives each shard's documents and tokens, and prefix sums over it give each shard its base: a document's global start is
base + offset. Readers map local files into memory; other stores are read as bytes through Arrow's file systems.

Files are written under a name of their attempt and then moved, and their content depends on the input alone, so repeated or
speculative tasks leave whole files. Null text: empty, so only the end id. Rows with equal doc_id lie next to each other by a
hash of the text. Null doc_ids come first. Texts of any length are streamed to the file; other columns are ignored, whatever their names. An empty table gives no shard and an empty result.
"""

from __future__ import annotations

import os
import sys
import uuid
import zlib
from array import array
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserix.llm.bpe import UNUSUAL, splits_at_spaces
from tesserix.llm.words import Memo, opened
from tesserix.runtime import fresh

END_ID = 1
NULL_ID = np.iinfo(np.int64).min


class LibraryEncoder:
    """Ids by the tokenizers library. Where its file says that white space separates and is dropped (see splits_at_spaces), a text is cut at ASCII white
    space, and its new pieces go through the library together, once, and are kept in a memo of bounded size; texts with unusual characters or control
    strings, and all texts under other files, go to the library whole."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.by_piece = splits_at_spaces(vocabulary)
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        self.piece = Memo(self._piece, 224 << 20)

    def _raw(self, ids: list[int]) -> bytes:
        raw = array(self.kind, ids)
        if sys.byteorder == "big":
            raw.byteswap()
        return raw.tobytes()

    def _piece(self, piece: bytes) -> bytes | None:
        text = piece.decode("utf-8")
        return None if UNUSUAL.search(text) else self._raw(self.library.encode(text, add_special_tokens=False).ids)

    def _learn(self, pieces: list[bytes]) -> None:
        """Pieces to the library in one text, parted by spaces; offsets tell whose an id is."""
        texts = [p.decode("utf-8") for p in pieces]
        if UNUSUAL.search(" ".join(texts)):
            for p, t in zip(pieces, texts, strict=True):
                if UNUSUAL.search(t):
                    self.piece.keep(p, None)
            pieces = [p for p, t in zip(pieces, texts, strict=True) if not UNUSUAL.search(t)]
            texts = [p.decode("utf-8") for p in pieces]
        found = self.library.encode(" ".join(texts), add_special_tokens=False)
        raw, starts, each = self._raw(found.ids), [o[0] for o in found.offsets], self.dtype.itemsize
        k, end, keep = 0, -1, self.piece.keep
        for p, t in zip(pieces, texts, strict=True):
            end += 1 + len(t)
            j = bisect_left(starts, end, k)
            keep(p, raw[k * each : j * each])
            k = j

    def encode(self, raw: bytes) -> bytes:
        """A text's ids as bytes of dtype. A piece with unusual characters has no entry."""
        if self.by_piece:
            pieces, memo = raw.split(), self.piece
            new = [p for p in dict.fromkeys(pieces) if p not in memo and p not in memo.old]
            if len(new) > 1:
                self._learn(new)
            try:
                return b"".join(map(memo.__getitem__, pieces))
            except TypeError:
                pass
        return self._raw(self.library.encode(raw.decode("utf-8"), add_special_tokens=False).ids)


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> LibraryEncoder:
    return LibraryEncoder(vocabulary)


class ShardWriter:
    """Streams one shard: ids go to the file as they come, only the offsets stay in memory."""

    def __init__(self, folder: str, shard: int, dtype: np.dtype):
        self.fs, self.base = opened(folder)
        self.fs.create_dir(self.base, recursive=True)
        self.shard, self.dtype, self.mark = shard, dtype, uuid.uuid4().hex[:8]
        self.tmp = f"{self.base}/.tokens-{shard:06d}-{self.mark}"
        self.out = self.fs.open_output_stream(self.tmp)
        self.doc_ids: list[int] = []
        self.ends: list[int] = [0]

    def add(self, doc_id: int | None, raw: bytes) -> None:
        self.out.write(raw)
        self.doc_ids.append(NULL_ID if doc_id is None else doc_id)
        self.ends.append(self.ends[-1] + len(raw) // self.dtype.itemsize)

    def close(self) -> tuple[int, int]:
        self.out.close()
        self.fs.move(self.tmp, f"{self.base}/tokens-{self.shard:06d}.bin")
        with self.fs.open_output_stream(tmp := f"{self.base}/.offsets-{self.shard:06d}-{self.mark}") as f:
            f.write(np.array(self.doc_ids, "<i8").tobytes() + np.array(self.ends, "<i8").tobytes())
        self.fs.move(tmp, f"{self.base}/offsets-{self.shard:06d}.bin")
        return len(self.doc_ids), self.ends[-1]


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Write docs to folder in ascending doc_id order; returns the manifest (shard, n_docs, n_tokens, base, dtype)."""

    def run(batches):
        from pyspark import TaskContext

        shard, coder = TaskContext.get().partitionId(), encoder(vocabulary)
        end, writer = np.array([end_id], coder.dtype).tobytes(), None
        for b in batches:
            writer = writer or ShardWriter(folder, shard, coder.dtype)
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                writer.add(doc_id, coder.encode(text.as_py() or b"") + end)
        if writer:
            n_docs, n_tokens = writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "n_docs": n_docs, "n_tokens": n_tokens, "dtype": coder.dtype.str}])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    # rows that share a doc_id are parted by their texts' hash
    ordered = ordered.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    # one row per shard, far fewer than documents: they come to the driver, which adds up the bases
    rows, base = [], 0
    for r in sorted(ordered.mapInArrow(run, "shard long, n_docs long, n_tokens long, dtype string").collect(), key=lambda r: r["shard"]):
        rows.append((r["shard"], r["n_docs"], r["n_tokens"], r["dtype"], base))
        base += r["n_tokens"]
    return docs.sparkSession.createDataFrame(rows, "shard long, n_docs long, n_tokens long, dtype string, base long")


class Remote:
    """A file of numbers in a store that can't be mapped: slices are read when they are asked for."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype: np.dtype):
        self.file, self.dtype = fs.open_input_file(path), dtype
        self.size = self.file.size() // dtype.itemsize

    def __getitem__(self, at: slice) -> np.ndarray:
        start, stop, _ = at.indices(self.size)
        return np.frombuffer(self.file.read_at(max(0, stop - start) * self.dtype.itemsize, start * self.dtype.itemsize), self.dtype)


class TokenStore:
    """A shard for reading: ids(i) is the i-th document's ids, without copying where the file can be mapped."""

    def __init__(self, folder: str, shard: int, dtype: str):
        fs, base = opened(folder)
        names = [f"{base}/{kind}-{shard:06d}.bin" for kind in ("tokens", "offsets")]
        if isinstance(fs, pafs.LocalFileSystem):
            read = lambda p, t: np.memmap(p, t, "r") if os.path.getsize(p) else np.empty(0, t)
        else:
            read = lambda p, t: Remote(fs, p, t)
        self.tokens, index = read(names[0], np.dtype(dtype)), read(names[1], np.dtype("<i8"))
        index = index[:]
        n = (len(index) - 1) // 2
        self.doc_ids, self.offsets = index[:n], index[n:]

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> np.ndarray:
        return self.tokens[self.offsets[i] : self.offsets[i + 1]]


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, shard."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                store = TokenStore(folder, row["shard"], row["dtype"])
                for at in range(0, len(store), 4096):
                    some = range(at, min(len(store), at + 4096))
                    offsets = np.asarray(store.offsets[at : some.stop + 1])
                    crcs = [zlib.crc32(store.ids(i).astype("<u4").tobytes()) for i in some]
                    doc_ids = np.asarray(store.doc_ids[at : some.stop])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids, pa.int64(), mask=doc_ids == NULL_ID), pa.array(offsets[:-1] + row["base"], pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(crcs, pa.int64()), pa.array([row["shard"]] * len(some), pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                    )

    # reading is light: a task takes some four shards
    spread = manifest.repartition(max(1, -(-manifest.count() // 4)), "shard")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def token_files(spark: SparkSession, docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    folder = folder or fresh(spark, "token-files")
    return read_tokens(write_tokens(docs, folder, vocabulary), folder)

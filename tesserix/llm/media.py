"""Operator 6 on DataFrames: a binary column of lossless WebP images made from texts, and pixel arrays and features out of it.

A text's UTF-8 bytes and zeros up to a positive multiple of 64 are the grey samples. Null text: empty, so one row of zeros.
Equal texts give equal images and values. Documents of more than 64 x 16384 bytes take several images, one after the other. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserix.llm import webp

#: Arrow's batches are cut so that no more than this many bytes of images are made at once.
MOST_BYTES = 24 << 20
KINDS = ("literals", "links", "cached")


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, n_bytes, media)."""

    def run(batches):
        for b in batches:
            rows, size = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n, payload = payload_of(text.as_py())
                rows.append((doc_id, n, webp.store_bytes(payload)))
                size += len(payload)
                if size > MOST_BYTES:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pixel_arrays(media: DataFrame) -> DataFrame:
    """(doc_id, media, ...) to (doc_id, image, width, height, pixels): pixels are R, G, B, A bytes row by row."""

    def run(batches):
        for b in batches:
            for doc_id, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for k, p in enumerate(webp.images(data.as_py())):
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "image": k, "width": p.shape[1], "height": p.shape[0], "pixels": p.tobytes()}], pa.schema([("doc_id", pa.int64()), ("image", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())]))

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, image int, width int, height int, pixels binary")


LEVELS = np.arange(256)
SQUARES = LEVELS * LEVELS


def feature_of(samples: np.ndarray) -> str:
    """Rows, mean, deviation, entropy and mean step of the samples, as text."""
    n, counts = len(samples), np.bincount(samples, minlength=256)
    p = counts[counts > 0] / n
    mean = int(counts @ LEVELS) / n
    spread = max(0.0, int(counts @ SQUARES) / n - mean * mean) ** 0.5
    grid = samples.reshape(-1, webp.ROW)
    a, b = grid[:, 1:], grid[:, :-1]
    step = int((np.maximum(a, b) - np.minimum(a, b)).sum(dtype=np.int64)) / a.size
    return f"rows={n // webp.ROW};levels={len(p)};mean={mean:.4f};std={spread:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};step={step:.4f}"


def media_digests(docs: DataFrame) -> DataFrame:
    """The digests of the contract, read back from the media column; and what the stored images hold: transforms, literals, links (back-references), cached."""

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                media = data.as_py()
                told: dict = {}
                samples = webp.unpack_bytes(media, told)
                back = samples.tobytes()
                rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(samples), ",".join(sorted(told["transforms"])), *(told.get(k, 0) for k in KINDS)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "transforms", *KINDS])

    return encode_media(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, transforms string, literals long, links long, cached long")

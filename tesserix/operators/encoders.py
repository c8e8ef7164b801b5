"""Scores by an injected encoder, one model a worker, images in batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tesserix.functions.scalars import clamp

#: What a row gives that can't be read or encoded.
UNKNOWN = 0.5


def probed(make: Callable, probe: np.ndarray) -> int:
    """The encoder's width, from one image on the driver: a broken encoder is an error before any job begins."""
    try:
        out = np.asarray(make()(probe[None]), np.float64)
    except Exception as e:
        raise RuntimeError(f"the encoder fails on a plain image: {e}") from e
    if out.ndim != 2 or len(out) != 1 or not np.isfinite(out).all():
        raise RuntimeError(f"the encoder gives {out.shape} for one image, or numbers that aren't finite")
    return out.shape[1]


def encoded(images: DataFrame, make: Callable, probe: np.ndarray, batch: int = 64) -> DataFrame:
    """images (height, width, pixels, ...) with features (array<double>), null where an image can't be read or encoded.

    make() loads the model, once per Python worker, and gives a function from an array (images, height, width, 3) to one (images, numbers). Images of a batch are put
    together by their sizes; a call that fails is repeated image by image, so that one bad image doesn't take others along. probe: an image that the driver tries first."""
    width = probed(make, probe)

    def load():
        model = make()

        def some(a: np.ndarray) -> np.ndarray:
            out = np.asarray(model(a), np.float64)
            if out.shape != (len(a), width):
                raise ValueError(f"{out.shape} numbers for {len(a)} images")
            return out

        def predict(height: np.ndarray, across: np.ndarray, pixels: np.ndarray) -> np.ndarray:
            found, sizes = np.full((len(pixels), width), np.nan), {}
            for i, (h, w, p) in enumerate(zip(height, across, pixels, strict=True)):
                if p is not None and h == h and w == w and h > 0 and w > 0 and len(p) == int(h) * int(w) * 3:
                    sizes.setdefault((int(h), int(w)), []).append(i)
            for (h, w), rows in sizes.items():
                a = np.stack([np.frombuffer(pixels[i], np.uint8).reshape(h, w, 3) for i in rows])
                try:
                    found[rows] = some(a)
                except Exception:
                    for i, one in zip(rows, a, strict=True):
                        try:
                            found[i] = some(one[None])[0]
                        except Exception:  # noqa: S112  this row alone stays unknown
                            continue
            return found

        return predict

    udf = predict_batch_udf(load, return_type=ArrayType(DoubleType()), batch_size=batch)
    out = images.withColumn("features", udf("height", "width", "pixels"))
    finite = F.forall("features", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    return out.withColumn("features", F.when(finite, F.col("features")))


def scored(images: DataFrame, make: Callable, probe: np.ndarray, head: Callable, batch: int = 64) -> DataFrame:
    """images with pred: head(features), clamped to 0..1; UNKNOWN for images without features."""
    rows = encoded(images, make, probe, batch)
    return rows.withColumn("pred", F.when(F.col("features").isNull(), F.lit(UNKNOWN)).otherwise(clamp(head(F.col("features"))))).drop("features")

"""Score a folder of images: python -m tesserix.cli --input_dir D --output O [--weights HEAD.json]

The encoder is a function image -> vector named by --encoder module:function (default: the 28 forensic statistics). Without
--weights scores are those of a head of zeros, 0.5. Output: a JSON array of {image_path, pred}, one row per image, also for broken files (0.5).
"""

from __future__ import annotations

import argparse
import importlib
import os

import numpy as np


def score_folder(spark, folder: str, encode, head=None) -> list:
    """(path, pred) rows; a missing folder gives none."""
    from pyspark.sql import functions as F

    from tesserix.operators import images

    if not os.path.isdir(folder):
        return []
    decoded = images.decode_images(spark, folder)
    width = len(encode(np.zeros((8, 8, 3), np.uint8)))
    if head is not None and len(head.weights) != width:
        raise ValueError(f"the encoder gives {width} numbers, the head takes {len(head.weights)}")
    std = np.array([s if s > 0 else 1.0 for s in head.std]) if head else np.ones(width)
    weights = np.array(head.weights) / std if head else np.zeros(width)
    bias = head.bias - float(np.array(head.mean) @ weights) if head else 0.0
    good = images.scored(decoded.filter("pixels IS NOT NULL"), ["path"], encode, weights, bias)
    return good.unionByName(decoded.filter("pixels IS NULL").select("path", F.lit(0.5).alias("pred"))).collect()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--input_dir", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--weights")
    p.add_argument("--encoder", default="tesserix.functions.pixels:forensic")
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    from tesserix.runtime import ship
    from tesserix.sources.files import load_head, write_json

    module, _, name = a.encoder.partition(":")
    encode = getattr(importlib.import_module(module), name)
    head = load_head(a.weights)[0] if a.weights else None
    spark = SparkSession.builder.appName("score").getOrCreate()
    ship(spark)
    rows = score_folder(spark, a.input_dir, encode, head)
    write_json(a.output, [{"image_path": r["path"], "pred": r["pred"]} for r in sorted(rows, key=lambda r: r["path"])])


if __name__ == "__main__":
    main()

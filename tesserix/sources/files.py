"""Files in and out: configuration, report tables, feature caches, predictions, heads, receipts."""

from __future__ import annotations

import hashlib
import json
import math
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserix.functions.scalars import clamp
from tesserix.operators.heads import LinearHead
from tesserix.operators.tables import keep_last


def read_config(path: str, root: str | None = None) -> dict:
    """JSON or YAML configuration, by suffix; values of keys that end in _dir are resolved against root (the file's folder unless given)."""
    text = Path(path).read_text(encoding="utf-8")
    conf = _yaml(text) if str(path).lower().endswith((".yaml", ".yml")) else json.loads(text)
    base = Path(root or os.path.dirname(os.path.abspath(path)))
    return {k: str(base / v) if k.endswith("_dir") and isinstance(v, str) and not os.path.isabs(v) else v for k, v in conf.items()}


def _yaml(text: str) -> dict:
    """YAML by its library, which is optional; files that are JSON need none."""
    try:
        import yaml
    except ImportError as e:
        raise ImportError("YAML configurations need the yaml library; JSON ones don't") from e
    return yaml.safe_load(text) or {}


def _no_nan(v):
    if isinstance(v, float) and not math.isfinite(v):
        raise ValueError("a number that isn't finite has no place in JSON")
    for x in v.values() if isinstance(v, dict) else v if isinstance(v, (list, tuple)) else ():
        _no_nan(x)


def write_json(path: str, value) -> None:
    """Whole or not at all: written beside its place and then renamed; NaN is refused."""
    _no_nan(value)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    tmp = f"{path}.{os.getpid()}.tmp"
    Path(tmp).write_text(json.dumps(value, indent=2, sort_keys=True), encoding="utf-8")
    os.replace(tmp, path)


def read_table(spark: SparkSession, paths: list[str], schema: str, key: str = "transform") -> DataFrame:
    """Report tables from CSV; the last row of a key wins. schema: DDL of the columns."""
    rows = None
    for i, p in enumerate(paths):
        part = spark.read.csv(p, header=True, schema=schema, mode="PERMISSIVE").withColumn("__part", F.lit(i)).withColumn("__row", F.monotonically_increasing_id())
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return keep_last(rows, [key], ["__part", "__row"]).drop("__part", "__row")


def write_table(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """CSV with a header; of the asked fields those that df lacks are blank."""
    if fields:
        df = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields])
    df.write.mode("overwrite").csv(path, header=True)


def write_features(df: DataFrame, path: str) -> None:
    """A feature cache, a folder per role; other roles' folders stay. Spark's committer moves a role's files in when all of them are written."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("role").parquet(path)


def read_features(spark: SparkSession, path: str, role: str, variant: str = "x") -> DataFrame:
    """One role of a feature cache; only its folder is read. Caches hold one column per variant; older ones have a single column x, which stands for any
    variant, and no n_views (views per original), which is then counted."""
    from pyspark.sql import Window

    rows = spark.read.parquet(path).filter(F.col("role") == role)
    if variant not in rows.columns:
        if "x" not in rows.columns:
            raise ValueError(f"{path} has neither {variant} nor x")
        rows = rows.withColumn(variant, F.col("x"))
    if "n_views" not in rows.columns:
        rows = rows.withColumn("n_views", F.count(F.lit(1)).over(Window.partitionBy("grp")))
    return rows


def write_predictions(df: DataFrame, path: str, name: str = "path", pred: str = "pred") -> None:
    """One JSON line per image with exactly image_path and pred, clamped; in parts, so that no machine holds them all."""
    df.select(F.col(name).alias("image_path"), clamp(F.col(pred)).alias("pred")).write.mode("overwrite").json(path)


def predictions_array(df: DataFrame, name: str = "path", pred: str = "pred") -> str:
    """The same as one JSON array in order of path, for a folder's worth of images."""
    rows = df.select(F.col(name).alias("image_path"), clamp(F.col(pred)).alias("pred")).orderBy("image_path").collect()
    return json.dumps([r.asDict() for r in rows], indent=2)


def save_head(path: str, head: LinearHead, meta: dict) -> None:
    write_json(path, {"head": {"mean": head.mean, "std": head.std, "weights": head.weights, "bias": head.bias}, "meta": meta})


def load_head(path: str) -> tuple[LinearHead, dict]:
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path}: no head here; fit one and save_head() it first")
    bundle = json.loads(Path(path).read_text(encoding="utf-8"))
    return LinearHead(**bundle["head"]), bundle["meta"]


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """path (below folder) and sha256 of every file, for receipts; files are digested where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("sha256"))


def file_digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()

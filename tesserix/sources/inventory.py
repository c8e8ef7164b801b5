"""An inventory of protected files: digests by path, kept up to date by reading only what is new or has changed."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserix.sources.scan import opened, with_back_off

SCHEMA = "path string, size long, changed timestamp, sha256 string"


def _versions(store: str) -> list[int]:
    """The numbers of the whole versions in the store, in order."""
    fs, path = opened(store)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return []
    found = [i for i in fs.get_file_info(pafs.FileSelector(path)) if i.base_name.startswith("v")]
    return sorted(int(i.base_name[1:]) for i in found if fs.get_file_info(f"{i.path}/_SUCCESS").type == pafs.FileType.File)


def _digests(batches):
    for b in batches:
        out = []
        for path in b.column(0).to_pylist():

            def read(path=path):
                fs, at = opened(path)
                h = hashlib.sha256()
                with fs.open_input_stream(at) as f:
                    while part := f.read(1 << 20):
                        h.update(part)
                return h.hexdigest()

            out.append(with_back_off(read))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "sha256"])


def inventory(spark: SparkSession, folder: str, store: str, required: int = 2000, pattern: str = "*", told: dict | None = None) -> DataFrame:
    """path, size, changed, sha256 of all files below folder whose names fit pattern; told gets files and hashed (how many were read).

    The store (a folder that driver and executors share) keeps versions. Files whose path, size and time of change are in the last whole version keep their digests and aren't read; of all others
    every byte is, piece by piece. Fewer than `required` files are an error, before anything is read, so that a missing folder protects nothing silently. A version is written beside
    the others and counts once it is whole; the one before it stays until then."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    files = there.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed"))  # no content is read for these
    n = files.count()
    if n < required:
        raise ValueError(f"{n} protected files below {folder}, {required} are required")
    versions = _versions(store)
    old = spark.read.schema(SCHEMA).parquet(f"{store}/v{versions[-1]}") if versions else spark.createDataFrame([], SCHEMA)
    kept = files.join(old, ["path", "size", "changed"])
    new = files.join(old, ["path", "size", "changed"], "left_anti").repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(_digests, SCHEMA)
    place = f"{store}/v{(versions[-1] if versions else 0) + 1}"
    kept.select("path", "size", "changed", "sha256", F.lit(False).alias("hashed")).unionByName(new.withColumn("hashed", F.lit(True))).write.mode("overwrite").parquet(place)
    done = spark.read.parquet(place)
    if told is not None:
        told.update(files=n, hashed=done.filter("hashed").count())
    fs, _ = opened(store)
    for v in versions[:-1]:
        fs.delete_dir(opened(f"{store}/v{v}")[1])
    return done.select("path", "size", "changed", "sha256")

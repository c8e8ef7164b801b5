"""Parquet row groups as units of reading: a scan that stops when its quotas are met, and a stream over a split with a fallback.

Files are listed by name, and a unit is (file, row group) in that order; footers are read when their file's turn comes. Executors read units through Arrow's file systems (local, HDFS, S3, GCS),
only the columns asked for, in batches of BATCH rows.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tesserix.runtime import forget, saved

BATCH, FIRST_WAVE, LARGEST_WAVE = 1024, 1, 4096
ATTEMPTS, WAIT = 4, 0.5


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    return pafs.FileSystem.from_uri(uri if re.match(r"\w+://|file:/", uri) else f"file://{uri}")


def listed(folder: str) -> list[str]:
    """The Parquet files below a folder by name, or the file itself; none if it isn't there."""
    fs, path = opened(folder)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        return []
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
    hidden = re.compile(r"(^|/)[._]")
    return sorted(i.path for i in found if i.type == pafs.FileType.File and i.path.endswith(".parquet") and not hidden.search(i.path[len(path) :]))


def with_back_off(work, attempts: int = ATTEMPTS, wait: float = WAIT):
    """work(), tried again after failures, each time after twice the wait."""
    for k in range(attempts):
        try:
            return work()
        except Exception:
            if k == attempts - 1:
                raise
            time.sleep(wait * 2**k)
    return None


def units(folder: str) -> Iterator[tuple[str, int, int]]:
    """(file, row group, rows), lazily."""
    fs, _ = opened(folder)
    for path in listed(folder):
        meta = with_back_off(lambda path=path: pq.read_metadata(path, filesystem=fs))
        for g in range(meta.num_row_groups):
            yield path, g, meta.row_group(g).num_rows


def read_unit(folder: str, path: str, group: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches of a unit. A failure begins the unit again and skips the batches that were given out."""
    given = 0
    for k in range(ATTEMPTS):
        try:
            fs, _ = opened(folder)
            with fs.open_input_file(path) as f:
                for i, b in enumerate(pq.ParquetFile(f).iter_batches(BATCH, row_groups=[group], columns=columns)):
                    if i >= given:
                        given += 1
                        yield b
            return
        except OSError:
            if k == ATTEMPTS - 1:
                raise
            time.sleep(WAIT * 2**k)


def scan_until_full(spark: SparkSession, folder: str, schema: StructType, key: str, quotas: dict, told: dict | None = None) -> DataFrame:
    """The first rows of each key in the order of files, row groups and rows, up to its quota: columns of schema, nothing else is read.

    Units are read in waves of twice the size of the last one, each by as many tasks; a unit gives at most quota rows a key. After a wave its rows are counted, and when all
    quotas are met no further wave is planned, nor a further footer read: what is read is at most about twice what was needed, however large the table is. Keys without a
    quota, null ones too, are left out. told: gets units (read), rows (read) and full."""
    names = [f.name for f in schema]
    at, order = names.index(key), ["__unit", "__row"]
    todo, have, parts, wave, base, seen = units(folder), dict.fromkeys(quotas, 0), [], FIRST_WAVE, 0, 0
    shape = StructType([*schema.fields, *spark.createDataFrame([], "__unit long, __row long").schema.fields])
    full = lambda: all(have[k] >= n for k, n in quotas.items())
    while not full():
        own = [u for _, u in zip(range(wave), todo, strict=False)]
        if not own:
            break
        rows = [(base + i, path, group) for i, (path, group, _) in enumerate(own)]
        base, seen = base + len(own), seen + sum(n for _, _, n in own)
        left = {k: max(0, n - have[k]) for k, n in quotas.items()}

        def run(batches, left=left):
            for b in batches:
                for unit, path, group in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    got, row = dict.fromkeys(left, 0), 0
                    for part in read_unit(folder, path, group, names):
                        part = pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in names], names)
                        keep = []
                        for i, k in enumerate(part.column(at).to_pylist()):
                            if k in got and got[k] < left[k]:
                                got[k] += 1
                                keep.append(i)
                        if keep:
                            some = part.take(pa.array(keep))
                            yield pa.RecordBatch.from_arrays([*some.columns, pa.array([unit] * len(keep), pa.int64()), pa.array([row + i for i in keep], pa.int64())], [*names, *order])
                        row += part.num_rows

        plan = spark.createDataFrame(rows, "unit long, path string, row_group int").repartition(len(rows), "unit")
        parts.append(part := saved(plan.mapInArrow(run, shape), "scan-wave"))
        for r in part.groupBy(key).agg(F.count(F.lit(1)).alias("n")).collect():  # at most one row a quota
            have[r[key]] += r["n"]
        wave = min(LARGEST_WAVE, wave * 2)
    if told is not None:
        told.update(units=base, rows=seen, full=full())
    if not parts:
        return spark.createDataFrame([], schema)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    most = spark.createDataFrame(list(quotas.items()), StructType([schema[key], *spark.createDataFrame([], "__quota long").schema.fields]))
    ranked = every.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__rank") <= max(quotas.values(), default=0))
    out = saved(ranked.join(F.broadcast(most), key).filter("__rank <= __quota").select(*names), "scan-rows")
    for p in parts:
        forget(spark, p)
    return out


class Unit(InputPartition):
    def __init__(self, folder: str, path: str, group: int, columns: list[str]):
        self.folder, self.path, self.group, self.columns = folder, path, group, columns


class SplitSource(DataSource):
    """format("tesserix_split"): a split of a dataset as a stream of row groups.

    Options: path (the dataset's folder), split (a folder in it), fallback (taken where split isn't there), step (units a batch), checkpoint (the query's checkpointLocation; a query
    that is started again goes on from what its log says was planned), until (a file; once it is there nothing more is read). Files that come later must sort after those that were read."""

    @classmethod
    def name(cls) -> str:
        return "tesserix_split"

    def folder(self) -> str:
        base = self.options["path"].rstrip("/")
        for part in (self.options.get("split"), self.options.get("fallback")):
            if part and listed(f"{base}/{part}"):
                return f"{base}/{part}"
        raise FileNotFoundError(f"{base} has neither {self.options.get('split')} nor {self.options.get('fallback')}")

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        folder = self.folder()
        fs, _ = opened(folder)
        return from_arrow_schema(pq.read_schema(listed(folder)[0], filesystem=fs))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return SplitReader(self.folder(), [f.name for f in schema], self.options)


class SplitReader(DataSourceStreamReader):
    """An offset is the number of units before it."""

    def __init__(self, folder: str, columns: list[str], options: dict):
        self.source, self.columns, self.step, self.until = folder, columns, int(options.get("step", 8)), options.get("until")
        self.at = planned(options["checkpoint"]) if options.get("checkpoint") else 0
        self.found: list[tuple[str, int, int]] = []

    def initialOffset(self) -> dict:
        return {"at": 0}

    def _known(self, n: int) -> list[tuple[str, int, int]]:
        """The first n units, as far as they are there; footers that were read aren't read again."""
        if len(self.found) < n:
            self.found = [u for _, u in zip(range(n), units(self.source), strict=False)]
        return self.found[:n]

    def latestOffset(self) -> dict:
        if not (self.until and there(self.until)):
            self.at = max(self.at, len(self._known(self.at + self.step)))
        return {"at": self.at}

    def partitions(self, start: dict, end: dict):
        if end["at"] < start["at"]:
            raise ValueError(f"the source has gone back from {start} to {end}")
        return [Unit(self.source, path, group, self.columns) for path, group, _ in self._known(end["at"])[start["at"] :]]

    def read(self, partition: Unit):
        for b in read_unit(partition.folder, partition.path, partition.group, partition.columns):
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in partition.columns], partition.columns)

    def commit(self, end: dict) -> None:
        pass


def there(path: str) -> bool:
    fs, at = opened(path)
    return fs.get_file_info(at).type != pafs.FileType.NotFound


def planned(checkpoint: str) -> int:
    """The end of the last batch that a query's log has planned, 0 without a log."""
    fs, path = opened(f"{checkpoint}/offsets")
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return 0
    logs = [i for i in fs.get_file_info(pafs.FileSelector(path)) if i.base_name.isdigit()]
    if not logs:
        return 0
    with fs.open_input_stream(max(logs, key=lambda i: int(i.base_name)).path) as f:
        lines = f.read().decode("utf-8").strip().split("\n")
    return json.loads(lines[-1])["at"] if lines[-1].startswith("{") else 0

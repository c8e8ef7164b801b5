"""Scans that stop early and streams over splits: what is read, and that nothing is lost or repeated."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tesserix.sources import scan
from tesserix.streaming import acquire

SHAPE = StructType([StructField("id", LongType()), StructField("kind", StringType()), StructField("text", StringType())])


def written(folder, files, rows=60, groups=3, start=0, kind=lambda i: "abc"[i % 3]):
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder.mkdir(parents=True, exist_ok=True)
    for f in range(files):
        ids = range(start + f * rows, start + (f + 1) * rows)
        t = pa.table({"id": pa.array(ids, pa.int64()), "kind": [kind(i) for i in ids], "other": ["x" * 50] * rows, "text": [f"text {i}" for i in ids]})
        pq.write_table(t, folder / f"part-{start:05d}-{f:03d}.parquet", row_group_size=rows // groups)


def test_scan_stops(spark, tmp_path):
    seen = {}
    for name, files in (("small", 4), ("large", 40)):
        written(tmp_path / name, files)
        told = {}
        got = scan.scan_until_full(spark, str(tmp_path / name), SHAPE, "kind", {"a": 20, "b": 7}, told)
        rows = sorted((r["kind"], r["id"]) for r in got.collect())
        assert rows == [("a", 3 * i) for i in range(20)] + [("b", 3 * i + 1) for i in range(7)] and got.columns == SHAPE.names
        seen[name] = told
    assert seen["small"] == seen["large"] and seen["large"]["full"] and seen["large"]["units"] <= 7  # what is read doesn't grow with the table
    told = {}
    short = scan.scan_until_full(spark, str(tmp_path / "small"), SHAPE, "kind", {"a": 1000, "nothing": 1}, told)
    assert short.count() == 80 and not told["full"] and told["rows"] == 240
    assert scan.scan_until_full(spark, str(tmp_path / "none"), SHAPE, "kind", {"a": 1}).count() == 0


def test_units_are_read_again_after_failures(tmp_path, monkeypatch):
    written(tmp_path / "d", 1)
    monkeypatch.setattr(scan, "WAIT", 0.0)
    monkeypatch.setattr(scan, "BATCH", 5)
    real, rng = scan.pq.ParquetFile, random.Random(1)

    class Flaky(real):
        def iter_batches(self, *a, **kw):
            for i, b in enumerate(super().iter_batches(*a, **kw)):
                if i == 2 and rng.random() < 0.7:
                    raise OSError("gone")
                yield b

    monkeypatch.setattr(scan.pq, "ParquetFile", Flaky)
    (path,) = scan.listed(str(tmp_path / "d"))
    ids = [i for b in scan.read_unit(str(tmp_path / "d"), path, 1, ["id"]) for i in b.column(0).to_pylist()]
    assert ids == list(range(20, 40))
    monkeypatch.setattr(scan, "ATTEMPTS", 2)
    monkeypatch.setattr(rng, "random", lambda: 0.0)
    with pytest.raises(OSError):
        list(scan.read_unit(str(tmp_path / "d"), path, 1, ["id"]))


def test_split_stream_stops_when_full(spark, tmp_path):
    written(tmp_path / "set" / "val", 30)  # there is no split validation: its fallback is taken
    batches = []
    got = acquire.acquire_split(spark, str(tmp_path / "set"), "validation", "val", "kind", {"a": 30, "b": 10}, str(tmp_path / "out"), str(tmp_path / "cp"), step=2, batches=batches)
    assert {(r["kind"], r["count"]) for r in got.groupBy("kind").count().collect()} == {("a", 30), ("b", 10)}
    assert len(batches) <= 4 and scan.planned(str(tmp_path / "cp")) <= 8  # of 90 units
    again = acquire.acquire_split(spark, str(tmp_path / "set"), "validation", "val", "kind", {"a": 30, "b": 10}, str(tmp_path / "out"), str(tmp_path / "cp"), step=2)
    assert again.count() == 40 and scan.planned(str(tmp_path / "cp")) <= 8
    with pytest.raises(Exception, match="neither"):
        acquire.acquire_split(spark, str(tmp_path / "set"), "x", "y", "kind", {"a": 1})


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    """Stopped between batches, and failed inside one, a query neither loses nor repeats rows."""
    spark.dataSource.register(scan.SplitSource)
    written(tmp_path / "set" / "train", 6)
    out, cp, left = str(tmp_path / "out"), str(tmp_path / "cp"), [2, 1, 100, 100]
    for k, most in enumerate(left):
        if k == 3:
            written(tmp_path / "set" / "train", 2, start=10_000)  # more files
        n = [0]

        def write(batch, batch_id, n=n, most=most, k=k):
            if n[0] >= most:
                raise RuntimeError("killed")
            n[0] += 1
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            if k == 1:
                raise RuntimeError("killed after its rows were written")

        stream = spark.readStream.format("tesserix_split").options(path=str(tmp_path / "set"), split="train", step=3, checkpoint=cp).load()
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", cp).start()
        try:
            query.processAllAvailable()
            assert k >= 2
        except Exception:
            assert k < 2
        finally:
            query.stop()
    ids = sorted(r["id"] for r in spark.read.parquet(out).select("id").collect())
    assert ids == [*range(360), *range(10_000, 10_120)]
    assert spark.read.parquet(out).filter(F.col("other").isNull()).count() == 0

"""A stream that ends when its quotas are full: accepted rows are counted as they are written, and the source is told to stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tesserix.runtime import fresh
from tesserix.sources.scan import SplitSource, opened
from tesserix.streaming.quotas import once_by_content


def _touch(path: str) -> None:
    fs, at = opened(path)
    with fs.open_output_stream(at) as f:
        f.write(b"")


def limited(stream: DataFrame, key: str, quotas: dict) -> DataFrame:
    """Rows of each key up to its quota, in arrival order; the state of a key is its count, rows of other keys are dropped. All columns are kept."""
    names = stream.columns

    def run(k, frames, state):
        have, most = state.get[0] if state.exists else 0, quotas.get(k[0], 0)
        for f in frames:
            take = f.head(max(0, most - have))
            have += len(take)
            if len(take):
                yield take[names]
        state.update((have,))

    own = stream.filter(F.col(key).isin(*quotas))
    return own.groupBy(key).applyInPandasWithState(run, stream.schema, "have long", "append", "NoTimeout")


def acquire_split(spark: SparkSession, dataset: str, split: str, fallback: str | None, key: str, quotas: dict, path: str | None = None, checkpoint: str | None = None, step: int = 2, content: str = "text", batches: list | None = None) -> DataFrame:
    """Rows of a split by quotas per key, each content once, until all quotas are full or the split ends.

    A batch's rows are a folder of their own below path, which a replay writes anew, and are counted per key while they are written (an observation, one number a key). When all quotas are
    full a mark beside the checkpoint stops the source: the batch after it plans no unit, so nothing more is read. Started again with the same folders it goes on where it stopped; with
    full quotas it reads nothing. batches: gets (batch, rows accepted)."""
    path, checkpoint = path or fresh(spark, "acquired"), checkpoint or fresh(spark, "acquired-checkpoint")
    mark = f"{checkpoint}-full"
    spark.dataSource.register(SplitSource)
    options = {"path": dataset, "split": split, "fallback": fallback or "", "step": step, "checkpoint": checkpoint, "until": mark}
    stream = spark.readStream.format("tesserix_split").options(**options).load()
    kind, schema = stream.schema[key].dataType, stream.schema
    done = spark.read.option("pathGlobFilter", "*.parquet")

    def counted() -> dict:
        rows = done.schema(f"{key} {kind.simpleString()}, batch long").parquet(path).groupBy("batch", key).count().collect() if _written(path) else []
        out: dict = {}
        for r in rows:
            out.setdefault(r["batch"], {})[r[key]] = r["count"]
        return out

    have = counted()

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        keys = list(quotas)
        marked = batch.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count(F.when(F.col(key) == k, 1)).alias(f"k{i}") for i, k in enumerate(keys)])
        marked.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        got = seen.get
        have[batch_id] = {k: got[f"k{i}"] for i, k in enumerate(keys)}
        if batches is not None:
            batches.append((batch_id, got["rows"]))
        if all(sum(b.get(k, 0) for b in have.values()) >= n for k, n in quotas.items()):
            _touch(mark)

    own = limited(once_by_content(stream, content).select(*schema.names), key, quotas)
    query = own.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(schema).parquet(path) if _written(path) else spark.createDataFrame([], schema)


def _written(path: str) -> bool:
    import pyarrow.fs as pafs

    fs, at = opened(path)
    return fs.get_file_info(at).type == pafs.FileType.Directory

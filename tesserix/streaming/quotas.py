"""Streams: replay-safe intake by content, keyed quotas, event-time windows. Sources are replayed from their start after a failure;
checkpoints and content digests make the effect of each row happen once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserix.runtime import fresh, table


def read_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table as a stream, be it a folder of part files or a single file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{sf_dir}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def once_by_content(stream: DataFrame, content: str = "text") -> DataFrame:
    """Rows whose content hasn't been seen; state holds one digest per content."""
    return stream.withColumn("sha256", F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")), 256)).dropDuplicates(["sha256"])


def once_within(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """The same with bounded state: repetitions later than delay are let through."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def fill_quotas(stream: DataFrame, key: str, quota: int, keep: list[str]) -> DataFrame:
    """At most quota rows per key, in arrival order; the state of a key is its count, and full keys emit nothing."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.select(key, *keep).schema}

    def run(k, frames, state):
        have = state.get[0] if state.exists else 0
        for f in frames:
            take = f.head(max(0, quota - have))
            have += len(take)
            if len(take):
                yield take[[key, *keep]]
        state.update((have,))

    schema = ", ".join(f"{k} {t}" for k, t in kinds.items())
    return stream.select(key, *keep).groupBy(key).applyInPandasWithState(run, schema, "have long", "append", "NoTimeout")


def windowed_counts(stream: DataFrame, at: str, key: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Rows per event-time window and key; late rows beyond delay are left out."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append", path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that is there, into a table in the shared folder; started again with the same folders it goes on where it stopped."""
    spark = stream.sparkSession
    path, checkpoint = path or fresh(spark, name), checkpoint or fresh(spark, f"{name}-checkpoint")
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(path)


def once_into(stream: DataFrame, path: str, key: str, checkpoint: str) -> None:
    """foreachBatch with a ledger: the stream's state lets each key through once, and a batch is a folder of its own below path, which a replay of the
    batch writes anew. Nothing that was written before is read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.dropDuplicates([key]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All batches of once_into()."""
    return spark.read.parquet(path).drop("batch")

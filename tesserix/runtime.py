"""What every module needs from a session: tables, and the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir of the session. Where that is unset, a temporary folder in local mode (tests), and an error on a
    cluster: its executors would each write to a disk of their own, and later reads would miss rows."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        where = "file://" + tempfile.mkdtemp(prefix="tesserix-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


ROWS_PER_FILE = 200_000


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, and lost executors cost nothing.

    rows: about how many, for tables that are cheap to make; they are put into files of some ROWS_PER_FILE rows, at least 4."""
    if rows is not None:
        df = df.coalesce(max(4, rows // ROWS_PER_FILE))
    return df.sparkSession.read.schema(df.schema).parquet(_write(df, name))


def _write(df: DataFrame, name: str) -> str:
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return path


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by saved() that no later plan reads."""
    for f in df.inputFiles()[:1]:
        forget_folder(spark, f.rsplit("/", 1)[0])


def forget_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Let executors import this package where PYTHONPATH doesn't lead to it already."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    on_path = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    sc = spark.sparkContext
    if root in on_path or getattr(sc, "_tesserix_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tesserix-"), "tesserix.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "tesserix")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._tesserix_shipped = True


#: Rows of a few numbers up to which a table may be broadcast (some 25 MB); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def checked_side(df: DataFrame, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """df written to the shared folder, and hinted for broadcast if its counted rows are at most `most`. For narrow tables."""
    from pyspark.sql import functions as F

    df = saved(df, name)
    return F.broadcast(df) if df.count() <= most else df


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def shared_ids(docs: DataFrame, name: str) -> DataFrame | None:
    """The doc_ids (__shared, null too) that several rows have; None if there are none."""
    from pyspark.sql import functions as F

    found = docs.groupBy(F.col("doc_id").cast("long").alias("__shared")).count().filter("count > 1").select("__shared", F.lit(True).alias("__is_shared"))
    found = saved(found, name)
    n = found.count()
    if not n:
        forget(docs.sparkSession, found)
    return None if not n else F.broadcast(found) if n <= BROADCAST_ROWS else found


#: For rows with long texts: fewer of them at a time in readers, writers and Python, so that a task's buffers stay small.
WIDE_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "32m", "parquet.block.size": str(16 << 20)}


def wide_rows(spark: SparkSession) -> dict[str, str | None]:
    """Set WIDE_ROWS in the session, except for what the user has set. Gives what was there before, for restore()."""
    own = {k for k, _ in spark.sparkContext.getConf().getAll()}
    before = {k: spark.conf.get(k, None) for k in WIDE_ROWS if k not in own}
    for k in before:
        spark.conf.set(k, WIDE_ROWS[k])
    return before


def restore(spark: SparkSession, before: dict[str, str | None]) -> None:
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def in_wide_session(df: DataFrame) -> DataFrame:
    """df as a table of a session of its own that has WIDE_ROWS: what is made of it keeps them, however late it runs, and the caller's session is left as it is."""
    own, name = wide_session(df.sparkSession), f"tesserix_{uuid.uuid4().hex}"
    df.createGlobalTempView(name)
    try:
        return own.table(f"global_temp.{name}")
    finally:
        df.sparkSession.catalog.dropGlobalTempView(name)


def wide_session(spark: SparkSession) -> SparkSession:
    """A session of its own with spark's settings and WIDE_ROWS, so that a lazy result keeps them and spark's later work doesn't."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if own.conf.isModifiable(k) and own.conf.get(k, None) != v:
            own.conf.set(k, v)
    wide_rows(own)
    return own

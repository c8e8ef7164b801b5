"""Operator 11: whitening of embeddings by MLlib's BlockMatrix.

Vectors become whole numbers x = floor(1024 c) + 100000, kept in a table of the shared folder. Their rows, centred, are indexed into blocks of
BLOCK rows where they lie (a partition's last block is filled up with rows of zeros, which add nothing), so making the blocks needs no
shuffle. Transposed, the block matrix is multiplied with itself, in as many parts of its rows as memory needs, for the scatter matrix; its covariance goes through eigh
on the driver; and the block matrix, its blocks now laid out in a square so that the product is spread over all tasks, is multiplied with a block diagonal of whitening
matrices, which projects all rows. Beyond MOST_BLOCKS blocks this happens a slab of blocks at a time.

Vectors that are null or hold a null or non-finite entry are dropped; so are those whose length isn't the commonest one (of equally common ones the longest),
as no mean is defined for them. Entries beyond +-2^42 are taken as +-2^42. Components without variance (up to 1e-12 of the largest) have whitened values of 0 and are left
out of identity_error; without any variance explained is 0. deviation is null where the exact number doesn't fit in a long. An empty table, or one without usable vectors, gives an empty
result; repeated and null vec_ids are rows like others; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tesserix.runtime import forget, saved

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Rows of a block, blocks multiplied in one task, and blocks handled at once.
BLOCK, TOGETHER, MOST_BLOCKS = 4096, 8, 1 << 18
LARGEST = float(1 << 42)
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(rows: DataFrame, vectors: str) -> DataFrame:
    """vec_id and x (array<long>) of the usable vectors, with their partition (part) and place in it (place), in the shared folder."""
    v = F.col(vectors).cast("array<double>")
    usable = v.isNotNull() & F.forall(F.coalesce(v, F.array().cast("array<double>")), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c)) * SCALE).cast("long") + SHIFT)
    local = F.monotonically_increasing_id()
    found = rows.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    return saved(found.withColumn("part", F.shiftright(local, 33).cast("int")).withColumn("place", local.bitwiseAND((1 << 33) - 1)), "whiten-rows")


def sums_by_length(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, int]]:
    """For each length of vectors: their number, exact sums of each dimension, and the largest entry's size. Numbers of fixed size a task come to the driver."""

    def run(batches):
        found: dict[int, list] = {}
        for b in batches:
            lists = b.column(0)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for d in np.unique(sizes).tolist():
                own = starts[sizes == d]
                m = flat[own[:, None] + np.arange(d)]
                n, total, most = found.get(d, (0, [0] * d, 0))
                # a batch's sums fit in 64 bits: 2^53 an entry at most, and no batch has more than 2^10 rows
                parts = [m[i : i + 1000].sum(0).tolist() for i in range(0, len(m), 1000)]
                found[d] = (n + len(m), [sum(t) for t in zip(total, *parts, strict=True)], max(most, int(np.abs(m).max(initial=0))))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([x[0] for x in found.values()], pa.int64()), pa.array([list(map(str, x[1])) for x in found.values()], pa.list_(pa.string())), pa.array([x[2] for x in found.values()], pa.int64())] if found else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64())], ["d", "n", "total", "most"])

    each = rows.select("x").mapInArrow(run, "d long, n long, total array<string>, most long")
    by_place = each.select("d", "n", "most", F.posexplode_outer("total").alias("at", "part")).groupBy("d", "at").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out: dict[int, tuple[int, dict, int]] = {}
    for r in by_place.collect():
        n, total, most = out.setdefault(r["d"], (r["n"], {}, 0))
        if r["at"] is not None:
            total[r["at"]] = int(r["total"])
        out[r["d"]] = (r["n"], total, max(most, r["most"]))
    return {d: (n, np.array([t[k] for k in range(d)], object), most) for d, (n, t, most) in out.items()}


def indexed(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows with block and row: a partition's rows fill blocks of BLOCK, begun where the blocks of the partitions before it end. And the number of blocks."""
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last")).select("part", (F.col("last") + 1).alias("n")).collect()}
    first, bases = 0, []
    for part in sorted(sizes):  # one number a partition
        bases.append((part, first))
        first += -(-sizes[part] // BLOCK)
    side = F.broadcast(rows.sparkSession.createDataFrame(bases, "part int, first long"))
    block = F.col("first") + F.floor(F.col("place") / BLOCK)
    return rows.join(side, "part").withColumn("block", block.cast("long")).withColumn("row", (F.col("place") % BLOCK).cast("int")).drop("part", "place", "first"), first


def stored(block: int, matrix: np.ndarray) -> pa.RecordBatch:
    """block, and its matrix as MLlib stores it (rows one after the other)."""
    rows, d = matrix.shape
    flat = pa.ListArray.from_arrays(pa.array([0, matrix.size], pa.int32()), pa.array(matrix.reshape(-1)))
    fields = {
        "type": pa.array([1], pa.int8()), "numRows": pa.array([rows], pa.int32()), "numCols": pa.array([d], pa.int32()), "colPtrs": pa.array([None], pa.list_(pa.int32())),
        "rowIndices": pa.array([None], pa.list_(pa.int32())), "values": flat, "isTransposed": pa.array([True]),
    }
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.StructArray.from_arrays(list(fields.values()), list(fields))], ["block", "matrix"])


def blocks(rows: DataFrame, mean: np.ndarray) -> DataFrame:
    """block and matrix (BLOCK centred rows) of rows (x, block, row). Rows of a block that are read by several tasks give several matrices with zeros for
    the others' rows; products add up what has the same place, so the outcome is the same."""
    d = len(mean)

    def run(batches):
        now, held = None, None
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, d) - mean
            at, row = b.column(1).to_numpy(), b.column(2).to_numpy()
            cuts = np.flatnonzero(np.diff(at)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(at)], strict=True):
                if low == high:
                    continue
                if at[low] != now:
                    if held is not None:
                        yield stored(now, held)
                    now, held = int(at[low]), np.zeros((BLOCK, d))
                held[row[low:high]] = x[low:high]
        if held is not None:
            yield stored(now, held)

    return rows.select("x", "block", "row").mapInArrow(run, StructType([StructField("block", LongType()), StructField("matrix", MatrixUDT())]))


def block_matrix(found: DataFrame, row, column, n_rows: int, n_columns: int, d: int) -> BlockMatrix:
    """Blocks (block, matrix) laid out by two expressions of their number."""
    index = F.struct(row.cast("long").alias("_1"), column.cast("long").alias("_2"))
    frame = found.select(index.alias("_1"), F.col("matrix").alias("_2"))
    made = callMLlibFunc("createBlockMatrix", frame, BLOCK, d, n_rows * BLOCK, n_columns * d)
    return BlockMatrix(made, BLOCK, d)


def scatter_of(a: BlockMatrix, n_blocks: int) -> np.ndarray:
    """a transposed times a, its rows in parts of TOGETHER blocks, each multiplied in a task of its own."""
    own = a._java_matrix_wrapper
    left = a.transpose()._java_matrix_wrapper
    product = left.call("multiply", own._java_model, max(1, n_blocks // TOGETHER))
    return BlockMatrix(product, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def diagonal_of(spark: SparkSession, matrix: np.ndarray, times: int) -> BlockMatrix:
    """A block diagonal of `times` copies of a small matrix."""
    d, k = matrix.shape
    schema = StructType([StructField("_1", StructType([StructField("_1", LongType()), StructField("_2", LongType())])), StructField("_2", MatrixUDT())])
    one = Matrices.dense(d, k, matrix.T.reshape(-1).tolist())
    frame = spark.createDataFrame([((i, i), one) for i in range(times)], schema).coalesce(1)
    return BlockMatrix(callMLlibFunc("createBlockMatrix", frame, d, k, times * d, times * k), d, k)


def projected(found: DataFrame, n_blocks: int, matrix: np.ndarray) -> DataFrame:
    """block, row and z (array<double>) of all rows times a small matrix.

    The blocks are laid out in a square of `wide` columns instead of one column, as Spark deals a product out by a grid over its rows and columns: of a single column the
    grid would make few, large tasks."""
    spark, (d, k) = found.sparkSession, matrix.shape
    wide = max(1, int(np.sqrt(n_blocks)))
    a = block_matrix(found, F.floor(F.col("block") / wide), F.col("block") % wide, -(-n_blocks // wide), wide, d)
    product = a.multiply(diagonal_of(spark, matrix, wide))
    frame = callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model)

    def run(batches):
        for b in batches:
            place, m = b.column(0), b.column(1)
            for i in range(b.num_rows):
                at, one = place[i].as_py(), m[i]
                values = one["values"].values.to_numpy().reshape((BLOCK, k) if one["isTransposed"].as_py() else (k, BLOCK))
                values = np.ascontiguousarray(values if one["isTransposed"].as_py() else values.T).reshape(-1)
                z = pa.ListArray.from_arrays(pa.array(np.arange(BLOCK + 1, dtype=np.int32) * k), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(BLOCK, at["_1"] * wide + at["_2"])), pa.array(np.arange(BLOCK, dtype=np.int32)), z], ["block", "row", "z"])

    return frame.mapInArrow(run, "block long, row int, z array<double>")


def identity_gap(whitened: DataFrame, live: list[int]) -> float:
    """The largest absolute entry of the covariance of z's live components, centred before multiplying, minus the identity."""
    if not live:
        return 0.0
    z = lambda k: F.get("z", F.lit(k))
    means = whitened.agg(*[F.avg(z(k)).alias(f"m{k}") for k in live]).first()
    entries = [(i, j) for i in live for j in live if i <= j]
    found = whitened.agg(*[F.avg((z(i) - means[f"m{i}"]) * (z(j) - means[f"m{j}"])).alias(f"c{i}_{j}") for i, j in entries]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in entries)


def whiten(rows: DataFrame, vectors: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1 on), n, deviation, whitened, explained, identity_error of every usable vector."""
    spark = rows.sparkSession
    kept = whole_vectors(rows, vectors)
    lengths = sums_by_length(kept)
    d = max(lengths, key=lambda k: (lengths[k][0], k), default=0)
    if not d:
        forget(spark, kept)
        return spark.createDataFrame([], SCHEMA)
    n, total, most = lengths[d]
    mean = np.array([t / n for t in total], np.float64)
    numbered, n_blocks = indexed(kept.filter(F.size("x") == d))
    slabs = [(low, min(low + MOST_BLOCKS, n_blocks)) for low in range(0, n_blocks, MOST_BLOCKS)]
    part = lambda low, high: blocks(numbered.filter(F.col("block").between(low, high - 1)), mean).withColumn("block", F.col("block") - low)
    scatter = sum(scatter_of(block_matrix(part(a, b), F.col("block"), F.lit(0), b - a, 1, d), b - a) for a, b in slabs)
    values, axes = np.linalg.eigh(scatter / n)
    values, axes = np.maximum(values[::-1], 0)[:components], axes[:, ::-1][:, :components]
    trace = float(np.trace(scatter)) / n
    live = [k for k in range(len(values)) if values[k] > 1e-12 * values[0]]
    scale = np.array([1 / np.sqrt(values[k]) if k in live else 0.0 for k in range(len(values))])
    z = None
    for a, b in slabs:
        one = projected(part(a, b), b - a, axes * scale).withColumn("block", F.col("block") + a)
        z = one if z is None else z.union(one)
    z = numbered.select("vec_id", "block", "row", _deviation(n, total, most, d).alias("deviation")).join(z, ["block", "row"])
    z = saved(z.select("vec_id", "deviation", "z"), "whiten-projected")
    forget(spark, kept)
    gap = identity_gap(z, live)
    shares = F.array(*[F.lit(float(v / trace) if trace else 0.0) for v in values])
    each = z.select("vec_id", "deviation", F.posexplode("z").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(float(gap)).alias("identity_error"))


def _deviation(n: int, total: np.ndarray, most: int, d: int):
    """Sum of (n x - S)^2 as an exact long: in longs where the largest possible value fits, else in decimals."""
    largest = (n * most + max(abs(t) for t in total)) ** 2 * d
    kind, zero = ("long", F.lit(0).cast("long")) if largest < 1 << 62 else ("decimal(38,0)", F.lit(0).cast("decimal(38,0)"))
    sums = F.array(*[F.lit(str(t)).cast(kind) for t in total])
    if kind == "long":
        gaps = F.zip_with("x", sums, lambda x, s: (x * n - s) * (x * n - s))
        return F.aggregate(gaps, zero, lambda a, g: a + g)
    gap = lambda x, s: (x.cast("decimal(19,0)") * F.lit(str(n)).cast("decimal(18,0)") - s).try_cast("decimal(19,0)")
    square = F.zip_with("x", sums, lambda x, s: (gap(x, s) * gap(x, s)).try_cast("decimal(38,0)"))
    return F.aggregate(square, zero, lambda a, g: F.try_add(a, g).try_cast("decimal(38,0)")).try_cast("long")

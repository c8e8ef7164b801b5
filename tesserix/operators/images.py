"""Images as rows: decoding, expansion into degraded views by role, statistics and hashes, pluggable encoders.

Images are struct columns (height, width, pixels: R, G, B bytes). Numpy works on Arrow batches; each image is one row, so any
number of executors shares the work, and views of one image are made one after the other.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserix.functions import pixels as px
from tesserix.functions.jpeg_reader import components, read_jpeg
from tesserix.runtime import in_wide_session, saved, wide_session
from tesserix.sources.relations import CHAINS, PRESETS, ROLE_CONDITIONS

SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff", "gif")
RAW = "height int, width int, pixels binary"


def _small_files(spark: SparkSession) -> SparkSession:
    """A session in which a small file counts as little: at Spark's 4 MB for opening one, a task gets 32 images at most, and tasks outnumber all else."""
    own = wide_session(spark)
    own.conf.set("spark.sql.files.openCostInBytes", str(1 << 16))
    return own


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, label and split (from folder names) and content of all image files below folder, by suffix in any case."""
    files = _small_files(spark).read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES))
    part = lambda k: F.element_at(F.split("path", "/"), k)
    return rows.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")).select("path", F.when(part(-2) == "real", 0).when(part(-2) == "aigc", 1).alias("label"), part(-3).alias("split"), "content")


def decode_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, height, width, pixels. Files go through the JVM's image reader, which gives blue first; what it refuses is tried as a baseline JPEG with one to four components (CMYK
    among them) where the file lies. EXIF rotations are undone. A file that can't be read has null pixels instead of failing the scan."""
    spark = _small_files(spark)
    images = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(folder).select("image.*")
    # rotations are in the headers of JPEG files only; the few files that have one are small rows, joined by path
    headers = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.substring("content", 1, 131072).alias("head")).filter(F.substring("head", 1, 2) == F.lit(b"\xff\xd8"))
    # one reader writes file:/// where the other writes file:/
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    rows = images.withColumn("origin", same("origin")).join(headers.withColumn("path", same("path")), F.col("origin") == F.col("path"), "left").select("origin", "height", "width", "nChannels", "data", "head")

    def run(batches):
        for b in _few(batches):
            out = []
            for r in b.to_pylist():
                # inks come out of the JVM's reader as if they were colours
                if r["height"] <= 0 or components(r["head"] or b"") == 4:
                    rgb = _refused(r["origin"])
                    out.append({"path": r["origin"], "height": None, "width": None, "pixels": None} if rgb is None else {"path": r["origin"], "height": rgb.shape[0], "width": rgb.shape[1], "pixels": rgb.tobytes()})
                    continue
                a = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                rgb = np.repeat(a, 3, 2) if r["nChannels"] == 1 else a[:, :, 2::-1] if r["nChannels"] >= 3 else np.repeat(a[:, :, :1], 3, 2)
                rgb = px.oriented(rgb, px.exif_orientation(r["head"] or b""))
                out.append({"path": r["origin"], "height": rgb.shape[0], "width": rgb.shape[1], "pixels": np.ascontiguousarray(rgb).tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("pixels", pa.binary())]))

    return rows.mapInArrow(run, f"path string, {RAW}")


def _refused(path: str) -> np.ndarray | None:
    """An upright image of a file that the JVM's reader refuses, None if it can't be read here either."""
    from tesserix.sources.scan import opened

    try:
        fs, at = opened(re.sub("^file:/+", "file:///", path))
        with fs.open_input_stream(at) as f:
            data = f.read()
        rgb = read_jpeg(data)
        return None if rgb is None else np.ascontiguousarray(px.oriented(rgb, px.exif_orientation(data)))
    except Exception:  # a broken file is a row without pixels
        return None


def generated_images(spark: SparkSession, n: int, side: int = 64) -> DataFrame:
    """img_id, label, height, width, pixels of procedural images: even ids natural (0), odd ones synthetic (1)."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([i % 2 for i in ids], pa.int32()), pa.array([side] * len(ids), pa.int32()), pa.array([side] * len(ids), pa.int32()), pa.array([px.generated(i, side, side, i % 2 == 0).tobytes() for i in ids], pa.binary())],
                ["img_id", "label", "height", "width", "pixels"],
            )

    return spark.range(n).withColumnRenamed("id", "img_id").mapInArrow(run, f"img_id long, label int, {RAW}")


def block_images(blocks: DataFrame, side: int = 24) -> DataFrame:
    """img_id, label, height, width, pixels out of vectors (vec_id, y, x) of 64 numbers: an 8 x 8 block of greys from -1 to 1, each number a square; green and blue are the
    block mirrored and turned upside down. side: a multiple of 8."""
    n = side // 8

    def run(batches):
        for b in _few(batches):
            x = np.array(b.column(2).to_pylist(), np.float64).reshape(-1, 8, 8)
            grey = np.clip(np.floor((x + 1) * 128), 0, 255).astype(np.uint8)
            rgb = np.stack([grey, grey[:, :, ::-1], grey[:, ::-1]], 3).repeat(n, 1).repeat(n, 2)
            whole = [pa.array([side] * len(x), pa.int32())] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *whole, pa.array([i.tobytes() for i in rgb], pa.binary())], ["img_id", "label", "height", "width", "pixels"])

    # a vector is small and what is made of its image is slow, so rows are dealt out over all tasks first; an image is much wider than its vector, so batches have fewer rows
    rows = in_wide_session(blocks.select(F.col("vec_id").alias("img_id"), F.col("y").cast("int").alias("label"), "x").repartition(4 * blocks.sparkSession.sparkContext.defaultParallelism))
    return rows.mapInArrow(run, f"img_id long, label int, {RAW}")


def _image(row) -> np.ndarray:
    return np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"], 3)


#: Images that are in Python's objects at a time.
IMAGES = 256


def _few(batches):
    """Batches in slices of IMAGES rows, so that memory doesn't grow with the rows of a task."""
    for b in batches:
        for at in range(0, b.num_rows, IMAGES):
            yield b.slice(at, IMAGES)


def _told(rows, schema: pa.Schema):
    """Rows (dicts) as batches of about IMAGES rows."""
    out = []
    for r in rows:
        out.append(r)
        if len(out) >= IMAGES:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _sized(view: np.ndarray) -> dict:
    return {"height": view.shape[0], "width": view.shape[1], "pixels": view.tobytes()}


def training_view(image: np.ndarray, seed: int) -> np.ndarray:
    """One random crop, rescaling by one of three filters, and compression, by seed alone."""
    rng = np.random.default_rng(seed)
    kind, scale = sorted(px.FILTERS)[int(rng.integers(3))], rng.choice([0.125, 0.25, 0.5, 0.75])
    return px.jpeg(px.down_up(px.crop(image, rng.uniform(0.65, 0.95)), scale, kind), rng.choice([30, 50, 70, 90]))


def view(image: np.ndarray, condition: str, seed: int = 0) -> np.ndarray:
    """An image under a named condition: a preset, a chain or the random training view."""
    presets = {n: (op, p) for n, op, p in PRESETS}
    if condition in presets:
        return px.apply(image, *presets[condition])
    if condition in CHAINS:
        return px.apply_chain(image, CHAINS[condition])
    if condition == "random_crop_scale_jpeg":
        return training_view(image, seed)
    raise ValueError(f"unknown condition {condition}")


def manual_view(image: np.ndarray, quality: float = 100, sigma: float = 0, noise: float = 0, ratio: float = 1, scale: float = 1, scenario: str | None = None) -> np.ndarray:
    """Degradations chosen by hand, in a fixed order (compression, blur, noise, crop, scale; a neutral value leaves a step out). A named chain
    takes their place and starts from the image itself."""
    if scenario in CHAINS:
        return px.apply_chain(image, CHAINS[scenario])
    steps = [("jpeg", quality, quality < 100), ("blur", sigma, sigma > 0), ("noise", noise, noise > 0), ("crop", ratio, ratio < 1), ("resize", scale, scale < 1)]
    return px.apply_chain(image, [(op, p) for op, p, on in steps if on])


def paired_views(image: np.ndarray, seed: int) -> list[tuple[str, np.ndarray]]:
    """Clean and one degraded view per family, its parameter picked by the seed."""
    rng, out = np.random.default_rng(seed), [("clean", image)]
    for family in ("jpeg", "blur", "resize", "noise", "crop"):
        names = [n for n, op, _ in PRESETS if op == family]
        name = names[int(rng.integers(len(names)))]
        out.append((name, view(image, name)))
    return out


def stacked_view(image: np.ndarray, seed: int) -> np.ndarray:
    """One degradation with probability 0.55, else two different ones in turn."""
    rng = np.random.default_rng(seed)
    ops = rng.permutation([i for i, p in enumerate(PRESETS) if p[1]])[: 1 if rng.random() < 0.55 else 2]
    return px.apply_chain(image, [PRESETS[i][1:] for i in ops])


def expand_views(images: DataFrame, generation: str, role: str) -> DataFrame:
    """(img_id, label, condition, height, width, pixels): each image under all conditions of its role."""
    conditions = ROLE_CONDITIONS[(generation, role)]

    def run(batches):
        of = ((r, c) for b in _few(batches) for r in b.to_pylist() for c in conditions)
        yield from _told(({"img_id": r["img_id"], "label": r["label"], "condition": c, **_sized(view(_image(r), c, r["img_id"]))} for r, c in of), schema)

    schema = pa.schema([("img_id", pa.int64()), ("label", pa.int32()), ("condition", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("pixels", pa.binary())])
    return images.select("img_id", "label", "height", "width", "pixels").mapInArrow(run, f"img_id long, label int, condition string, {RAW}")


def write_raw(rows: DataFrame, folder: str) -> None:
    """Files (name, pixels) below folder, one that driver and executors share: each is written beside its place and then moved."""

    def run(batches):
        from tesserix.sources.scan import opened

        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tmp = f"{base}/.{name}-{uuid.uuid4().hex[:8]}"
                with fs.open_output_stream(tmp) as f:
                    f.write(data)
                fs.move(tmp, f"{base}/{name}")
            yield b.select([b.schema.names[0]])

    rows.select("name", "pixels").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def write_images(images: DataFrame, folder: str, name: str = "name", kind: str = "png", quality: float = 95) -> DataFrame:
    """Image files below folder (one that driver and executors share), lossless PNG or JPEG; (name, path, sha256) of each. A file is written beside
    its place and then moved, so a repeated task leaves the same whole file. Names are unique and hold no slash."""
    import hashlib
    import re
    import uuid

    import pyarrow.fs as pafs

    coded = {"png": px.png, "jpeg": lambda i: px.jpeg_file(i, quality)}[kind]

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder if re.match(r"\w+:/", folder) else f"file://{folder}")
        fs.create_dir(base, recursive=True)
        for b in _few(batches):
            out = []
            for r in b.to_pylist():
                data, path = coded(_image(r)), f"{base}/{r['name']}.{kind}"
                tmp = f"{base}/.{r['name']}-{uuid.uuid4().hex[:8]}"
                with fs.open_output_stream(tmp) as f:
                    f.write(data)
                fs.move(tmp, path)
                out.append({"name": r["name"], "path": path, "sha256": hashlib.sha256(data).hexdigest()})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("name", pa.string()), ("path", pa.string()), ("sha256", pa.string())]))

    rows = images.select(F.col(name).cast("string").alias("name"), "height", "width", "pixels")
    # one pass writes; its small result is kept, so that counting or joining it later doesn't write again
    return saved(rows.mapInArrow(run, "name string, path string, sha256 string"), "images-written")


def augmented(images: DataFrame, how: str = "paired") -> DataFrame:
    """(img_id, condition, height, width, pixels): paired, each image clean and under one condition of each family; stacked, one or two degradations
    in turn; crops, five crops. Parameters depend on img_id alone."""

    def views(image, seed):
        if how == "paired":
            return paired_views(image, seed)
        return [("stacked", stacked_view(image, seed))] if how == "stacked" else [(f"crop_{k}", v) for k, v in enumerate(px.multi_crops(image, 5))]

    def run(batches):
        rows = (r for b in _few(batches) for r in b.to_pylist())
        yield from _told(({"img_id": r["img_id"], "condition": c, **_sized(v)} for r in rows for c, v in views(_image(r), r["img_id"])), schema)

    schema = pa.schema([("img_id", pa.int64()), ("condition", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("pixels", pa.binary())])
    return images.select("img_id", "height", "width", "pixels").mapInArrow(run, f"img_id long, condition string, {RAW}")


def single_view(images: DataFrame, condition: str) -> DataFrame:
    """Each image under one named condition: img_id, label, height, width, pixels."""

    def run(batches):
        rows = (r for b in _few(batches) for r in b.to_pylist())
        yield from _told(({"img_id": r["img_id"], "label": r["label"], **_sized(view(_image(r), condition, r["img_id"]))} for r in rows), schema)

    schema = pa.schema([("img_id", pa.int64()), ("label", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("pixels", pa.binary())])
    return images.select("img_id", "label", "height", "width", "pixels").mapInArrow(run, f"img_id long, label int, {RAW}")


def reencoded(images: DataFrame, keys: list[str], generations: int, quality: float = 95) -> DataFrame:
    """Each image after so many compressions in turn."""
    kinds = {f.name: f.dataType.simpleString() for f in images.select(*keys).schema}

    def run(batches):
        for b in _few(batches):
            found = [px.reencoded(_image(r), generations, quality).tobytes() for r in b.select(["height", "width", "pixels"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.binary())], b.schema.names)

    return images.select(*keys, "height", "width", "pixels").mapInArrow(run, ", ".join(f"{k} {t}" for k, t in kinds.items()) + f", {RAW}")


def measured(images: DataFrame, keys: list[str]) -> DataFrame:
    """keys, forensic (28 numbers), blockiness, laplacian, dhash, phash (signed 64-bit)."""
    kinds = {f.name: f.dataType.simpleString() for f in images.select(*keys).schema}
    schema = ", ".join(f"{k} {t}" for k, t in kinds.items()) + ", forensic array<double>, blockiness double, laplacian double, dhash long, phash long"
    signed = lambda v: v - (1 << 64) if v >> 63 else v

    def run(batches):
        for b in _few(batches):
            rows = [_image(r) for r in b.select(["height", "width", "pixels"]).to_pylist()]
            found = [pa.array([px.forensic(i).tolist() for i in rows], pa.list_(pa.float64())), pa.array([px.blockiness(i) for i in rows], pa.float64()), pa.array([px.laplacian_energy(i) for i in rows], pa.float64()), pa.array([signed(px.dhash(i)) for i in rows], pa.int64()), pa.array([signed(px.phash(i)) for i in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(len(keys))], *found], [*keys, "forensic", "blockiness", "laplacian", "dhash", "phash"])

    return images.select(*keys, "height", "width", "pixels").mapInArrow(run, schema)


def scored(images: DataFrame, keys: list[str], encode: Callable[[np.ndarray], np.ndarray], weights: np.ndarray, bias: float) -> DataFrame:
    """keys and pred: an injected encoder, a linear head, the clamp. A row whose encoding fails or isn't finite scores 0.5; each image has one row.

    The encoder is tried on a blank image first, so that a broken one fails the job instead of giving 0.5 everywhere."""
    probe = np.asarray(encode(np.zeros((8, 8, 3), np.uint8)), np.float64)
    if probe.shape != weights.shape:
        raise ValueError(f"the encoder gives {probe.shape}, the head takes {weights.shape}")
    kinds = {f.name: f.dataType.simpleString() for f in images.select(*keys).schema}

    def run(batches):
        for b in _few(batches):
            out = []
            for r in b.select(["height", "width", "pixels"]).to_pylist():
                try:
                    p = float(1 / (1 + np.exp(-(np.asarray(encode(_image(r)), np.float64) @ weights + bias))))
                except Exception:  # a row of its own; the encoder itself was probed
                    p = 0.5
                out.append(min(1.0, max(0.0, p)) if np.isfinite(p) else 0.5)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(len(keys))], pa.array(out, pa.float64())], [*keys, "pred"])

    return images.select(*keys, "height", "width", "pixels").mapInArrow(run, ", ".join(f"{k} {t}" for k, t in kinds.items()) + ", pred double")

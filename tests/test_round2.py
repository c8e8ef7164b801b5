"""Cases of this round: guards, sinks, streams on folders, selection, contamination by short passages."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserix import runtime
from tesserix.functions import pixels as px
from tesserix.functions.binomial import binomial_upper
from tesserix.operators import acquisition, identity, images, policy, sampling
from tesserix.plans import other_queries
from tesserix.streaming import quotas, stages


def test_crops_keep_the_size():
    image = px.generated(3, 66, 50)
    for n, want in ((0, 0), (1, 1), (2, 2), (4, 4), (5, 5), (9, 5)):
        crops = px.multi_crops(image, n)
        assert len(crops) == want and all(c.shape == image.shape for c in crops)
    # 66 x 0.8 = 52.8 is 53, 50 x 0.8 is 40
    assert np.array_equal(px.multi_crops(image, 2)[0], px.resample(image[:53, :40], 66, 50))
    assert np.array_equal(px.multi_crops(image, 5)[4], px.resample(image[6:59, 5:45], 66, 50)) and np.array_equal(px.crop(image, 0.8), px.multi_crops(image, 1)[0])


def test_filters():
    flat = np.full((20, 30, 3), 77, np.uint8)
    for kind in px.FILTERS:
        assert np.array_equal(px.down_up(flat, 0.25, kind), flat) and px.resample(px.generated(1), 512, 512, kind).shape == (512, 512, 3)
    x = px.generated(5)
    assert len({px.down_up(x, 0.5, k).tobytes() for k in px.FILTERS}) == 3


def test_policy_guards(spark):
    rows = [(g, int(g >= 4), 0.1 * g) for g in range(8)]
    df = spark.createDataFrame(rows, "grp long, y int, score double")
    assert policy.select_policy(df, []).count() == 1
    for target in (0.0, 1.0, -0.1, 2):
        with pytest.raises(ValueError):
            policy.select_policy(df, [], target_fpr=target)
        with pytest.raises(ValueError):
            policy.select_policy(df, [], target_false_clear=target)
    for bad in (float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="finite"):
            policy.select_policy(df.union(spark.createDataFrame([(9, 1, bad)], df.schema)), []).collect()
    with pytest.raises(Exception, match="both classes"):
        policy.select_policy(df.filter("y = 0"), []).collect()
    for bad in ((1, 0, 0.95), (-1, 4, 0.95), (5, 4, 0.95), (1, 4, 1.0), (1, 4, 0.0)):
        with pytest.raises(ValueError):
            binomial_upper(*bad)
    assert binomial_upper(4, 4) == 1.0


def test_selection_takes_the_best_that_passes(spark):
    table = [("base", 0, "clean", 0.90), ("base", 0, "resize_0.25", 0.80), ("a", 1, "clean", 0.92), ("a", 1, "resize_0.25", 0.79), ("b", 2, "clean", 0.95), ("b", 2, "resize_0.25", 0.85), ("c", 3, "clean", 0.94), ("c", 3, "resize_0.25", 0.84), ("d", 4, "clean", 0.94), ("d", 4, "resize_0.25", 0.84)]
    own = [("base", 0.97), ("a", 0.97), ("b", 0.96), ("c", 0.966), ("d", 0.99)]
    got = {r["model"]: r for r in policy.development_selection(spark.createDataFrame(table, "model string, ord int, condition string, auc double"), spark.createDataFrame(own, "model string, auc double")).collect()}
    assert {m for m, r in got.items() if r["eligible"]} == {"base", "c", "d"}  # a loses on thumbnails, b on its own source
    assert [m for m, r in got.items() if r["selected"]] == ["c"]  # ties: the first


def test_equal_hashes_are_compared_once(spark):
    rows = [(i, 0, 0) for i in range(300)] + [(1000, 1, 0), (1001, 7, 3), (1002, -1, -1)]
    df = spark.createDataFrame(rows, "id long, p long, d long")
    pairs = identity.near_groups(df).collect()
    assert sorted((r["a"], r["b"]) for r in pairs) == [(0, 1000), (0, 1001), (1000, 1001)]
    members = {r["id"]: (r["rep"], r["n"]) for r in identity.hash_members(df, identity.hash_groups(df)).collect()}
    assert members[299] == (0, 300) and members[1002] == (1002, 1)


def test_contamination_finds_short_and_glued_passages(spark):
    docs = [(1, 'He said "alpha beta gamma delta epsilon zeta eta theta iota kappa" and left'), (2, "xalpha beta gammay"), (3, "one two"), (4, "nothing here"), (5, None), (1, "again: one two three"), (6, "alpha beta gamma delta epsilon zeta eta theta iota")]
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "alpha beta gamma"), (3, "one two"), (4, "o"), (5, ""), (6, None), (7, "!!")]
    got = {(r["doc_id"], r["item_id"]) for r in identity.protected_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, i) for d, t in docs for i, p in items if t and p and p in t}


def test_random_passages_against_contains(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))
    sep = lambda: rng.choice([" ", " ", ", ", "-", "\n"])
    text = lambda n: "".join(word() + sep() for _ in range(n))
    docs, items = [(i, text(60)) for i in range(60)], [(i, text(rng.randint(1, 5))) for i in range(30)]
    items += [(100 + i, docs[i][1][(at := rng.randint(0, 40)) : at + rng.randint(5, 70)]) for i in range(30)]
    got = {(r["doc_id"], r["item_id"]) for r in identity.protected_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, i) for d, t in docs for i, p in items if p in t}


def test_streams_read_folders(spark, tmp_path):
    """A table that is a folder of part files, and one in a single file, stream alike."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 20).cast("string")).alias("text"))
    docs.repartition(3).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "tmp"))
    (tmp_path / "b").mkdir()
    next((tmp_path / "tmp").glob("part*")).rename(tmp_path / "b" / "documents.parquet")
    for where in ("a", "b"):
        assert other_queries.stream_content_once(spark, str(tmp_path / where)).count() == 20


def test_ledger_survives_replay(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "k long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = quotas.read_stream(spark, str(tmp_path / "in"), "k long, v string")
    quotas.once_into(stream, str(tmp_path / "out"), "k", str(tmp_path / "cp"))
    spark.createDataFrame([(2, "d"), (3, "e")], "k long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    quotas.once_into(stream, str(tmp_path / "out"), "k", str(tmp_path / "cp"))
    assert sorted(r["k"] for r in quotas.read_ledger(spark, str(tmp_path / "out")).collect()) == [1, 2, 3]
    # without its checkpoint everything is replayed, and batches take their own places again
    quotas.once_into(stream, str(tmp_path / "out"), "k", str(tmp_path / "cp2"))
    assert sorted(r["k"] for r in quotas.read_ledger(spark, str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_windows_and_late_rows(spark, tmp_path):
    rows = [(f"2026-01-01 00:{m:02d}:00", "a") for m in range(0, 60, 10)]
    spark.createDataFrame(rows, "at string, k string").select(F.to_timestamp("at").alias("at"), "k").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = quotas.read_stream(spark, str(tmp_path / "in"), "at timestamp, k string")
    counts = quotas.windowed_counts(stream, "at", "k", "20 minutes", "0 minutes")
    q = counts.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("windows").collect()) == [2, 2, 2]


def test_retries_stages_and_fingerprints(tmp_path):
    waits, calls = [], []

    def shaky():
        calls.append(1)
        if len(calls) < 4:
            raise OSError("gone")
        return "done"

    assert stages.with_retries(shaky, wait=waits.append) == "done" and waits == [2, 4, 8]
    with pytest.raises(OSError):
        stages.with_retries(lambda: (_ for _ in ()).throw(OSError("never")), wait=lambda s: None)
    assert [stages.delay(k) for k in (1, 5, 6, 9)] == [2, 32, 60, 60]
    state, ran = str(tmp_path / "state.json"), []
    plan = [("one", lambda: ran.append(1)), ("two", lambda: ran.append(2) if len(ran) > 3 else (_ for _ in ()).throw(ValueError("not yet"))), ("three", lambda: ran.append(3))]
    with pytest.raises(ValueError):
        stages.run(plan, state, "f1", retries=2, wait=lambda s: None)
    assert ran == [1] and stages.completed(state, "f1") == ["one"]
    ran += [0, 0, 0]
    assert stages.run(plan, state, "f1", retries=2, wait=lambda s: None) == ["one", "two", "three"] and ran[-2:] == [2, 3]
    with pytest.raises(ValueError, match="fingerprint"):
        stages.run(plan, state, "f2")


def test_shared_folder_is_needed_on_a_cluster(spark):
    class Conf:
        def __init__(self, master):
            self.master, self.conf, self.sparkContext = master, self, self

        def get(self, *a):
            return None

        def set(self, *a):
            pass

        def getConf(self):
            return self

    for master in ("yarn", "spark://a:7077", "k8s://x", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            runtime.shared_dir(Conf(master))
    assert runtime.shared_dir(Conf("local[4]")).startswith("file://") and runtime.shared_dir(Conf("local")).startswith("file://")


def test_sessions_of_their_own(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    own = runtime.wide_session(spark)
    assert own.conf.get(key) == runtime.WIDE_ROWS[key] and spark.conf.get(key) == before and own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    kept = runtime.wide_rows(spark)
    assert spark.conf.get(key) == runtime.WIDE_ROWS[key]
    runtime.restore(spark, kept)
    assert spark.conf.get(key) == before and spark.conf.get("parquet.block.size", None) is None


def _png_pixels(data):
    import zlib

    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    w, h = int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    at = data.index(b"IDAT")
    raw = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + int.from_bytes(data[at - 4 : at], "big")]), np.uint8).reshape(h, 1 + 3 * w)
    assert (raw[:, 0] == 2).all()
    return raw[:, 1:].cumsum(0, dtype=np.uint8).reshape(h, w, 3)


def test_image_files(spark, tmp_path):
    """PNG to the bit; JPEG as the JVM's own reader sees it, against what quantisation leaves."""
    made = images.generated_images(spark, 3, 40).withColumn("name", F.concat(F.lit("i"), F.col("img_id")))
    told = images.write_images(made, str(tmp_path / "png"), kind="png").collect()
    want = {f"i{k}": px.generated(k, 40, 40, k % 2 == 0) for k in range(3)}
    assert {r["name"] for r in told} == set(want)
    for name, image in want.items():
        assert np.array_equal(_png_pixels((tmp_path / "png" / f"{name}.png").read_bytes()), image)
    back = {r["path"].rsplit("/", 1)[1][:-4]: np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], 3) for r in images.decode_images(spark, str(tmp_path / "png")).collect()}
    assert all(np.array_equal(back[n], want[n]) for n in want)
    images.write_images(made, str(tmp_path / "jpeg"), kind="jpeg", quality=95)
    back = {r["path"].rsplit("/", 1)[1][:-5]: np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], 3) for r in images.decode_images(spark, str(tmp_path / "jpeg")).collect()}
    for n in want:
        assert back[n].shape == want[n].shape and np.abs(back[n].astype(int) - want[n]).mean() < 4
    odd = px.generated(2, 37, 53)
    smooth = px.blur(odd, 2.0)
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "x.jpg").write_bytes(px.jpeg_file(smooth, 90))
    (r,) = images.decode_images(spark, str(tmp_path / "one")).collect()
    assert np.abs(np.frombuffer(r["pixels"], np.uint8).reshape(37, 53, 3).astype(int) - smooth).mean() < 3


def test_more_views(spark):
    base = images.generated_images(spark, 2, 32)
    paired = images.augmented(base, "paired").collect()
    assert len(paired) == 12 and {r["condition"] for r in paired} >= {"clean"} and paired == images.augmented(base, "paired").collect()
    assert images.augmented(base, "stacked").count() == 2 and images.augmented(base, "crops").count() == 10
    once = images.reencoded(base, ["img_id"], 1).collect()[0]["pixels"]
    assert bytes(once) == px.jpeg(px.generated(0, 32, 32, True), 95).tobytes() and bytes(images.reencoded(base, ["img_id"], 0).collect()[0]["pixels"]) == px.generated(0, 32, 32, True).tobytes()


def test_group_folds_are_even(spark):
    df = spark.range(90).select((F.col("id") % 30).alias("grp"))
    folds = [r["fold"] for r in sampling.group_folds(df, "grp", 3).collect()]
    assert sorted(folds) == [0] * 10 + [1] * 10 + [2] * 10


def test_first_come_on_a_chain(spark):
    rng = random.Random(2)
    edges = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)} | set(itertools.pairwise(range(12)))
    kept = []
    for i in range(40):
        if not any((k, i) in edges for k in kept):
            kept.append(i)
    got = acquisition.first_come(spark.range(40), spark.createDataFrame([tuple(e) for e in edges], "a long, b long"))
    assert sorted(r["id"] for r in got.filter("accepted").collect()) == kept




def test_exif_rotation_is_undone(spark, tmp_path):
    """A JPEG with an orientation in its header comes out upright."""
    image = px.blur(px.generated(4, 24, 40), 2.0)
    data = px.jpeg_file(image, 95)
    tiff = b"II*\x00\x08\x00\x00\x00" + b"\x01\x00" + b"\x12\x01\x03\x00\x01\x00\x00\x00\x06\x00\x00\x00" + b"\x00\x00\x00\x00"
    exif = b"Exif\x00\x00" + tiff
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_bytes(data[:2] + b"\xff\xe1" + (len(exif) + 2).to_bytes(2, "big") + exif + data[2:])
    (r,) = images.decode_images(spark, str(tmp_path / "in")).collect()
    back = np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], 3).astype(int)
    assert back.shape == (40, 24, 3) and np.abs(back - np.rot90(image, -1)).mean() < 3


def test_seeds_and_configurations(spark, tmp_path):
    import zlib

    from tesserix.functions import hashing
    from tesserix.sources import files

    row = spark.createDataFrame([("ab", "c"), ("a", "bc")], "x string, y string").select(hashing.stable_seed(F.col("x"), F.col("y")).alias("s"), hashing.content_seed(F.encode("x", "UTF-8")).alias("c")).collect()
    assert row[0]["s"] != row[1]["s"] and row[0]["c"] == zlib.crc32(b"ab")
    (tmp_path / "c.yaml").write_text("data_dir: d\nk: [1, 2.5]\n# note\n")
    pytest.importorskip("yaml")
    assert files.read_config(str(tmp_path / "c.yaml")) == {"data_dir": str(tmp_path / "d"), "k": [1, 2.5]}


def test_provenance_and_manual_views(spark):
    from tesserix.operators import integrity, vectors

    a, b = spark.createDataFrame([(1, "r")], "id long, rev string"), spark.createDataFrame([(2, "s")], "id long, rev string")
    assert integrity.one_provenance([a, a], ["rev"]).count() == 2
    with pytest.raises(ValueError):
        integrity.one_provenance([a, b], ["rev"])
    with pytest.raises(Exception, match="missing"):
        vectors.cache_rows(spark.createDataFrame([(1, 5)], "id long, cache_index long"), spark.createDataFrame([(0, 1.0)], "row long, v double"), 2).collect()
    x = px.generated(3, 32, 32)
    assert np.array_equal(images.manual_view(x), x)
    assert np.array_equal(images.manual_view(x, quality=50, scale=0.5), px.down_up(px.jpeg(x, 50), 0.5))
    assert np.array_equal(images.manual_view(x, quality=10, scenario="noise_jpeg"), images.view(x, "noise_jpeg"))

"""Hand-checkable cases and published values of the reference operators."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tesserix.functions import hashing, pixels, scalars
from tesserix.functions.binomial import allowed_errors, binomial_upper
from tesserix.operators import acquisition, heads, identity, integrity, metrics, policy, resample, sampling, tables, vectors


def one(df):
    return df.first().asDict()


@pytest.mark.parametrize(("n", "target", "k"), [(299, 0.01, 0), (298, 0.01, None), (59, 0.05, 0), (58, 0.05, None), (320, 0.05, 9), (400, 0.05, 12), (662, 0.01, 2), (342, 0.05, 10)])
def test_allowed_errors(n, target, k):
    assert allowed_errors(n, target) == ((k, True) if k is not None else (0, False))


@pytest.mark.parametrize(("e", "n", "bound"), [(0, 192, 0.0154817), (3, 192, 0.0398861), (2, 662, 0.0094795), (7, 7, 1.0)])
def test_binomial_upper(e, n, bound):
    assert binomial_upper(e, n) == pytest.approx(bound, abs=5e-8)


@pytest.mark.parametrize("bad", [(-1, 5, 0.95), (6, 5, 0.95), (0, 0, 0.95), (0, 5, 1.0)])
def test_binomial_rejects(bad):
    with pytest.raises(ValueError):
        binomial_upper(*bad)


def test_error_summary(spark):
    rows = [(0, 0.1, 0.1), (0, 0.2, 0.6), (0, 0.9, 0.9), (1, 0.95, 0.95), (1, 0.8, 0.3), (1, 0.1, 0.1)]
    r = one(metrics.error_summary(spark.createDataFrame(rows, "y int, s double, d double"), "s", "d"))
    assert (r["n"], r["n_real"], r["n_fake"], r["n_false_positives"], r["n_false_negatives"], r["n_flips_to_fp"], r["n_flips_to_fn"]) == (6, 3, 3, 1, 1, 1, 1)
    assert r["fpr"] == pytest.approx(1 / 3)
    assert r["drift_real"] == pytest.approx(0.4 / 3)
    assert r["drift_fake"] == pytest.approx(-0.5 / 3)


def test_fpr_at_tpr(spark):
    df = spark.createDataFrame(list(zip([0] * 4 + [1] * 4, [0.0, 0.1, 0.2, 0.3, 0.7, 0.8, 0.9, 1.0], strict=True)), "y int, score double")
    assert one(metrics.robustness_table(df, []))["fpr_at_95tpr"] == 0
    alone = one(metrics.robustness_table(df.filter("y = 0"), []))
    assert alone["auc"] is None and alone["fpr_at_95tpr"] is None


@pytest.mark.parametrize(("neg", "pos", "auc"), [((1, 1, 1), (1, 1), 0.75), ((0, 1, 2), (2, 0), 1 / 6), ((3, 0, 0), (0, 2), 1.0)])
def test_weighted_auc(spark, neg, pos, auc):
    df = spark.createDataFrame(list(zip([0, 0, 0, 1, 1], [0.1, 0.5, 0.8, 0.5, 0.9], [*neg, *pos], strict=True)), "y int, score double, w int")
    assert one(metrics.auc(df, [], weight=F.col("w")))["auc"] == pytest.approx(auc, abs=1e-12)


def test_auc_by_brute_force(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 400), rng.integers(-30, 130, 400) / 100
    pairs = s[y == 1][:, None] - s[y == 0][None, :]
    df = spark.createDataFrame(list(zip(map(int, y), map(float, s), strict=True)), "y int, score double")
    assert one(metrics.auc(df, []))["auc"] == pytest.approx(((pairs > 0) + 0.5 * (pairs == 0)).mean(), abs=1e-12)
    grown = df.withColumn("score", F.exp("score"))
    assert one(metrics.auc(grown, []))["auc"] == one(metrics.auc(df, []))["auc"]


def scored(spark, real, fake, views=3):
    rows = [(f"r{i}", 0, v, float(x)) for i, x in enumerate(real) for v in range(views)] + [(f"f{i}", 1, v, float(x)) for i, x in enumerate(fake) for v in range(views)]
    return spark.createDataFrame(rows, "grp string, y int, view int, score double")


def test_policy_overlap(spark):
    r = one(policy.select_policy(scored(spark, np.linspace(0.01, 0.4, 400), np.linspace(0.6, 0.99, 400)), []))
    assert (r["k_real"], r["k_fake"], r["n_real"], r["n_fake"]) == (0, 12, 400, 400)
    assert r["low"] == pytest.approx(0.452932, abs=1e-6) and r["high"] == pytest.approx(0.558797, abs=1e-6)
    assert r["fpr_bound_met"] and r["false_clear_bound_met"]


def test_policy_too_small(spark):
    r = one(policy.select_policy(scored(spark, [0.1, 0.2], [0.8, 0.9], 1), []))
    assert not r["fpr_bound_met"] and r["fpr_upper"] > 0.01


def test_conditionwise_policy(spark):
    rows = [(f"r{i}", 0, c, s) for i in range(320) for c, s in (("clean", 0.09), ("chain", 0.11))] + [(f"f{i}", 1, c, s) for i in range(320) for c, s in (("clean", 0.89), ("chain", 0.91))]
    df = spark.createDataFrame(rows, "grp string, y int, name string, score double")
    r = one(policy.conditionwise_policy(df, "name"))
    assert r["low"] == pytest.approx(0.28999, abs=1e-5) and r["high"] == pytest.approx(0.71001, abs=1e-5)
    with pytest.raises(Exception, match="occurs twice"):
        policy.conditionwise_policy(df.union(df), "name").collect()


def test_conflicting_labels_fail(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.2)], "grp string, y int, score double")
    with pytest.raises(PySparkException):
        policy.worst_views(df, []).collect()


def test_clamp_and_verdict(spark):
    df = spark.createDataFrame([(math.nan,), (-1.0,), (2.0,), (0.3,), (math.inf,)], "p double")
    assert [r[0] for r in df.select(scalars.clamp(F.col("p"))).collect()] == [0.5, 0, 1, 0.3, 0.5]
    v = df.select(scalars.verdict(F.col("p"), F.lit(0.7), F.lit(0.3))).collect()
    assert [r[0] for r in v] == ["review", "clear", "flag", "clear", "review"]


def test_quotas():
    assert sampling.sid_quotas(1) == {0: 1, 1: 1, 2: 1}
    assert sampling.sid_quotas(8) == {0: 8, 1: 4, 2: 4}


def test_sid_from_path(spark):
    df = spark.createDataFrame([("val/aigc/2_000001.jpg",), ("val/aigc/1_7.png",), ("val/real/0_3.jpg",), ("x/aigc/foo.jpg",), ("x/real/foo_1.jpg",)], "p string")
    assert [r[0] for r in df.select(scalars.sid_from_path(F.col("p"))).collect()] == [2, 1, 0, 1, 0]


def test_consistency(spark):
    df = spark.createDataFrame([("a", 0, 0, [0.0]), ("a", 1, 0, [2.0]), ("b", 0, 1, [10.0]), ("b", 1, 1, [14.0]), ("b", 2, 1, [18.0])], "grp string, view_idx int, y int, x array<double>")
    assert sorted((r["grp"], r["x"][0]) for r in vectors.consistency_rows(df).collect()) == [("a", 1.0), ("b", 12.0), ("b", 14.0)]
    assert vectors.with_consistency(df).count() == 8


def test_extra_views(spark):
    base = spark.createDataFrame([(i, v, i % 2, [10.0 * i + v]) for i in range(6) for v in range(4)], "grp int, view_idx int, y int, x array<double>")
    extra = spark.createDataFrame([(i, i % 2, [10.0 * i + 7]) for i in range(6)], "grp int, y int, x array<double>")
    got = vectors.merge_extra_views(base, extra)
    assert sorted((r["grp"], r["view_idx"], r["x"][0]) for r in got.collect())[:5] == [(0, 0, 0.0), (0, 1, 1.0), (0, 2, 2.0), (0, 3, 3.0), (0, 4, 7.0)]
    for bad in (extra.withColumn("y", 1 - F.col("y")), extra.filter("grp < 5"), extra.withColumn("x", F.array(F.lit(1.0), F.lit(2.0)))):
        with pytest.raises(PySparkException):
            vectors.merge_extra_views(base, bad).collect()


def test_width_check(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    assert one(df.select(vectors.padded(F.col("x"), 2, 4).alias("z")))["z"] == [1, 2, 0, 0]
    for bad in (vectors.checked(F.col("x"), 3), vectors.checked(F.array(F.lit(math.nan)), 1)):
        with pytest.raises(PySparkException):
            df.select(bad).collect()


def test_near_pairs_by_brute_force(spark):
    rng = np.random.default_rng(5)
    p, d = rng.integers(-(1 << 62), 1 << 62, 300), rng.integers(-(1 << 62), 1 << 62, 300)
    for i in range(0, 200, 2):
        p[i + 1], d[i + 1] = p[i] ^ int(sum(1 << int(b) for b in rng.choice(60, rng.integers(0, 6), False))), d[i] ^ int(sum(1 << int(b) for b in rng.choice(60, rng.integers(0, 4), False)))
    bits = lambda a, b: bin((int(a) ^ int(b)) & ((1 << 64) - 1)).count("1")
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if bits(p[i], p[j]) <= 4 and bits(d[i], d[j]) <= 2}
    df = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(p, d, strict=True))], "id int, p long, d long")
    assert {(r["a"], r["b"]) for r in identity.near_pairs(df, df).filter("a < b").collect()} == want and want


def test_first_come_is_sequential(spark):
    rng = np.random.default_rng(8)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 60, (120, 2)) if a < b}
    taken = set()
    for i in range(60):
        if not any((j, i) in edges for j in taken):
            taken.add(i)
    got = acquisition.first_come(spark.range(60), spark.createDataFrame(sorted(edges), "a long, b long"))
    assert {r["id"] for r in got.filter("accepted").collect()} == taken


def test_identical_models_have_no_difference(spark, sf):
    from tesserix.sources.relations import scored_views

    r = resample.paired_interval(scored_views(spark, sf).withColumn("copy", F.col("score_a")), ["condition"], "score_a", "copy", 5, "t").collect()
    assert r and all(x["lo"] == 0 and x["hi"] == 0 for x in r)


#: Published values: transform, AUC and accuracy of two models (fixed values).
PUBLISHED = (
    ("clean", 0.9629, 0.9812, 0.9007, 0.9286), ("jpeg_90", 0.9658, 0.9832, 0.9107, 0.9414), ("jpeg_70", 0.9736, 0.9867, 0.9186, 0.9450), ("jpeg_50", 0.9667, 0.9825, 0.9079, 0.9371), ("jpeg_30", 0.9557, 0.9731, 0.8843, 0.9121),
    ("blur_0.5", 0.9638, 0.9814, 0.8979, 0.9250), ("blur_1.0", 0.9622, 0.9789, 0.8593, 0.8636), ("blur_2.0", 0.9536, 0.9727, 0.8793, 0.9021), ("resize_0.5", 0.9621, 0.9794, 0.8657, 0.8879), ("resize_0.25", 0.9472, 0.9675, 0.8714, 0.8950),
    ("noise_0.02", 0.9572, 0.9782, 0.8929, 0.9257), ("noise_0.05", 0.9563, 0.9756, 0.8843, 0.9171), ("noise_0.10", 0.9512, 0.9689, 0.8957, 0.9193), ("jitter_0.20", 0.9411, 0.9676, 0.8657, 0.9036), ("crop_0.80", 0.9578, 0.9792, 0.8921, 0.9300),
)


def test_published_comparison(spark):
    made = spark.createDataFrame([(n, i, *v) for i, (n, *v) in enumerate(PUBLISHED)], "transform string, ord int, a double, b double, x double, y double")
    side = lambda auc, acc: made.select("transform", "ord", F.col(auc).alias("auc"), (F.col(auc) - 0.008).alias("auc_lo"), (F.col(auc) + 0.008).alias("auc_hi"), F.col(acc).alias("acc"))
    compared = tables.compare(side("a", "x"), side("b", "y"))
    rows = {r["transform"]: r for r in compared.collect()}
    assert len(rows) == 15 and round(rows["clean"]["delta_auc"], 4) == 0.0183 and round(rows["jitter_0.20"]["delta_auc"], 4) == 0.0265
    assert one(tables.compare_summary(compared))["verdict"] == "better"


def test_locks(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, sha256 string")
    assert integrity.locked(a, a, a).count() == 2
    with pytest.raises(ValueError):
        integrity.locked(a, a, a.filter("path = 'x'"))
    assert integrity.agreeing(a.withColumn("v", F.lit(1)), "v").count() == 2
    with pytest.raises(ValueError):
        integrity.agreeing(a, "sha256")


def test_shards_cover_all(spark):
    got = [r["shard"] for r in sampling.contiguous_shards(spark.range(103), "id", 103, 7).orderBy("id").collect()]
    cuts = [int(i * 103 / 7) for i in range(8)]
    assert got == [next(k for k in range(7) if cuts[k] <= i < cuts[k + 1]) for i in range(103)]


def test_platt_and_logistic(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    x = rng.normal(0, 1, (300, 2)) + y[:, None] * 1.5
    df = spark.createDataFrame([(i, int(b), [float(v) for v in a], 0) for i, (a, b) in enumerate(zip(x, y, strict=True))], "grp int, y int, x array<double>, sid int")
    head = heads.fit_logistic(df)
    s = df.withColumn("score", head.score(F.col("x")))
    assert one(metrics.auc(s, []))["auc"] > 0.9
    a, b = heads.fit_platt(s)
    assert a < 0
    p = s.select(F.avg(scalars.platt(F.col("score"), a, b)).alias("p"), F.avg("y").alias("y")).first()
    assert p["p"] == pytest.approx(p["y"], abs=0.02)


def test_replace_section(spark):
    df = spark.createDataFrame([("a\n<!-- t:start -->\nold\n<!-- t:end -->\nz",)], "s string")
    assert df.select(tables.replace_section(F.col("s"), "t", "new")).first()[0] == "a\n<!-- t:start -->\nnew\n<!-- t:end -->\nz"


# images


@pytest.mark.parametrize("op", ["jpeg", "blur", "resize", "noise", "jitter", "crop"])
def test_degradations_keep_shape_and_repeat(op):
    image = pixels.generated(3, 50, 41)
    param = {"jpeg": 50, "blur": 1.0, "resize": 0.25, "noise": 0.05, "jitter": 0.2, "crop": 0.8}[op]
    out = pixels.apply(image, op, param)
    assert out.shape == image.shape and out.dtype == np.uint8 and not np.array_equal(out, image)
    assert np.array_equal(out, pixels.apply(image, op, param))


def test_image_kernels():
    image = pixels.generated(1, 64, 64)
    assert pixels.apply(image, None) is image
    with pytest.raises(ValueError):
        pixels.apply(image, "swirl", 1)
    error = lambda q: np.abs(pixels.jpeg(image, q).astype(int) - image).mean()
    assert error(90) < error(50) < error(10)
    assert pixels.blockiness(pixels.jpeg(pixels.blur(image, 2.0), 10)) > pixels.blockiness(pixels.blur(image, 2.0))
    assert [len(pixels.multi_crops(image, n)) for n in (1, 2, 4, 5, 9)] == [1, 2, 4, 5, 5]
    f = pixels.forensic(image)
    assert f.shape == (28,) and np.isfinite(f).all()
    assert pixels.corner_summary(image).shape == (56,)
    flat = np.full((40, 40, 3), 7, np.uint8)
    assert pixels.dhash(flat) == 0 and np.isfinite(pixels.forensic(flat)).all()
    assert bin(pixels.phash(image) ^ pixels.phash(pixels.jpeg(image, 90))).count("1") <= 10
    for o in range(1, 9):
        turned = pixels.oriented(image[:, :30], o)
        assert turned.shape[:2] == ((30, 64) if o >= 5 else (64, 30))


def test_image_files(spark, tmp_path):
    """A broken file gives a row without pixels; others come as R, G, B."""
    from tesserix.operators import images

    folder = tmp_path / "val" / "real"
    folder.mkdir(parents=True)
    body = bytes([0, 0, 255] * 2 + [0, 0])  # a row of two red pixels, padded
    head = b"BM" + (54 + 8).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    (folder / "0_1.BMP").write_bytes(head + body)
    (folder / "0_2.jpg").write_bytes(b"\xff\xd8broken")
    (folder / "note.txt").write_text("x")
    assert {(r["label"], r["split"]) for r in images.scan_images(spark, str(tmp_path)).collect()} == {(0, "val")}
    got = {r["path"].rsplit("/", 1)[1]: r for r in images.decode_images(spark, str(tmp_path)).collect()}
    assert bytes(got["0_1.BMP"]["pixels"]) == bytes([255, 0, 0] * 2) and got["0_2.jpg"]["pixels"] is None


def test_views_and_scores(spark):
    from tesserix.operators import images

    made = images.generated_images(spark, 2, 32)
    assert images.expand_views(made, "v3", "train").count() == 14
    with pytest.raises(ValueError):
        images.scored(made, ["img_id"], lambda i: np.zeros(2), np.zeros(3), 0.0)
    fails = images.scored(made, ["img_id"], lambda i: np.zeros(3) if i.shape[0] == 8 else 1 / 0, np.zeros(3), 0.0)
    assert [r["pred"] for r in fails.collect()] == [0.5, 0.5]
    assert len(images.paired_views(pixels.generated(1), 4)) == 6
    assert np.array_equal(images.stacked_view(pixels.generated(1), 4), images.stacked_view(pixels.generated(1), 4))


# streams


def test_stream_restart_and_replay(spark, tmp_path):
    """A stream that stopped goes on where it was; replayed content changes nothing."""
    from tesserix.streaming import quotas

    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    spark.createDataFrame([(0, "a"), (0, "b")], "sid int, text string").coalesce(1).write.parquet(src)
    go = lambda: quotas.run_to_table(quotas.once_by_content(quotas.read_stream(spark, src, "sid int, text string")), "t", path=out, checkpoint=ckpt)
    assert go().count() == 2
    spark.createDataFrame([(0, "b"), (1, "c"), (2, "d"), (1, "c")], "sid int, text string").coalesce(1).write.mode("append").parquet(src)
    assert sorted(r["text"] for r in go().collect()) == ["a", "b", "c", "d"]


def test_stream_quota(spark, tmp_path):
    from tesserix.streaming import quotas

    src = str(tmp_path / "in")
    spark.range(100).selectExpr("int(id % 3) AS sid", "id").repartition(5).write.parquet(src)
    got = quotas.run_to_table(quotas.fill_quotas(quotas.read_stream(spark, src, "sid int, id long"), "sid", 7, ["id"]), "q")
    assert {r["sid"]: r["count"] for r in got.groupBy("sid").count().collect()} == {0: 7, 1: 7, 2: 7}


def test_ledger(spark, tmp_path):
    from tesserix.streaming import quotas

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "k int, v string").coalesce(1).write.parquet(src)
    quotas.once_into(quotas.read_stream(spark, src, "k int, v string"), out, "k", str(tmp_path / "ck"))
    assert spark.read.parquet(out).count() == 2


def test_hash_helpers(spark):
    df = spark.createDataFrame([([float(i % 5) for i in range(64)],)], "x array<double>")
    x = np.array([float(i % 5) for i in range(64)]).reshape(8, 8)
    bits = (x[:, 1:] > x[:, :-1]).ravel()
    assert df.select(hashing.dhash(F.col("x"))).first()[0] == sum(int(b) << i for i, b in enumerate(bits))
    c = (pixels.DCT @ x @ pixels.DCT.T).ravel()
    got = df.select(hashing.dct2(F.col("x"))).first()[0]
    assert np.allclose(got, c, atol=1e-9)


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "grp string, y int, score double, condition string")
    assert metrics.robustness_table(empty, ["condition"]).count() == 0
    assert policy.select_policy(empty, ["condition"]).count() == 0

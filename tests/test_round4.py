"""Findings of round 3: inputs on which a query failed, differed from its SQL or grew too fast."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tesserix.operators import vectors
from tesserix.plans import catalogue

from .test_oracle import canonical


def _same_as_sql(name, spark, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert canonical(catalogue.QUERIES[name](spark, str(folder)).toPandas()) == canonical(con.sql(catalogue.ORACLE_SQL[name]).df())


@pytest.fixture(scope="module")
def broken_blocks(tmp_path_factory):
    """Vectors of which the last original has two views, one before lacks its last."""
    folder = tmp_path_factory.mktemp("broken")
    ids = [i for i in range(30) if i != 11]
    x = [[((i * 31 + k * 7) % 41 - 20) / 20 for k in range(64)] for i in ids]
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(x, pa.list_(pa.float32()))}), folder / "embeddings.parquet")
    return folder


def test_extra_views_of_incomplete_blocks(spark, broken_blocks):
    _same_as_sql("extra_view_merge", spark, broken_blocks, "embeddings")


def test_partial_extra_views_need_a_known_original(spark):
    base = spark.createDataFrame([(1, 0, 0, [1.0]), (2, 0, 1, [2.0])], "grp long, view_idx int, y int, x array<double>")
    extra = spark.createDataFrame([(3, 1, [2.0])], "grp long, y int, x array<double>")
    with pytest.raises(Exception, match="other originals"):
        vectors.merge_extra_views(base, extra, partial=True).collect()


def test_views_are_counted_in_incomplete_blocks(spark, broken_blocks):
    _same_as_sql("feature_cache_round_trip", spark, broken_blocks, "embeddings")
    rows = catalogue.QUERIES["feature_cache_round_trip"](spark, str(broken_blocks)).collect()
    assert {r["grp"]: r["n_views"] for r in rows} == {0: 2, 1: 2, 2: 1, 3: 2, 4: 2, 5: 2, 6: 2, 7: 1}


def test_statistics_of_small_images_are_those_of_the_mirrored_square():
    import numpy as np

    from tesserix.functions import pixels as px

    rng = np.random.default_rng(4)
    for h, w in ((24, 24), (32, 32), (7, 33), (256, 256), (300, 90), (1, 1)):
        image = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        square = px.centre_square(image)
        assert np.allclose(px.forensic(image), px.forensic(square), rtol=1e-9, atol=1e-12)
        g = square.astype(np.float64) / 255 @ px.LUMA
        f, k = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(g)))), np.exp(-0.5 * np.arange(-2, 3) ** 2.0)
        r = g - px._separable(g[:, :, None], k / k.sum())[:, :, 0]
        yy, xx = np.mgrid[:256, :256] - 128
        far, got = np.hypot(yy, xx) / 128, px.forensic(image)
        assert np.allclose(got[:5], [r.mean(), r.std(), np.abs(r).mean(), *np.percentile(r, [5, 95])], rtol=1e-9, atol=1e-12)
        assert np.allclose(got[10:16], [f[(far >= a) & (far < b)].mean() for a, b in ((0, 0.125), (0.125, 0.25), (0.25, 0.5), (0.5, 0.75), (0.75, 1), (1, 1.5))])
        assert np.allclose(got[25:], [px.laplacian(g).var(), g.mean(), g.std()])


def test_small_images_cost_little():
    """A 24 x 24 image took some 30 ms, as all 65,536 places of its mirrored square were computed; what it repeats is computed once."""
    from tesserix.functions import pixels as px

    assert px._Axis(24).smooth.shape[0] <= 28 and len(px._Axis(32).blocks) <= 8


def test_image_batches_are_bounded(spark, broken_blocks):
    from tesserix.operators import images
    from tesserix.sources.relations import features

    made = images.block_images(features(spark, str(broken_blocks)))
    assert int(made.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != "1000"
    slices = list(images._few([pa.RecordBatch.from_arrays([pa.array(range(1000))], ["a"])]))
    assert sum(b.num_rows for b in slices) == 1000 and max(b.num_rows for b in slices) <= images.IMAGES


def test_calibration_reads_its_scores_once(spark, sf):
    """Every Newton step used to make the scored views, ranks and folds again."""
    from tesserix.operators import calibration

    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(i % 2, i / 50, int(i * 7 % 11 > 4)) for i in range(50)], "fold int, score double, y int").mapInArrow(seen, "fold int, score double, y int")
    assert len(calibration.fit_folds(rows)) == 2
    assert made.value == 50


def test_small_images_share_tasks(spark, tmp_path):
    """Four megabytes for opening a file made a task of every 32 images."""
    import numpy as np

    from tesserix.functions import pixels as px
    from tesserix.operators import images

    (tmp_path / "val" / "real").mkdir(parents=True)
    for i in range(300):
        (tmp_path / "val" / "real" / f"i{i}.png").write_bytes(px.png(np.full((8, 8, 3), i % 256, np.uint8)))
    found = images.scan_images(spark, str(tmp_path))
    assert found.count() == 300 and found.rdd.getNumPartitions() <= 8
    assert images.decode_images(spark, str(tmp_path)).filter("pixels is not null").count() == 300


def test_rounds_of_acceptance_broadcast_nothing_that_grows(spark):
    """Broadcasts of the rows that are near, in every round of every role, added up on the driver."""
    from tesserix.operators import acquisition

    state = spark.createDataFrame([(i, i % 7, None) for i in range(50)], "id long, h long, accepted boolean")
    near = spark.createDataFrame([(i, i) for i in range(7)], "a long, b long")
    heard = acquisition._near_before(state, near)
    assert heard.count() == 7
    assert "BroadcastHashJoin" not in heard._jdf.queryExecution().executedPlan().toString()


def test_a_grid_scales_each_fold_once(spark, monkeypatch):
    from tesserix.operators import heads

    rows = spark.createDataFrame([([float(i % 7), float(i * 5 % 11)], int(i % 3 > 0), i % 3, i % 2) for i in range(40)], "x array<double>, y int, sid int, fold int")
    calls, real = [], heads.moments
    monkeypatch.setattr(heads, "moments", lambda *a: calls.append(1) or real(*a))
    found = heads.grid(rows, 2, cs=(0.1,), weights=(1.0, 5.0))
    assert len(calls) == 2
    alone = [heads.auc(heads.cross_validated(rows, 2, c=0.1, weight=heads.F.when(heads.F.col("sid") == 2, w).otherwise(1.0)), []).first()["auc"] for w in (1.0, 5.0)]
    assert [round(a, 9) for a, _, _ in found] == [round(a, 9) for a in alone]

"""Sources and sinks."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserix import cli
from tesserix.operators.heads import LinearHead
from tesserix.sources import files


def test_json_and_config(tmp_path):
    path = str(tmp_path / "a" / "c.json")
    files.write_json(path, {"data_dir": "d", "k": [1, 2.5]})
    assert files.read_config(path)["data_dir"] == str(tmp_path / "a" / "d")
    with pytest.raises(ValueError):
        files.write_json(path, {"x": [float("nan")]})
    assert json.loads(open(path).read())["k"] == [1, 2.5]
    assert len(files.file_digest(path)) == 64


def test_tables(spark, tmp_path):
    a, b = str(tmp_path / "a.csv"), str(tmp_path / "b.csv")
    open(a, "w").write("transform,auc\nclean,0.9\njpeg_30,0.8\nclean,0.91\n")
    open(b, "w").write("transform,auc\njpeg_30,0.85\n")
    got = {r["transform"]: r["auc"] for r in files.read_table(spark, [a, b], "transform string, auc double").collect()}
    assert got == {"clean": 0.91, "jpeg_30": 0.85}
    files.write_table(files.read_table(spark, [a], "transform string, auc double"), str(tmp_path / "out"), ["transform", "auc", "tpr"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["transform", "auc", "tpr"]


def test_feature_cache(spark, tmp_path):
    path = str(tmp_path / "f")
    df = spark.createDataFrame([(1, [1.0], "train"), (2, [2.0], "test")], "grp long, x array<double>, role string")
    files.write_features(df, path)
    files.write_features(df.filter("role = 'test'").withColumn("grp", F.lit(3).cast("long")), path)
    assert [r["grp"] for r in files.read_features(spark, path, "train").collect()] == [1]
    assert [r["grp"] for r in files.read_features(spark, path, "test").collect()] == [3]


def test_predictions(spark, tmp_path):
    df = spark.createDataFrame([("b", 2.0), ("a", float("nan"))], "path string, pred double")
    assert json.loads(files.predictions_array(df)) == [{"image_path": "a", "pred": 0.5}, {"image_path": "b", "pred": 1.0}]
    files.write_predictions(df, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).columns == ["image_path", "pred"]


def test_heads_and_scoring(spark, tmp_path):
    path = str(tmp_path / "h.json")
    with pytest.raises(FileNotFoundError):
        files.load_head(path)
    files.save_head(path, LinearHead([0.0] * 3, [1.0] * 3, [1.0, -1.0, 0.0], 0.2), {"feature_dim": 3})
    head, meta = files.load_head(path)
    assert meta["feature_dim"] == 3
    folder = tmp_path / "images"
    folder.mkdir()
    size = (2).to_bytes(4, "little") + (1).to_bytes(4, "little")
    (folder / "x.bmp").write_bytes(b"BM" + (62).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + size + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24) + bytes([0, 0, 255] * 2 + [0, 0]))
    (folder / "y.jpg").write_bytes(b"broken")
    mean = lambda image: image.reshape(-1, 3).mean(0) / 255
    got = {r["path"].rsplit("/", 1)[1]: r["pred"] for r in cli.score_folder(spark, str(folder), mean, head)}
    assert got["y.jpg"] == 0.5 and got["x.bmp"] == pytest.approx(1 / (1 + np.exp(-1.2)))
    assert cli.score_folder(spark, str(folder / "none"), mean, head) == []
    with pytest.raises(ValueError):
        cli.score_folder(spark, str(folder), lambda i: np.zeros(2), head)
    assert files.digests(spark, str(folder)).count() == 2

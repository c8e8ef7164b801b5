"""Acquisition in order, loose radii, contamination, sources' status."""

import random

import pytest
from pyspark.sql import functions as F

from tesserix.operators import acquisition, identity, integrity


def sequential(rows, near, limits):
    """rows: (id, h, keys of the limits); the rule row by row."""
    kept, count = [], {}
    for i, h, *keys in sorted(rows):
        if any(h == g or (h, g) in near or (g, h) in near for _, g in kept):
            continue
        if any(count.get((k, x), 0) >= cap for k, (x, cap) in enumerate(zip(keys, limits, strict=True))):
            continue
        kept.append((i, h))
        for k, x in enumerate(keys):
            count[k, x] = count.get((k, x), 0) + 1
    return {i for i, _ in kept}


@pytest.mark.parametrize("seed", range(3))
def test_acceptance_is_sequential(spark, seed):
    rng = random.Random(seed)
    n = 150
    hashes = [rng.randrange(90) for _ in range(n)]
    near = {(rng.randrange(90), rng.randrange(90)) for _ in range([40, 90, 5][seed])} | {(k, k + 1) for k in range(10, 40)}
    near = {(a, b) for a, b in near if a != b}
    rows = [(i, h, i % 3, (i * 7) % 5 * 10 + i % 3) for i, h in enumerate(hashes)]
    want = sequential(rows, near, [12, 4])
    frame = spark.createDataFrame(rows, "id long, h long, role long, model long")
    edges = spark.createDataFrame(sorted(near), "a long, b long")
    got = acquisition.accept_in_order(frame, edges, [(["role"], 12), (["model"], 4)])
    assert {r["id"] for r in got.filter("accepted").collect()} == want and got.count() == n


def test_chains_take_logarithmic_rounds(spark):
    n, rounds = 300, []
    got = acquisition.first_come(spark.range(n), spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), rounds)
    assert sorted(r["id"] for r in got.filter("accepted").collect()) == list(range(0, n, 2)) and rounds[0] <= 12
    rounds = []
    # one hash for most rows, and a full group: decided at once, whatever their number
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 > 0, -1).otherwise(F.col("id")).cast("long").alias("h"), (F.col("id") % 2).alias("g"))
    got = acquisition.accept_in_order(rows, spark.createDataFrame([], "a long, b long"), [(["g"], 5)], rounds).filter("accepted")
    assert sorted(r["id"] for r in got.collect()) == [0, 1, 10, 20, 30, 40] and rounds[0] <= 4


def test_roles_are_filled_one_after_the_other(spark):
    rows = [(i, i, "s" if i < 40 else "t", f"m{i % 2}") for i in range(60)]
    near = spark.createDataFrame([(0, 41), (3, 4)], "a long, b long")  # 41 of the second source is near to 0 of the first
    frame = spark.createDataFrame(rows, "id long, h long, source string, model string")
    got, told = acquisition.acquire(frame, near, [("s", [("train", 6), ("dev", 5)], 3), ("t", [("train", 4), ("test", 100), ("late", 1)], None)])
    got = {r["id"]: (r["source"], r["role"]) for r in got.collect()}
    # 0..: m0 and m1 in turn, 4 refused; three of each model, then dev begins after the last
    assert [i for i, x in got.items() if x == ("s", "train")] and sorted(i for i, x in got.items() if x == ("s", "train")) == [0, 1, 2, 3, 5, 6]
    assert sorted(i for i, x in got.items() if x == ("s", "dev")) == [7, 8, 9, 10, 11]
    assert sorted(i for i, x in got.items() if x == ("t", "train")) == [40, 42, 43, 44] and sum(x == ("t", "test") for x in got.values()) == 15
    assert told == [("s", "train", 6, 6), ("s", "dev", 5, 5), ("t", "train", 4, 4), ("t", "test", 100, 15), ("t", "late", 1, 0)]


def test_loose_pairs_against_all_pairs(spark, monkeypatch):
    rng = random.Random(1)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    a = [(i, rng.getrandbits(64), rng.getrandbits(64)) for i in range(300)]
    b = [(1000 + i, rng.getrandbits(64), rng.getrandbits(64)) for i in range(200)]
    b += [(2000 + i, flip(p, rng.randint(8, 14)), flip(d, rng.randint(7, 12))) for i, p, d in a]
    a += [(400 + i, flip(0, rng.randint(0, 9)), rng.getrandbits(3)) for i in range(60)]
    b += [(3000 + i, flip(0, rng.randint(0, 9)), rng.getrandbits(3)) for i in range(60)]  # pieces that many share
    want = {(i, j, x, y) for i, p, d in a for j, q, e in b if (x := (p ^ q).bit_count()) <= 12 and (y := (d ^ e).bit_count()) <= 10}
    made = lambda rows: spark.createDataFrame([(i, signed(p), signed(d)) for i, p, d in rows], "id long, p long, d long")
    assert {tuple(r) for r in acquisition.loose_pairs(made(a), made(b)).collect()} == want and len(want) > 100
    monkeypatch.setattr(acquisition, "HOT_PAIRS", 50)
    assert {tuple(r) for r in acquisition.loose_pairs(made(a), made(b)).collect()} == want


def test_loose_keys_select(spark):
    """3,000 x 3,000 random hashes: fewer than 1 % of all pairs meet at a key."""
    h = spark.range(6000).select("id", F.xxhash64("id", F.lit("p")).alias("p"), F.xxhash64("id", F.lit("d")).alias("d"))
    cuts = acquisition._cuts(10, 3, 64)
    assert sum(r + 1 for _, _, r in cuts) == 11 and sum(w for _, w, _ in cuts) == 64
    left, right = (acquisition._probes(h.filter(f"id % 2 = {k}"), "d", cuts, bool(k), "key") for k in (0, 1))
    assert left.select("key", F.col("id").alias("a")).join(right.select("key", F.col("id").alias("b")), "key").count() < 0.01 * 3000 * 3000


def test_contamination_by_keys_and_by_automata_agree(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    text = lambda n: "".join(word() + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    docs = [(i, text(80)) for i in range(40)] + [(50, None), (51, "")]
    items = [(i, text(rng.randint(1, 4))) for i in range(30)] + [(100 + i, docs[i][1][(at := rng.randint(0, 40)) : at + rng.randint(5, 70)]) for i in range(30)] + [(200, ""), (201, None), (202, "🎈"), (203, items_text := docs[3][1][:20]), (204, items_text)]
    args = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t in docs for i, p in items if t and p and p in t}
    for most in (identity.MOST_CHARS, 0):
        monkeypatch.setattr(identity, "MOST_CHARS", most)
        monkeypatch.setattr(identity, "BLOCK_CHARS", 100)
        assert {(r["doc_id"], r["item_id"]) for r in identity.protected_contamination(*args).collect()} == want
    assert identity.protected_contamination(args[0], args[1].limit(0)).count() == 0


def test_source_status(spark):
    receipts = [("a.py", "1"), ("b.py", "old"), ("c.py", None), ("/etc/x", "1"), ("x/../../y", "1"), ("gone.py", "1"), ("d.py", "1"), ("e.py", "old")]
    registry = [("b.py", "new", "old", "kept/b"), ("e.py", "new", "old", "../e")]
    digests = [("a.py", "1"), ("b.py", "new"), ("kept/b", "old"), ("c.py", "9"), ("/etc/x", "1"), ("d.py", "2"), ("e.py", "new")]
    made = lambda rows, names: spark.createDataFrame(rows, names)
    got = integrity.source_status(made(receipts, "path string, sha256 string"), made(registry, "path string, current string, archived string, snapshot string"), made(digests, "path string, sha256 string"))
    assert dict(map(tuple, got.collect())) == {"a.py": "current", "b.py": "archived", "c.py": "current", "/etc/x": "outside", "x/../../y": "outside", "gone.py": "missing", "d.py": "changed", "e.py": "outside"}


def test_jpeg_reader(spark, tmp_path):
    """Four inks, greys, colours, files that end too early and rotations: against what was written."""
    import numpy as np

    from tesserix.functions import pixels as px
    from tesserix.functions.jpeg_reader import read_jpeg
    from tesserix.operators import images

    image = px.blur(px.generated(3, 37, 53), 2.0)
    inks = np.concatenate([255 - image.astype(int), np.full((*image.shape[:2], 1), 40)], 2)
    want = (255 - inks[:, :, :3]) * (255 - 40) / 255
    data = px.ink_file(inks, 95)
    assert np.abs(read_jpeg(data).astype(int) - want).mean() < 2
    assert np.abs(read_jpeg(px.jpeg_file(image, 95)).astype(int) - image).mean() < 2
    half = read_jpeg(data[: len(data) // 2])
    assert half.shape == image.shape and np.abs(half[:8].astype(int) - want[:8]).mean() < 3
    assert read_jpeg(b"\x89PNG") is None and read_jpeg(b"\xff\xd8\xff\xd9") is None
    tiff = b"II*\x00\x08\x00\x00\x00\x01\x00\x12\x01\x03\x00\x01\x00\x00\x00\x06\x00\x00\x00\x00\x00\x00\x00"
    exif = b"Exif\x00\x00" + tiff
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_bytes(data)
    (tmp_path / "in" / "b.jpg").write_bytes(data[:2] + b"\xff\xe1" + (len(exif) + 2).to_bytes(2, "big") + exif + data[2:])
    (tmp_path / "in" / "c.jpg").write_bytes(b"nothing")
    got = {r["path"].rsplit("/", 1)[1]: r for r in images.decode_images(spark, str(tmp_path / "in")).collect()}
    back = lambda n: np.frombuffer(got[n]["pixels"], np.uint8).reshape(got[n]["height"], got[n]["width"], 3).astype(int)
    assert np.abs(back("a.jpg") - want).mean() < 2 and np.abs(back("b.jpg") - np.rot90(want, -1)).mean() < 2 and got["c.jpg"]["pixels"] is None


def test_inventory_reads_what_has_changed(spark, tmp_path):
    import os

    from tesserix.sources.inventory import inventory

    folder, store = tmp_path / "files", str(tmp_path / "store")
    (folder / "sub").mkdir(parents=True)
    for i in range(20):
        (folder / ("sub" if i % 2 else ".") / f"f{i}.png").write_bytes(b"x" * (i + 1))
    (folder / "note.txt").write_text("no image")
    with pytest.raises(ValueError, match="required"):
        inventory(spark, str(folder), store, 21, "*.png")
    told = {}
    first = {r["path"]: r["sha256"] for r in inventory(spark, str(folder), store, 20, "*.png", told).collect()}
    assert told == {"files": 20, "hashed": 20} and len(set(first.values())) == 20
    assert inventory(spark, str(folder), store, 20, "*.png", told).count() == 20 and told["hashed"] == 0
    (folder / "f0.png").write_bytes(b"y")
    os.utime(folder / "f0.png", (1, 1))
    (folder / "f2.png").unlink()
    (folder / "new.png").write_bytes(b"z")
    after = {r["path"]: r["sha256"] for r in inventory(spark, str(folder), store, 20, "*.png", told).collect()}
    assert told == {"files": 20, "hashed": 2} and sum(first.get(p) == s for p, s in after.items()) == 18


def test_encoders(spark):
    """One bad image stays unknown, a broken encoder is an error before any job, a model is made once a worker."""
    import numpy as np

    from tesserix.operators import encoders

    rows = [(i, 2, 3, bytes([i] * 18)) for i in range(10)] + [(20, 2, 3, b"short"), (21, None, None, None), (22, 2, 3, bytes([255] * 18)), (23, 1, 1, bytes([7, 7, 7]))]
    df = spark.createDataFrame(rows, "id long, height int, width int, pixels binary")

    def make():
        def model(a):
            if (a == 255).any():
                raise ValueError("can't encode this one")
            return a.reshape(len(a), -1).mean(1, keepdims=True)

        return model

    probe = np.zeros((2, 3, 3), np.uint8)
    got = {r["id"]: r["pred"] for r in encoders.scored(df, make, probe, lambda x: F.get(x, 0) / 10, batch=4).collect()}
    assert got == {i: i / 10 for i in range(10)} | {20: 0.5, 21: 0.5, 22: 0.5, 23: 0.7}
    for broken in (lambda: lambda a: 1 / 0, lambda: lambda a: np.full((1, 2), np.nan), lambda: lambda a: np.zeros(3)):
        with pytest.raises(RuntimeError, match="encoder"):
            encoders.encoded(df, broken, probe)


def test_role_views_are_checked(spark):
    from tesserix.functions import table_functions

    table_functions.register(spark)
    assert spark.sql("SELECT * FROM role_views('none', 'v4')").count() == 0 and spark.sql("SELECT * FROM role_views('test', 'v4')").count() == 19
    for bad in ("role_views(1, 'v4')", "role_views('test', 'v9')"):
        with pytest.raises(Exception, match="role|generation"):
            spark.sql(f"SELECT * FROM {bad}").collect()

"""Findings of round 3, taken up again."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserix.operators import acquisition, boosting, resample


def test_draws_are_packed_rows_and_parts_may_share_a_score(spark, monkeypatch):
    """A block holds 200 repetitions, so 60 originals and 250 repetitions make at most 120 rows; AUCs are those of plain counting, whatever the parts, with one very frequent score."""
    monkeypatch.setattr(resample, "PART_ROWS", 7)
    monkeypatch.setattr(resample, "SLOTS", 8)
    monkeypatch.setattr(resample, "TASK_DRAWS", 500)
    made = [(g, None if c == 2 else f"c{c}", int(g % 3 > 0), 0.5 if g % 4 else (g * 7 % 5) / 10, float("nan") if g % 9 == 0 else (g * 13 % 11 - 3) / 8) for g in range(60) for c in range(3)]
    df = spark.createDataFrame(made, "grp long, condition string, y int, a double, b double")
    weights = resample.draws(df, 250, "t").collect()
    assert len(weights) <= 120 and all(len(r["w"]) == 200 for r in weights)
    drawn = {(r["grp"], 200 * r["block"] + i): n for r in weights for i, n in enumerate(r["w"])}
    assert sum(drawn.values()) == 60 * 250
    found = {(r["condition"], r["model"], r["rep"]): r["auc"] for r in resample.bootstrap_aucs(df, ["condition"], ["a", "b"], 250, "t").collect()}
    assert len(found) == 3 * 2 * 250
    place = lambda v: float("inf") if v != v else v
    for rep in (0, 7, 199, 200, 249):
        for k, model in ((3, "a"), (4, "b")):
            rows = [(place(r[k]), r[2], drawn.get((r[0], rep), 0)) for r in made if r[1] == "c1"]
            pairs = [(v * w, (s > t) + (s == t) / 2) for s, y, v in rows if y for t, z, w in rows if not z]
            want = sum(n * x for n, x in pairs) / sum(n for n, _ in pairs)
            assert abs(found["c1", model, rep] - want) < 1e-12 and found[None, model, rep] == found["c1", model, rep]


def test_boosting_sums_are_a_row_a_node_and_feature(spark):
    """Whatever the number of bins; few row groups are dealt out over all cores; the larger child's sums are its parent's less the smaller one's, and a tie is the first bin's."""
    n = 400
    rows = spark.createDataFrame([(bytes([i % 200, i % 7]), float(i % 2), 1.0) for i in range(n)], "bins binary, y double, w double").coalesce(1)
    model = boosting.Boosted([np.arange(199.0), np.arange(6.0)], 0.0)
    tree = boosting.Tree()
    left, right = tree.split(0, 1, 1)
    root = boosting._sums(boosting._partial_sums(rows, model, boosting.Tree(), [0]), None, [], 1.0, 20)
    parts = boosting._partial_sums(rows, model, tree, [left])
    assert parts.count() == 2
    both = {(r["node"], r["k"]): np.frombuffer(r["hist"], np.int64).reshape(3, 256) for r in boosting._sums(parts, root, [(right, 0, left)], 1.0, 20).collect()}
    for k, of in ((0, lambda i: i % 200), (1, lambda i: i % 7)):
        for node, mine in ((left, lambda i: i % 7 <= 1), (right, lambda i: i % 7 > 1)):
            own = [i for i in range(n) if mine(i)]
            assert both[node, k][0].tolist() == np.bincount([of(i) for i in own], minlength=256).tolist()
            assert both[node, k][1].sum() == sum((1 if i % 2 == 0 else -1) for i in own) * boosting.GRAIN // 2
    sums = np.zeros((3, 256), np.int64)
    sums[:, [3, 5, 9]] = [[30, 30, 30], [boosting.GRAIN, 0, -boosting.GRAIN], [boosting.GRAIN] * 3]
    assert boosting._split_of(sums, 1.0, 20)[1:] == (3, 30) and boosting._split_of(sums, 1.0, 70) is None


def _views(n):
    """Rows four by four, as views of an original that are near to its first one; some originals are near to others."""
    near = {(i - i % 4, i) for i in range(n) if i % 4} | {(i, i + 36) for i in range(0, n - 36, 20)}
    return [(i, i, i % 3, i % 15) for i in range(n)], near


def _in_turn(rows, near, limits):
    """The rule row by row, for rows (id, h, keys of the limits)."""
    kept, count = {}, {}
    for i, h, *keys in sorted(rows):
        if any(h == g or (h, g) in near or (g, h) in near for g in kept.values()) or any(count.get((k, x), 0) >= cap for k, (x, cap) in enumerate(zip(keys, limits, strict=True))):
            continue
        kept[i] = h
        for k, x in enumerate(keys):
            count[k, x] = count.get((k, x), 0) + 1
    return set(kept)


def test_full_groups_take_no_rounds(spark, monkeypatch):
    """Every round wrote all rows, long after nearly all groups were full, and it took two rounds to refuse a row and give its place to another."""
    monkeypatch.setattr(acquisition, "BLOCK_ROWS", 300, raising=False)
    monkeypatch.setattr(acquisition, "CUT_ROWS", 30, raising=False)
    rows, near = _views(4_000)
    written, rounds, real = [], [], acquisition.saved
    monkeypatch.setattr(acquisition, "saved", lambda df, *a: written.append(real(df, *a)) or written[-1])
    monkeypatch.setattr(acquisition, "forget", lambda *a: None)
    edges = spark.createDataFrame(sorted(near), "a long, b long")
    got = acquisition.accept_in_order(spark.createDataFrame(rows, "id long, h long, role long, model long"), edges, [(["role"], 9), (["model"], 2)], rounds)
    assert {r["id"] for r in got.filter("accepted").collect()} == _in_turn(rows, near, [9, 2]) and got.filter("accepted is not null").count() == 4_000
    assert rounds[0] <= 12 and sum(t.count() for t in written) < 8 * 4_000


@pytest.mark.parametrize("seed", range(3))
def test_blocks_give_the_sequential_outcome(spark, monkeypatch, seed):
    """Some groups fill and some never do, hashes repeat, chains of near rows go across blocks, and some rows are decided before."""
    monkeypatch.setattr(acquisition, "BLOCK_ROWS", 10)
    monkeypatch.setattr(acquisition, "CUT_ROWS", 5)
    rng = random.Random(seed)
    n, caps = 200, [(9, 4), (1000, 30), (25, 1)][seed]
    rows = [(i, rng.randrange(120), i % 3, i * 7 % 5 * 10 + i % 3) for i in range(n)]
    near = {(a, b) for a, b in {(rng.randrange(120), rng.randrange(120)) for _ in range(50)} | {(k, k + 1) for k in range(10, 40)} if a != b}
    made, edges = spark.createDataFrame(rows, "id long, h long, role long, model long"), spark.createDataFrame(sorted(near), "a long, b long")
    want, limits = _in_turn(rows, near, caps), [(["role"], caps[0]), (["model"], caps[1])]
    among = lambda h: edges.join(h.withColumnRenamed("h", "a"), "a", "left_semi").join(h.withColumnRenamed("h", "b"), "b", "left_semi")
    got = acquisition.accept_in_order(made, among, limits)
    assert {r["id"] for r in got.filter("accepted").collect()} == want and got.filter("not accepted").count() == n - len(want)
    # the first 30 rows are told, the others follow
    told = made.withColumn("accepted", F.when(F.col("id") < 30, F.col("id").isin(sorted(want))))
    assert {r["id"] for r in acquisition.accept_in_order(told, edges, limits).filter("accepted").collect()} == want


def test_roles_are_filled_block_by_block(spark, monkeypatch):
    """Ids are pairs there: what earlier sources gave comes first."""
    rows, near = _views(80)
    frame = spark.createDataFrame([(i, h, f"s{i % 2}", f"m{i // 4 % 3}") for i, h, *_ in rows], "id long, h long, source string, model string")
    edges, sources = spark.createDataFrame(sorted(near), "a long, b long"), [("s1", [("train", 4)], 2), ("s0", [("train", 3), ("test", 40)], None)]
    whole, told = acquisition.acquire(frame, edges, sources)
    monkeypatch.setattr(acquisition, "BLOCK_ROWS", 8)
    monkeypatch.setattr(acquisition, "CUT_ROWS", 4)
    parted, again = acquisition.acquire(frame, edges, sources)
    assert told == again and sorted(map(tuple, whole.collect())) == sorted(map(tuple, parted.collect())) and whole.count() > 10

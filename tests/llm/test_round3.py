"""Rows without identifiers, repeated identifiers, odd letters, and the operators for whitening, quality and resampling."""

import os
import random
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tesserix import runtime
from tesserix.llm import bpe, langid, mixing, ngram_join, quality, queries, resampling, sampling, whitening


def test_every_code_point_is_encoded_as_by_the_library():
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    library, own = Tokenizer.from_file(path), bpe.bpe(path)
    library.no_padding()
    library.no_truncation()
    wrong = []
    for low in range(0, 0x110000, 4096):
        points = [c for c in range(low, low + 4096) if not 0xD800 <= c < 0xE000]
        texts = [f"a{chr(c)}b 1{chr(c)}" for c in points]
        wrong += [hex(c) for c, t, e in zip(points, texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if own.encode(t).tolist() != e.ids]
    assert not wrong
    for text in ("Ɓala", "Əliyev Ɗan", "x\U000105c0y<|im_end|>" if unicodedata.category("\U000105c0") == "Cn" else "x"):
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_links_of_null_and_repeated_ids(spark):
    """Links and classes against brute force over rows: every pair of doc_id and text is a document."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 9999)}"
    a, b, c = ([word() for _ in range(60)] for _ in range(3))
    t = lambda w: " ".join(w)
    rows = [(1, t(a)), (2, t(a + ["x"])), (2, t(b)), (3, t(b + ["y"])), (None, t(a + ["z"])), (None, t(c)), (None, t(c + ["q"])), (None, t(c)), (3, t(b + ["y"])), (4, None), (None, ""), (None, "other words that nothing else has")]
    got = ngram_join.ngram_classes(spark.createDataFrame(rows, "doc_id long, text string").withColumn("__id", F.lit(1))).collect()
    assert len(got) == len(rows)
    shingles = lambda x: {tuple(x.split()[k : k + 5]) for k in range(len(x.split()) - 4)}
    different = {x for _, x in rows if x and len(x.split()) > 4}
    want = Counter()
    for i, x in rows:
        links = sum(len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y)) >= 0.8 for y in different if y != x) if x else 0
        want[i, links] += 1
    assert Counter((r["doc_id"], r["n_links"]) for r in got) == want
    classes = {(r["doc_id"], r["n_links"], r["n_shingles"]): r["class_id"] for r in got}
    assert classes[1, 2, 56] == 1 and classes[2, 2, 57] == 1 and classes[None, 2, 57] == 1  # the row without an id is in class 1
    assert classes[2, 1, 56] == 2 and classes[3, 1, 57] == 2 and classes[None, 1, 56] is None


def test_long_sets_are_parted_by_bytes(spark, monkeypatch):
    """A small group of long texts is cut into blocks by the bytes of its sets, with the same links."""
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(3000)]
    rows = [(i, " ".join(base[: 2900 + i])) for i in range(8)] + [(20 + i, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(500))) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    where = runtime.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(where))
    plain = sorted(map(tuple, ngram_join.ngram_classes(docs).collect()))
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(where)) - before] == ["ngram-documents"]  # intermediate tables are deleted
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 40_000)
    assert sorted(map(tuple, ngram_join.ngram_classes(docs).collect())) == plain
    assert [r[2] for r in plain] == [7] * 8 + [0] * 3


def test_rows_without_ids_keep_their_probability(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("some words here "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    kept = mixing.mix_filter(docs).count()
    assert abs(kept / 4000 - mixing.KEEP) < 0.03
    same = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    assert 0.6 < mixing.mix_filter(same).count() / 400 < 0.8


def test_samples_keep_text_and_label_of_one_row(spark):
    rows = [(7, "an English text", "en"), (7, "un texte", "fr"), (8, "mehr", "de"), (9, None, "en"), (None, "ohne", "de"), (10, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = sampling.sampled_texts(docs, docs.select("doc_id", "label"), 5, "s")
    assert {("an English text", "en"), ("un texte", "fr"), ("mehr", "de")} <= set(got) and all((t, y) in {(x or "", z) for _, x, z in rows} for t, y in got)
    # one huge text doesn't take the place of all the others
    rows = [(1, "y" * 500_000, "a")] + [(i, f"t{i}", "a") for i in range(2, 40)]
    got = sampling.sampled_texts(spark.createDataFrame(rows, "doc_id long, text string, label string").select("doc_id", "text"), spark.createDataFrame([(i, "a") for i, _, _ in rows], "doc_id long, label string"), 60, "s", most_chars=10_000)
    assert len(got) == 39 and max(len(t) for t, _ in got) == 10_000 // sampling.PART


def test_stages_leave_the_session_alone(spark, sf):
    import corpus_pipeline

    before = {k: spark.conf.get(k, None) for k in runtime.WIDE_ROWS}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:2] + corpus_pipeline.STAGES[3:]:
        out = stage(spark, docs, sf)
        assert {k: spark.conf.get(k, None) for k in runtime.WIDE_ROWS} == before
        assert out.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000" and out.count() >= 0

def brute_resample(rows, targets, share=25, least=20):
    """Rows (doc_id, text) to {doc_id: (n_features, weight, score, rank)} by plain Python."""
    import hashlib
    import math
    import re
    import zlib

    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        return len(words), [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]

    own = {i: features(t) for i, t in rows}
    s, t = Counter(), Counter()
    for _, f in own.values():
        s.update(f)
    for x in targets:
        t.update(features(x)[1])
    total, other = sum(s.values()), sum(t.values())
    out = {}
    for i, (n, f) in own.items():
        gain = [math.floor(1000 * math.log((t[b] + 1) * (total + 10_000) / ((s[b] + 1) * (other + 10_000)))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    fits = sorted((i for i in out if out[i][0] >= least), key=lambda i: (-out[i][3], i))
    for k, i in enumerate(fits[: share * len(fits) // 100]):
        out[i][4] = k + 1
    return {i: tuple(x[1:]) for i, x in out.items()}


def test_resampling_by_brute_force(spark, sf, monkeypatch):
    """Whole results on the table, in slices far smaller than a text, and on odd texts: long words, NULs, no words, characters beyond ASCII."""
    monkeypatch.setattr(resampling, "SLICE", 50)
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    odd = [(-1, None), (-2, ""), (-3, "a\0b\0\0c"), (-4, "é" * 200 + " Ünï " + "x" * 5000 + "  " + "Y" * 64 + " " + "z" * 65), (-5, "WORD word, word's İ ÀÉ 1_2\t3"), (-6, " . " * 50), (-7, "\0"), (-8, "one " * 3000)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1))
    want = brute_resample([(r["doc_id"], r["text"]) for r in every.collect()], [r["text"] for r in bench.collect()])
    got = {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in resampling.resample(every, bench).collect()}
    assert got == want
    kept = resampling.resample_filter(every, bench)
    assert kept.columns == every.columns and kept.count() == sum(x[3] is not None for x in want.values())


def test_resampling_of_odd_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (None, text), (None, text), (5, text), (5, text), (6, text + " x"), (7, "short"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    empty = spark.createDataFrame([], "text string")
    got = resampling.resample(docs, empty).collect()
    assert len(got) == 8 and sorted(r["rank"] for r in got if r["rank"]) == [1] and {r["weight"] for r in got if r["doc_id"] == 8} == {0}
    assert resampling.resample(docs.limit(0), docs).count() == 0


def brute_whitening(rows):
    """{row number: (n, deviation, [projections up to sign], [explained])} by numpy over all usable vectors."""
    import math

    x = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    m = np.array([v for _, v in x], np.int64)
    n, s = len(m), m.sum(0)
    centred = m - s / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1][:8], axes[:, ::-1][:, :8]
    gap = n * m - s
    return [i for i, _ in x], n, [sum(int(g) ** 2 for g in r) for r in gap], centred @ axes / np.sqrt(e), e / np.trace(centred.T @ centred / n)


def test_whitening_by_brute_force(spark, sf, monkeypatch):
    """All rows of the table and unusable ones, in blocks far smaller than a partition, with repeated and null ids."""
    monkeypatch.setattr(whitening, "BLOCK", 32)
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    odd = [(-1, None), (-2, []), (-3, [float("nan")] * 64), (-4, [float("inf")] + [0.0] * 63), (-5, [None] + [0.0] * 63), (-6, [0.1] * 63), (-7, [0.1, -0.2] * 32), (-7, [0.1, -0.2] * 32), (None, [0.3] * 64)]
    every = table.select("vec_id", "embedding").unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<float>")).withColumn("x", F.lit(1)).withColumn("block", F.lit(2)).repartition(3)
    rows = [(r["vec_id"], r["embedding"]) for r in every.collect() if r["vec_id"] not in (-2, -6)]
    ids, n, deviation, z, explained = brute_whitening(rows)
    got = whitening.whiten(every).toPandas()
    assert len(got) == 8 * n == 8 * (table.count() + 3) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    assert sorted(zip(got[got.component == 1].vec_id.fillna(-99), got[got.component == 1].deviation, strict=True)) == sorted((-99 if i is None else i, v) for i, v in zip(ids, deviation, strict=True))
    for k in range(8):
        own = got[got.component == k + 1]
        assert np.allclose(own.explained, explained[k], rtol=1e-9)
        one, other = own.groupby(own.vec_id.fillna(-99)).whitened.sum(), {}
        for i, v in zip(ids, z[:, k], strict=True):
            other[-99 if i is None else i] = other.get(-99 if i is None else i, 0) + v
        other = np.array([other[i] for i in one.index])
        assert min(np.abs(one.values - other).max(), np.abs(one.values + other).max()) < 1e-6


def test_whitening_of_odd_tables(spark):
    made = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert made([]) == [] and made([(1, None), (2, [])]) == []
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in made([(1, [0.5, 0.5])])] == [(1, 0, 0.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0)]
    flat = made([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])  # one direction with variance
    assert {r["component"]: round(r["explained"], 9) for r in flat} == {1: 1.0, 2: 0.0, 3: 0.0} and all(abs(r["whitened"]) < 1e-9 for r in flat if r["component"] > 1) and flat[0]["identity_error"] < 1e-9
    large = made([(i, [1e300, float(i)]) for i in range(40)] + [(99, [-1e300, 3.0])])  # too large for longs: clamped entries, and no deviation
    assert len(large) == 82 and {r["deviation"] for r in large} == {None} and all(r["whitened"] == r["whitened"] for r in large)


def test_pairs_in_linear_time():
    """The sum-of-squares identity against all pairs written out."""
    rng = np.random.default_rng(2)
    machine = quality.Machine()
    machine.weights = rng.normal(0, 1, quality.SIZE).astype(np.float32)
    machine.factors, machine.bias = rng.normal(0, 1, (quality.SIZE, quality.FACTORS)).astype(np.float32), 0.3
    make = quality.Vectors()
    vectors = [make.vector(t.encode(), n) for t, n in (("some words and some SIGNS &&& 12\nlines", 38), ("", None), ("x", 7))]
    places, values, starts = machine.rows(vectors)
    want = [quality.pair_sum(machine, places[a:b], values[a:b]) for a, b in zip(starts, [*starts[1:], len(places)], strict=True)]
    assert np.allclose(machine.raw_scores(vectors), want, rtol=1e-3, atol=1e-3)


def test_quality_on_held_out_rows(spark, sf, monkeypatch):
    """Labels outside the fold that is learned from; long texts in slices give the same vectors."""
    where = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    got = quality.quality(docs.join(labels.select("doc_id"), "doc_id"), labels, per_label=800).filter("held_out").join(labels, "doc_id").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    print(f"held out: {len(good)} good, kept {good.predicted.mean():.4f}; {len(bad)} bad, kept {bad.predicted.mean():.4f}")
    assert good.predicted.mean() > 0.99 and bad.predicted.mean() < 0.05 and got.score.between(0, 1).all()
    text = ("Words, signs &&& and\nlines é" * 50).encode()
    whole = quality.Vectors().vector(text, 5)
    monkeypatch.setattr(quality, "SLICE", 40)
    assert all(np.array_equal(a, b) for a, b in zip(whole, quality.Vectors().vector(text, 5), strict=True))


def test_quality_of_odd_tables(spark):
    rows = [(1, None, None), (2, "", "x"), (3, "&&& ***", "3"), (None, "a text of words", "15"), (1, "ab " * 20_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars string").withColumns({c: F.lit("clash") for c in ("__score", "label", "quality", "__text")})
    labels = spark.createDataFrame([(1, 1), (2, 7), (3, None)], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    kept = quality.quality_filter(docs.drop("n_chars"), labels)
    assert kept.columns == docs.drop("n_chars").columns and kept.count() in (0, 5)
    assert quality.quality(docs.limit(0), labels.limit(0)).count() == 0


def test_marginals_in_parts_and_side_by_side():
    """Both ways of going through texts, and texts in parts with words forgotten in between, give the block-wise marginals; memory stays bounded for many languages."""
    rng = np.random.default_rng(0)
    for k in (3, 20):
        crf = langid.Crf([f"l{i}" for i in range(k)], {})
        crf.weights, crf.moves, crf.starts = rng.normal(0, 0.5, crf.weights.shape).astype(np.float32), rng.normal(0, 1, (k, k)), rng.normal(0, 1, k)
        texts = [[f"w{rng.integers(500)}" for _ in range(n)] for n in (1, 5, 31, 32, 33, 64, 100, 700)]
        plain, small = langid.Labeller(crf), langid.Labeller(crf, most=60_000, cells=40 * k)
        want = np.stack([m.mean(0) for m in plain.marginals([plain.rows(t) for t in texts])])
        beside = np.stack([m.mean(0) for m in plain._side_by_side([plain.rows(t) for t in texts])])
        assert np.allclose(want, beside, atol=1e-12) and np.allclose(want, plain.means(texts), atol=1e-12) and np.allclose(want, small.means(texts), atol=1e-12)
        assert small.held <= 60_000 and len(small.emit) * k * 8 < 200_000
    assert langid.buckets_for(4) == langid.BUCKETS and langid.buckets_for(5000) * 5000 * 4 <= langid.WEIGHTS
    long = "x" * 50_000  # one word as long as a text
    assert np.allclose(langid.Labeller(crf, cells=40 * k).rows([long]), plain.rows([long]))

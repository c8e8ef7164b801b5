"""The operators on small tables: brute force, round trips, held-out accuracy, and nulls, empties, ties, repeated rows, clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserix.llm import bpe, chat, graph, langid, media, mixing, ngram_join, queries, tokenfiles, toxicity, trie, urls, webp

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "Same text here, twice.", "en", "a", 1), (5, "Same text here, twice.", "en", "a", 1), (5, "Same text here, twice.", "en", "a", 1),
    (6, "Same  text\nhere, twice.", "de", "b", 1), (7, "long " * 30000, "en", "b", 1), (8, "<|endoftext|> Ünï ſ İ \x1c \x85 Σς 中文 <|x", "fr", None, 1), (9, "12 345 !!! ---", None, "b", 1), (None, "Same text here, twice.", "en", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in "documents pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def rows_of(df):
    return df.toPandas()


def canonical(df):
    columns = sorted(df.columns)
    return sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(name, spark, sf, duck):
    assert canonical(rows_of(queries.QUERIES[name](spark, sf))) == canonical(duck.sql(queries.ORACLE_SQL[name]).df())


def test_clashing_and_empty(spark, odd, empty):
    """Other columns, whatever their names, neither matter nor get lost; empty tables give empty results."""
    more = odd.withColumns({"topic": F.lit("x"), "weight": F.lit(1), "kept": F.lit(False), "sha": F.lit("y"), "key": F.lit(3), "label": F.lit("z"), "rep": F.lit(1), "tokens": F.lit(2)})
    labels = spark.createDataFrame([(2, 0), (4, 1)], "doc_id long, toxic int")
    assert mixing.mix_filter(more).columns == more.columns == trie.exact_filter(more).columns == ngram_join.ngram_filter(more).columns == toxicity.toxicity_filter(more, labels).columns
    no_labels = labels.filter("false")
    for made in (
        mixing.mix_weights(empty), mixing.mix_filter(empty), trie.exact_groups(empty), ngram_join.ngram_classes(empty), bpe.round_trip_digests(empty, queries.vocabulary()), bpe.encode_documents(empty, queries.vocabulary()),
        tokenfiles.token_files(spark, empty, queries.vocabulary()), media.media_digests(empty), toxicity.toxicity(empty, no_labels), langid.languages(empty), urls.filter_urls(spark.createDataFrame([], "page_id long, url string")),
        chat.chat_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ):
        assert made.count() == 0


def test_mixing(spark, docs, odd):
    w = rows_of(mixing.mix_weights(docs))
    used = w[w.n_tokens > 0]
    total = (used.n_tokens * used.weight).sum()
    by_lang = (used.n_tokens * used.weight).groupby(used.lang).sum() / total
    want = {k: v for k, v in mixing.TARGETS["lang"].items() if k in by_lang}
    for k, v in want.items():
        assert by_lang[k] == pytest.approx(v / sum(want.values()), abs=0.01)
    assert (w.n_tokens * w.keep_prob).sum() == pytest.approx(mixing.KEEP * w.n_tokens.sum(), rel=0.01)
    assert w.keep_prob.between(0, 1).all() and 0 < w.kept.sum() < len(w)
    o = rows_of(mixing.mix_weights(odd))
    assert len(o) == len(ODD) and set(o[o.n_tokens == 0].doc_id) == {1, 2, 3} and o[o.n_tokens == 0].keep_prob.eq(0).all() and o[o.doc_id == 5].kept.nunique() == 1
    assert set(o[o.doc_id == 1].source) == {"(null)"}


def test_encoders_match_library(spark, odd, docs, library, tmp_path):
    random.seed(2)
    signs = list("abzXYZ'sStdDreRE 0129 \t\n\x0b\x1c\x1f\x85\xa0²½ªºµÀÉßàéÿĀİıŁſƀǅɏΣςσЖж中😀\u0301 <|>.,!?_-") + ["<|endoftext|>", "<|startoftext|>", "'ll", " don't "]
    own, fast = bpe.bpe(queries.vocabulary()), tokenfiles.encoder(queries.vocabulary())
    for i in range(3000):
        t = "".join(random.choice(signs) for _ in range(random.randint(0, 40)))
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == want and np.frombuffer(fast.encode(t.encode()), fast.dtype).tolist() == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)
    for t in ("a" * 700, "ab" * 900, "thing" * 60):
        assert own.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
    for df in (odd, docs):
        made = rows_of(bpe.round_trip_digests(df, queries.vocabulary()))
        texts = [r["text"] or "" for r in df.collect()]
        want = Counter()
        for t in texts:
            ids = library.encode(t, add_special_tokens=False).ids
            want[(len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
        assert Counter(zip(made.n_tokens, made.ids_sha256, made.decoded_sha256, strict=True)) == want
    back = bpe.decode_documents(bpe.encode_documents(docs, queries.vocabulary()), queries.vocabulary())
    assert back.count() == docs.count()


def test_token_files(spark, odd, docs, library, tmp_path):
    for k, df in enumerate((odd, docs)):
        got = rows_of(tokenfiles.token_files(spark, df, queries.vocabulary(), str(tmp_path / str(k)))).sort_values("start")
        base, want = 0, []
        for r in sorted(df.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")):
            ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
            want.append((r["doc_id"], base, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            base += len(ids)
        have = [(None if d != d or d is None else int(d), int(s), int(n), int(c)) for d, s, n, c in zip(got.doc_id, got.start, got.n_tokens, got.ids_crc32, strict=True)]
        assert have == want


def test_urls(spark, sf, duck):
    pages = spark.createDataFrame(
        [(1, None), (2, "no scheme"), (3, "HTTP://A.Example.NET/en/x?y=1#z"), (4, "http://net"), (5, "http://x.net/"), (6, "http://notnet/"), (7, "http://example.com/de/"), (8, "http://a.org/fr/1"), (9, "http://spam-farm.example.org/en/1"), (9, "http://spam-farm.example.org/en/1"), (10, "x://y://net/")],
        "page_id long, url string",
    )
    got = {r["page_id"]: r for r in urls.filter_urls(pages).collect()}
    assert [(got[i]["host"], got[i]["path"]) for i in (1, 2, 3, 4)] == [("", ""), ("", ""), ("a.example.net", "/en/x"), ("net", "")]
    assert [got[i]["rule"] for i in range(1, 11)] == [None, None, "example.net/en/", None, "net/", None, "example.com/de/", "org/fr/", None, None]
    assert [got[i]["verdict"] for i in (3, 5, 7, 8)] == ["allow", "block", "block", "allow"]
    full = rows_of(urls.filter_urls(spark.read.parquet(f"{sf}/pages.parquet")))
    assert len(full) == duck.sql("SELECT count(*) FROM pages").fetchall()[0][0] and full.score.between(0, 1).all()
    plain = spark.createDataFrame([(1, "abca"), (2, "aa"), (3, "")], "page_id long, url string")
    e = [r["e"] for r in plain.select(urls.entropy(F.col("url")).alias("e")).collect()]
    assert e == pytest.approx([1.5, 0, 0])


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """doc -> (class, links, rep), by comparing all pairs of different sets."""
    sets = defaultdict(list)
    for i, t in rows:
        if shingles(t):
            sets[shingles(t)].append(i)
    reps = {s: min(v) for s, v in sets.items()}
    links, root = Counter(), {r: r for r in reps.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = list(reps.items())
    for k, (s, a) in enumerate(every):
        for t, b in every[:k]:
            n = len(s & t)
            if n / (len(s) + len(t) - n) >= 0.8:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(reps[s]), links[reps[s]], reps[s]) for s, v in sets.items() for i in v}


def near_family(n, seed, words=60):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_ngram_join(spark, docs, odd, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 20)  # several blocks and deep paths on few rows
    monkeypatch.setattr(ngram_join, "SMALL", 10)
    texts = near_family(70, 1) + near_family(30, 2) + near_family(25, 3, 8) + ["one two", "one two", "one", None, "", "!!"]
    rows = list(enumerate(texts))
    want = brute(rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["rep_id"]) for r in ngram_join.ngram_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    assert {i: got[i] for i in want} == want
    assert all(got[i] == (i, 0, i) for i in got if i not in want)
    own = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["rep_id"]) for r in ngram_join.ngram_classes(docs).collect()}
    want = brute(own)
    assert {i: got[i] for i in want} == want
    assert ngram_join.ngram_classes(odd).count() == len(ODD)
    assert ngram_join.runs_needed(0.9999, 0.8) >= ngram_join.runs_needed(0.9, 0.8)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 180)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_toxicity_learns_and_generalises():
    rng = random.Random(6)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    bad = ["grumblix", "snarfgul", "vrontch"]
    spell = lambda w: w[:-1] + rng.choice("xyzw") + w[-1]

    def text(toxic, odd=False):
        w = [word() for _ in range(rng.randint(20, 200))]
        if toxic:
            for _ in range(2):
                b = rng.choice(bad)
                w[rng.randrange(len(w))] = spell(b) if odd else b
        return " ".join(w)

    model = toxicity.train([(text(y), y) for y in [0, 1] * 150])
    held = [(text(y), y) for y in [0, 1] * 60]
    assert np.mean([(model.score(t) >= 0.5) == y for t, y in held]) > 0.93
    assert np.mean([model.score(text(1, True)) >= 0.5 for _ in range(40)]) > 0.6
    for t in ("", "   ", "!!!", "a" * 5000):
        assert 0 <= model.score(t) <= 1
    one = toxicity.train([("a b", 0)] * 5)
    assert one.score("grumblix") < 0.5


def test_toxicity_query(spark, sf, odd, duck):
    got = rows_of(queries.op5_toxicity(spark, sf))
    assert len(got) == duck.sql("SELECT count(*) FROM documents").fetchall()[0][0] and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out, strict=True))
    labels = spark.createDataFrame([(2, 0), (4, 1), (4, None), (None, 1), (7, 5)], "doc_id long, toxic int")
    made = rows_of(toxicity.toxicity(odd, labels))
    assert len(made) == len(ODD) and made[made.doc_id == 5].score.nunique() == 1


def test_language(spark, sf, odd, duck):
    sample = [("le chat mange la souris dans la maison " * 5, "fr"), ("the cat eats the mouse within the house " * 5, "en"), ("die katze frisst eine maus im haus und hof " * 5, "de")] * 12
    labeller = langid.Labeller(langid.train(sample))
    assert [x[0] for x in labeller.documents(["the house", "la maison", "die katze", None, "", "123 !"])] == ["en", "fr", "de", "und", "und", "und"]
    mixed = labeller.label_words("the cat eats the mouse within the house le chat mange la souris dans la maison")
    assert [y for _, y in mixed[:6]] == ["en"] * 6 and [y for _, y in mixed[-6:]] == ["fr"] * 6
    got = rows_of(queries.op10_language_id(spark, sf)).merge(duck.sql("SELECT doc_id, lang FROM documents").df(), on="doc_id")
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()
    made = rows_of(langid.languages(odd))
    assert len(made) == len(ODD) and set(made[made.doc_id.isin([1, 2, 3, 9])].lang_pred) == {"und"}
    nothing = rows_of(langid.languages(odd.withColumn("lang", F.lit(None).cast("string"))))
    assert set(nothing.lang_pred) == {"und"}


def test_marginals_by_brute_force():
    rng = np.random.default_rng(1)
    crf = langid.Crf(["a", "b", "c"], {})
    crf.moves, crf.starts = rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3)
    labeller = langid.Labeller(crf)
    for sizes in ([1], [5, 70, 32, 33], [200, 1, 64]):
        emits = [np.exp(rng.normal(0, 2, (n, 3))) for n in sizes]
        for e, got in zip(emits, labeller.marginals(emits), strict=True):
            p, _, _ = langid.chain_marginals(e[:, None, :].copy(), labeller.move, labeller.start[None, :])
            p = p[:, 0] / p[:, 0].sum(1, keepdims=True)
            assert np.allclose(got, p, atol=1e-9)
    # against the sum over all label sequences
    for n in (1, 2, 5):
        e, want = np.exp(rng.normal(0, 2, (n, 3))), np.zeros((n, 3))
        for labels in itertools.product(range(3), repeat=n):
            weight = labeller.start[labels[0]] * np.prod([e[t, y] for t, y in enumerate(labels)]) * np.prod([labeller.move[a, b] for a, b in itertools.pairwise(labels)])
            want[np.arange(n), labels] += weight
        assert np.allclose(labeller.marginals([e])[0], want / want.sum(1, keepdims=True), atol=1e-9)


def test_trie(tmp_path):
    rng = random.Random(3)
    keys = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) * rng.choice([1, 1, 30]) for _ in range(3000)]
    want = defaultdict(lambda: [None, 0])
    for i, k in enumerate(keys):
        want[k][0] = i if want[k][0] is None else want[k][0]
        want[k][1] += 1
    for most in (1 << 60, 60_000, 5_000):
        t = trie.PatriciaTrie(most, str(tmp_path))
        for i, k in reversed(list(enumerate(keys))):
            t.insert(k, i, 1)
        assert bool(t.spilled) == (most < 1 << 60)
        got = {k: [least, n] for k, least, n in t.items()}
        assert got == dict(want)
    assert not list(tmp_path.iterdir())


def test_exact_groups(spark, odd):
    got = {}
    for r in trie.exact_groups(odd).collect():
        got.setdefault(r["doc_id"], r)
    assert got[1]["keep_id"] == got[2]["keep_id"] == 1 and got[3]["keep_id"] == 3
    same = got[4]
    assert same["keep_id"] == 4 and same["group_size"] == 5 and same["kept"] and not got[6]["kept"] and not got[None]["kept"]
    assert got[6]["text_sha256"] == hashlib.sha256(b"Same text here, twice.").hexdigest()
    small = {(r["doc_id"], r["keep_id"]) for r in trie.exact_groups(odd, 3000).collect()}
    assert small == {(r["doc_id"], r["keep_id"]) for r in trie.exact_groups(odd).collect()}
    assert {r["doc_id"] for r in trie.exact_filter(odd).collect()} == {1, 3, 4, 7, 8, 9}
    for raw in (" a  b\x0b\x0c\r\n", "\t", "", "a\x1cb\x85c\xa0 d"):
        assert trie.normalised(raw) == re.sub(r"[\x20\x09-\x0d]+", " ", raw).encode()


OPTIONS = [{}, {"predictor": -1}, {"predictor": 11}, {"cross": (5, -7, 30)}, {"subtract_green": True}, {"cache_bits": 4}, {"links": True}, {"tile_bits": 2, "links": True, "cache_bits": 3}, {"predictor": -1, "cross": (-100, 90, 3), "subtract_green": True, "links": True, "cache_bits": 6}, {"palette": True}, {"palette": True, "predictor": -1, "links": True}]


@pytest.mark.parametrize("options", OPTIONS, ids=str)
def test_webp_round_trip(options):
    rng = np.random.default_rng(7)
    for k in range(12):
        h, w = rng.integers(1, 23, 2)
        image = rng.integers(0, [256, 3, 2][k % 3], (h, w, 4)).astype(np.uint8)
        if options.get("palette") and len(np.unique(image.reshape(-1, 4), axis=0)) > 256:
            continue
        assert np.array_equal(webp.decode(webp.encode(image, **options)), image)


def test_webp_details(monkeypatch):
    assert webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and len(webp.NEAR) == 120
    with pytest.raises(ValueError):
        webp.decode(b"RIFF....WEBPVP8 " + bytes(20))
    whole = webp.encode(np.random.default_rng(1).integers(0, 256, (9, 9, 4)).astype(np.uint8))
    with pytest.raises(ValueError):
        webp.decode(whole[:20] + whole[20:60])
    rng = np.random.default_rng(5)
    for n in (64, 640, (1 << 20) + 64):
        for levels in (1, 2, 3, 16, 17, 200, 256):
            p = rng.integers(0, levels, n).astype(np.uint8).tobytes()
            m = webp.store_bytes(p)
            assert webp.unpack_bytes(m).tobytes() == p
            # reading token by token gives the same pixels as parsing by arrays
            if n == 640:
                monkeypatch.setattr(webp, "SMALL_IMAGE", 1 << 30)
                assert webp.unpack_bytes(m).tobytes() == p
                monkeypatch.undo()
    assert len(list(webp.images(webp.store_bytes(bytes((1 << 20) + 64))))) == 2


def stream(bits: str) -> bytes:
    """A lossless WebP from its bits in the order of the stream; blanks are for the reader."""
    bits = bits.replace(" ", "").replace("\n", "")
    bits += "0" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    return b"RIFF" + (12 + len(data) + len(data) % 2).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + bytes(len(data) % 2)


def number(value: int, n: int) -> str:
    """A number of n bits as the stream has it, least bit first."""
    return format(value, f"0{n}b")[::-1]


def test_webp_fixtures():
    """Files written bit by bit from the format's specification, without the encoder."""
    head = lambda w, h: number(0x2F, 8) + number(w - 1, 14) + number(h - 1, 14) + "1" + "000"
    lone = lambda s: "1" + "0" + ("0" + number(s, 1) if s < 2 else "1" + number(s, 8))
    two = lambda a, b: "1" + "1" + "1" + number(a, 8) + number(b, 8)
    # 3 x 1, no transform, no cache, no groups; green 10 or 200, red 7, blue 9, alpha 255 or 128; pixels: (10, 255) (200, 128) (10, 128)
    plain = head(3, 1) + "0" + "0" + "0" + two(10, 200) + lone(7) + lone(9) + two(128, 255) + lone(0) + "0" + "1" + "1" + "0" + "0" + "0"
    assert webp.decode(stream(plain)).tolist() == [[[7, 10, 9, 255], [7, 200, 9, 128], [7, 10, 9, 128]]]
    # subtract-green: 250 + 10 wraps to 4
    green = head(1, 1) + "1" + number(2, 2) + "0" + "0" + "0" + lone(10) + lone(250) + lone(1) + lone(255) + lone(0)
    assert webp.decode(stream(green)).tolist() == [[[4, 10, 11, 255]]]
    # 8 x 1: green code over 280 symbols with lengths 1 for 65 and 2 for 66 and 260 (a run); distances: code 2, the pixel to the left
    # code lengths: 0 -> 18 (run), 1, 2; in the order 17 18 0 1 2: lengths of 18, 1, 2 are 1, 2, 2
    normal = "0" + number(1, 4) + number(0, 3) + number(1, 3) + number(0, 3) + number(2, 3) + number(2, 3) + "0"
    skip = lambda n: "0" + number(n - 11, 7)  # noqa: E731  (18: 11 to 138 zeros; its code is 0)
    one, pair = "10", "11"
    lengths = skip(65) + one + pair + skip(138) + skip(55) + pair + skip(19)
    # canonical: 65 -> 0, 66 -> 10, 260 -> 11; 260 is prefix 4: 5 or 6 by one extra bit
    tokens = "0" + "10" + "11" + number(1, 1)
    links = head(8, 1) + "0" + "0" + "0" + normal + lengths + lone(0) + lone(0) + lone(255) + lone(1) + tokens
    assert webp.decode(stream(links))[0, :, 1].tolist() == [65, 66, 66, 66, 66, 66, 66, 66]
    # a cache of 2 bits: 280 + slot of the pixel just seen; symbols 65 (length 1) and 280 + slot (length 1); five lengths are given, the rest are 0
    argb = 0xFF << 24 | 65 << 8
    slot = (argb * 0x1E35A7BD & 0xFFFFFFFF) >> 30
    far = lambda n: "1" + number(n - 11, 7)  # noqa: E731  (here 1 has the code 0 and 18 the code 1)
    short = "0" + number(1, 4) + number(0, 3) + number(1, 3) + number(0, 3) + number(1, 3) + number(0, 3) + "1" + number(1, 3) + number(5 - 2, 4)
    cached = head(3, 1) + "0" + "1" + number(2, 4) + "0" + short + far(65) + "0" + far(138) + far(76 + slot) + "0" + lone(0) + lone(0) + lone(255) + lone(0) + "0" + "1" + "1"
    assert webp.decode(stream(cached))[0].tolist() == [[0, 65, 0, 255]] * 3
    # a palette of two colours, eight pixels in a byte: differences 20 and 30 in green; indices 1 0 1 1 0 0 0 1
    palette = head(8, 1) + "1" + number(3, 2) + number(1, 8) + "0" + two(20, 30) + lone(0) + lone(0) + two(0, 255) + lone(0) + "0" + "1" + "1" + "0"
    palette += "0" + "0" + "0" + lone(0b10001101) + lone(0) + lone(0) + lone(255) + lone(0)
    assert webp.decode(stream(palette))[0, :, 1].tolist() == [50, 20, 50, 50, 20, 20, 20, 50]
    # predictor 2 (up) for one tile; residuals 5 for all: first row adds up from the left, the others from above
    up = head(2, 2) + "1" + number(0, 2) + number(0, 3) + "0" + lone(2) + lone(0) + lone(0) + lone(255) + lone(0)
    up += "0" + "0" + "0" + lone(5) + lone(0) + lone(0) + lone(0) + lone(0)
    assert webp.decode(stream(up))[:, :, 1].tolist() == [[5, 10], [10, 15]] and (webp.decode(stream(up))[:, :, 3] == 255).all()
    # the same file inside an extended container
    data = stream(plain)
    extended = b"RIFF" + (len(data) + 10).to_bytes(4, "little") + b"WEBPVP8X" + (10).to_bytes(4, "little") + bytes(10) + data[12:]
    assert np.array_equal(webp.decode(extended), webp.decode(data))


def test_media_sizes_are_near_deflate(docs):
    texts = [(r["text"] or "").encode() for r in docs.collect()]
    texts += [b"The same line again and again.\n" * 200, b"abc " * 5000, "\n".join(f"row {i} of a table" for i in range(2000)).encode()]
    payloads = [t + bytes(-len(t) % 64) for t in texts if t]
    ours, theirs = [len(webp.store_bytes(p)) for p in payloads], [len(zlib.compress(p)) for p in payloads]
    assert sum(ours) < 1.15 * sum(theirs) and all(a < 1.35 * b + 200 for a, b in zip(ours, theirs, strict=True))


def test_media(spark, odd, docs):
    for df in (odd, docs):
        want = Counter()
        for r in df.collect():
            raw = (r["text"] or "").encode()
            p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            want[(len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
        got = rows_of(media.media_digests(df))
        assert Counter(zip(got.n_bytes, got.payload_bytes, got.payload_sha256, got.tail_crc32, strict=True)) == want
        assert got.groupby("payload_sha256")[["media_sha256", "feature"]].nunique().max().max() == 1
    p = media.pixel_arrays(media.encode_media(odd.filter("doc_id = 4"))).first()
    assert bytes(p["pixels"])[1::4].rstrip(b"\0") == b"Same text here, twice." and p["width"] == 64


def test_chat(spark):
    turns = [(1, 0, "system", "be <|im_end|> &amp; kind"), (1, 1, "user", None), (1, 2, "user", "again"), (1, 3, "assistant", "x\ny"), (1, 4, "assistant", "<|im_sep|>&lt;|"), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (3, None, None, "t"), (None, 0, "a\nb<|", "q")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat.read_back(chat.format_chats(df))
    got = {r["conv_id"]: r for r in out.collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("system", "be <|im_end|> &amp; kind"), ("user", ""), ("user", "again"), ("assistant", "x\ny"), ("assistant", "<|im_sep|>&lt;|")]
    assert got[1]["loss_text"] == "x\ny<|im_sep|>&lt;|" and got[1]["formatted"].count("<|im_start|>") == 3
    assert [tuple(t) for t in got[2]["turns"]] == [("assistant", "")] * 2 and [tuple(t) for t in got[3]["turns"]] == [("", "t")] and [tuple(t) for t in got[None]["turns"]] == [("a\nb<|", "q")]
    case = {r["conv_id"]: r for r in chat.chat_digests(chat.with_control_case(df.drop("formatted"))).collect()}[-1]
    text = "<|im_end|><|im_start|>assistant ok"
    assert case["n_turns"] == 2 and case["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and case["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_native_plans(spark, sf):
    """The native operators run no Python."""
    for f in (queries.op1_mix_sources, queries.op3_url_filter, queries.op9_chat_format):
        plan = f(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline(spark, sf):
    """Each stage's rows by its own rule, brute force where there is one."""
    import corpus_pipeline as c
    from tesserix.runtime import saved

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(c.STAGES):
        before = docs
        docs = saved(stage(spark, docs, sf), f"t{k}")
        if k < len(c.STAGES) - 1:
            assert docs.columns == columns
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if k == 1:
            first = {}
            for r in before.orderBy("doc_id").collect():
                first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", r["text"] or ""), r["doc_id"])
            assert kept[1] == set(first.values())
        if k == 2:
            want = brute([(r["doc_id"], r["text"]) for r in before.collect()])
            assert kept[2] == {i for i in kept[1] if i not in want or want[i][0] == i}
        if k == 3:
            assert kept[3] == {r["doc_id"] for r in mixing.mix_weights(before).filter("kept").collect()}
    assert kept[4] == kept[3] and all(a >= b for a, b in zip(kept, kept[1:], strict=False))
    assert {r["doc_id"] for r in c.run(spark, sf).collect()} == kept[4]


def test_media_use_the_format(spark, docs, monkeypatch):
    """Stored images have back-references and codes of several lengths, and are read by the loop; transforms and cache are taken where they pay."""
    text = " ".join(r["text"] or "" for r in docs.select("text").limit(5).collect()).encode()
    payload = text + bytes(-len(text) % 64)
    told, read, sizes = {}, webp._parsed, []
    monkeypatch.setattr(webp, "_parsed", lambda bits, group, *a: sizes.append(len(set(group[0].sizes.tolist()))) or read(bits, group, *a))
    assert webp.unpack_bytes(webp.store_bytes(payload), told).tobytes() == payload and max(sizes) > 3 and told["links"] > 50 and told["literals"] > 50
    stored = [bytes(r["media"]) for r in media.encode_media(docs.limit(20)).collect()]
    assert stored == [webp.store_bytes(media.payload_of(r["text"])[1]) for r in docs.limit(20).collect()]
    rng = np.random.default_rng(3)
    y, x = np.mgrid[:40, :64]
    noise = rng.integers(0, 2, (40, 64))
    assert webp.unpack_bytes(webp.store_bytes(b"abcabcab" * (1 << 17) + bytes(64))).tobytes() == b"abcabcab" * (1 << 17) + bytes(64)
    for n in (64, 128, 6400):
        for p in (bytes(n), rng.integers(0, 256, n).astype(np.uint8).tobytes(), (np.arange(n) * 3 // 64 % 256).astype(np.uint8).tobytes(), (b"abcabcabd" * n)[:n]):
            assert webp.unpack_bytes(webp.store_bytes(p)).tobytes() == p
    smooth = np.stack([(x * 3 + y * 2 + noise) % 256, (x + y * 3 + noise) % 256, x * 0, x * 0 + 255], 2).astype(np.uint8)
    tied = rng.integers(0, 256, (40, 64, 4)).astype(np.uint8)
    tied[:, :, 0] = (tied[:, :, 1].astype(np.int8) >> 1).astype(np.uint8)
    tied[:, :, 3] = 255
    assert webp.chosen(smooth)["predictor"] is not None and webp.chosen(tied)["cross"] is not None
    for image in (smooth, tied):
        m = webp.encode(image, **webp.chosen(image), links=True, cache_bits=None, size_bits=webp.WIDEST)
        assert np.array_equal(webp.decode(m), image) and len(m) < len(webp.encode(image))
    for mode in range(14):
        image = rng.integers(0, 256, (9, 13, 4)).astype(np.uint8)
        assert np.array_equal(webp.decode(webp.encode(image, predictor=mode, size_bits=webp.WIDEST)), image)
    few = rng.integers(0, 256, (300, 4)).astype(np.uint8)[np.repeat(rng.integers(0, 300, 600), 4)[rng.permutation(2400) // 8 * 8 % 2400]].reshape(-1, 32, 4)
    assert np.array_equal(webp.decode(webp.encode(few, cache_bits=None)), few) and len(webp.encode(few, cache_bits=None)) < len(webp.encode(few))


def test_filters_go_by_row(spark):
    """A copy doesn't take along other texts of rows with the same doc_id, or with none."""
    texts = near_family(3, 4)
    rows = [(1, "same  text"), (None, "same text"), (None, "the only one"), (2, "same text"), (2, "another"), (3, "third")]
    kept = trie.exact_filter(spark.createDataFrame(rows, "doc_id long, text string").withColumn("more", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "more"] and sorted(r["text"] for r in kept.collect()) == ["another", "same  text", "the only one", "third"]
    rows = [(1, texts[0]), (2, texts[0] + " w"), (2, "some other words that nobody else has"), (3, "one two three four five six"), (None, "x y")]
    kept = ngram_join.ngram_filter(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(1, texts[0]), (2, rows[2][1]), (3, rows[3][1]), (0, "x y")])


def test_urls_count_suffixes_over_all(spark, monkeypatch):
    """Suffix statistics cover all labelled URLs, however small the sample that the trees are fitted on."""
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), F.when(F.col("id") % 3 == 0, "ads-track").otherwise("fine"), F.lit(".s"), (F.col("id") % 300).cast("string"), F.lit(".org/"), F.col("id").cast("string")).alias("url"))
    seen, made = [], urls.VectorAssembler

    class Watched(made):
        def transform(self, data):
            seen.append(data)
            return super().transform(data)

    monkeypatch.setattr(urls, "VectorAssembler", Watched)
    assert urls.filter_urls(pages, most=200).count() == 3000
    fitted, scored = seen
    assert fitted.count() < 600
    fold = F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(urls.FOLDS))
    all_urls = [(r["s"], r["fold"]) for r in urls.lexical(pages).select(F.col("suffix").alias("s"), fold.alias("fold")).collect()]
    per, per_fold = Counter(s for s, _ in all_urls), Counter(all_urls)
    for data in (fitted, scored):
        got = data.select("suffix", fold.alias("fold"), "suffix_log_n").distinct().collect()
        assert got and all(r["suffix_log_n"] == pytest.approx(np.log1p(per[r["suffix"]] - per_fold[r["suffix"], r["fold"]])) for r in got)


def test_long_words_are_read_to_their_end():
    """A term after the 40th letter of a word counts, and so do the letters that tell a language."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(3))
    text = lambda y: " ".join([word() for _ in range(20)] + ["grumblix"] * y + [word() for _ in range(20)])
    model = toxicity.train([(text(y), y) for y in [0, 1] * 150])
    clean, bad = "_".join(word() for _ in range(30)), "_".join([*(word() for _ in range(15)), "grumblix", *(word() for _ in range(14))])
    for sign in ("_", ""):
        assert model.score(clean.replace("_", sign)) < 0.5 <= model.score(bad.replace("_", sign))
    for n in (41, 59, 60, 61, 80, 81, 5000):
        long = "".join(chr(0x4E00 + i) for i in range(n))
        parts = toxicity.pieces(long)
        assert max(map(len, parts)) <= toxicity.LONG and all(any(long[i : i + 5] in p for p in parts) for i in range(min(n - 4, 300))) and parts[-1][-1] == long[-1]
    one, other = (langid.features("a" * 60 + end, {}) for end in ("xyz", "uvw"))
    assert len(np.setdiff1d(one, other)) > 5


def test_runs_bound_the_deepest_pairs(spark, monkeypatch):
    """The number of runs is that for pairs which are split as often as nodes can be."""
    asked, needed = [], ngram_join.runs_needed

    def watched(recall, threshold, depth=2):
        asked.append(depth)
        return min(2, needed(recall, threshold, depth))

    monkeypatch.setattr(ngram_join, "runs_needed", watched)
    rows = list(enumerate(near_family(5, 6)))
    assert ngram_join.ngram_classes(spark.createDataFrame(rows, "doc_id long, text string")).count() == 5
    assert asked == [ngram_join.DEPTH]

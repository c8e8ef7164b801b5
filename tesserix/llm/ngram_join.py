"""Operator 4: n-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles (lower-case words; fewer than five words: one shingle of all; none: no set).
1. Documents with equal sets fall together; the one with the smallest doc_id stands for them.
2. Each set is embedded as SKETCH min-hash tokens. In every run a node of the recursion samples coordinates by its path (1/threshold on
   average), and a set goes to one child per sampled coordinate, named by its token there: sets share a child where they
   share the sampled token. Children of one set are dropped, children up to SMALL are compared by brute force on sketches, larger ones
   recurse. Runs are repeated until the bound on a missed pair is below 1 - RECALL, for pairs that are split DEPTH times. Nodes that are still large at
   DEPTH are linked whole, which can only add candidates.
3. Candidate links form groups. A group of up to BLOCK sets is compared whole. A larger one is parted into classes of sizes (sets of two classes that
   aren't neighbours can't reach the threshold), classes into blocks of about BLOCK sets, and each pair of blocks that can hold a link is a unit
   of its own, which compares sketches first and then, exactly, the pairs whose sketches agree. A unit emits, per set, its number of links and one
   spanning edge. So unrelated families that a chain of loose candidates has put into one group cost a comparison of sketches, not of sets.
Result: one row per document: rep_id (who stands for its set), class_id (smallest doc_id of the documents linked directly or by
others), n_links (different sets at the threshold or above).

Null texts and texts without words have no set: they are their own rep and class without links. Where rows share a doc_id or have none, each pair of
doc_id and text is a document of its own, numbered in the order of doc_id (nulls last): it has its own links, and classes and reps are told by the doc_id
of their first number (null only if all in it have none). An empty table gives an empty result; other columns are ignored. Intermediate tables are deleted; the
result is one table in the shared folder.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserix.llm.graph import components
from tesserix.llm.words import WORD, Memo, mix64, opened
from tesserix.runtime import BROADCAST_ROWS, checked_side, forget, forget_folder, free_name, fresh, saved, shared_ids

N, THRESHOLD = 5, 0.8
SKETCH, RECALL, DEPTH, SMALL, BLOCK = 64, 0.9999, 5, 128, 512
#: Bytes of shingle hashes that a block holds on average.
BLOCK_BYTES = 16 << 20
#: Prints with as many rows, and at least a thousandth of all, are joined where their rows lie.
HOT_ROWS = 1000
#: A pair at the threshold agrees in fewer sketch coordinates than this with a chance of about 2 in 100,000; with the runs' 7 in 100,000 the loss stays below 1 - RECALL.
LOOSE = THRESHOLD - 4.5 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / SKETCH)


def runs_needed(recall: float, threshold: float, depth: int = 2) -> int:
    """Runs after which a pair at the threshold is missed with a chance of at most 1 - recall, if it takes `depth` splits to end in a small node.

    A node samples one coordinate, or two so often that 1/threshold are sampled on average."""
    extra, live = 1 / threshold - 1, 1.0
    for _ in range(depth):
        q = threshold * live  # one coordinate leads to a shared child that ends together
        live = (1 - extra) * q + extra * (1 - (1 - q) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - live))


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, n: int = N):
        self.n = n
        self.word = Memo(lambda w: int.from_bytes(hashlib.blake2b(w.encode("utf-8"), digest_size=8).digest(), "little"), 40 << 20)
        self.scale = mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        if not words:
            return np.empty(0, np.uint64)
        memo = self.word
        h = np.array([memo[w] for w in words], np.uint64)
        size = min(self.n, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - size + 1, size, np.uint64)
            for k in range(size):
                out = mix64(out + h[k : len(h) - size + 1 + k] * self.scale[k])
        return np.unique(out)


def hash_rows() -> tuple[np.ndarray, np.ndarray]:
    """Factors and terms of the SKETCH hash functions."""
    return mix64(np.arange(1000, 1000 + SKETCH, dtype=np.uint64)) | np.uint64(1), mix64(np.arange(5000, 5000 + SKETCH, dtype=np.uint64))


def sketch(shingles: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Min-hash tokens as int32; shingles in slices, so that long texts need no more memory."""
    best = np.full(len(scale), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 2048):
            best = np.minimum(best, (shingles[i : i + 2048, None] * scale + shift).min(0))
    return (mix64(best) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def sketches(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, size (number of shingles), print (16 bytes that name the set), tokens (SKETCH integers; null without a set)."""

    def run(batches):
        shingler = Shingler(n)
        scale, shift = hash_rows()
        for b in batches:
            sizes, prints, tokens = [], [], []
            for text in b.column(1):
                s = shingler(text.as_py())
                sizes.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                tokens.append(sketch(s, scale, shift) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(tokens, pa.list_(pa.int32()))], ["doc_id", "size", "print", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, size long, print binary, tokens array<int>")


def _children(nodes: DataFrame, threshold: float) -> DataFrame:
    """nodes (rep, path, tokens) to their children: a node samples one coordinate or two by its path's hash."""
    extra = int(round((1 / threshold - 1) * 1_000_000))
    first = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(SKETCH)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("path", F.lit(2)), F.lit(SKETCH - 1)).cast("int"), F.lit(SKETCH)).cast("int")
    sampled = F.when(F.pmod(F.xxhash64("path", F.lit(3)), F.lit(1_000_000)) < extra, F.array(first, second)).otherwise(F.array(first))
    return nodes.select("rep", "path", "tokens", F.explode(sampled).alias("at")).select("rep", F.xxhash64("path", "at", F.get("tokens", F.col("at"))).alias("path"))


def _close(batches):
    """Rows (path, rep, tokens), a node's rows together: brute force on sketches; one spanning edge per linked set."""
    held: list = []

    def edges(path_rows):
        reps = np.array([r for r, _ in path_rows], np.int64)
        t = np.stack([x for _, x in path_rows])
        root = np.arange(len(reps))
        for i in range(1, len(reps)):
            close = np.flatnonzero((t[:i] == t[i]).mean(1) >= LOOSE)
            if len(close):
                roots = np.unique(np.append(root[close], root[i]))
                root[np.isin(root, roots)] = roots[0]
        return [(int(reps[i]), int(reps[root[i]])) for i in range(len(reps)) if root[i] != i]

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    now, out = None, []
    for b in batches:
        flat = b.column(2).values.to_numpy(zero_copy_only=False)
        starts = b.column(2).offsets.to_numpy()
        for k, (path, rep) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            if path != now:
                out += edges(held) if len(held) > 1 else []
                now, held = path, []
            held.append((rep, flat[starts[k] : starts[k + 1]].copy()))
        if len(out) > 5000:
            yield made(out)
            out = []
    out += edges(held) if len(held) > 1 else []
    if out:
        yield made(out)


def candidates(sets: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """sets (rep, tokens) to candidate links (a, b), in a table of the shared folder: all runs at once, level by level."""
    runs, tables, spent = runs_needed(recall, threshold, DEPTH), [], []
    rows = int(sets.count() * runs / threshold)  # one coordinate is sampled, or two so often that 1/threshold are on average
    nodes = sets.select("rep", "tokens", F.explode(F.array(*[F.xxhash64(F.lit(f"run {r}")) for r in range(runs)])).alias("path"))
    for level in range(1, DEPTH + 1):
        children = saved(_children(nodes, threshold), f"paths-{level}", rows)
        counts = saved(children.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("least")).filter("n > 1"), f"path-sizes-{level}", rows)
        is_small = F.col("n") <= SMALL
        told = counts.agg(F.count(F.lit(1)).alias("paths"), F.sum(F.when(is_small, 0).otherwise(F.col("n"))).alias("large")).first()
        # sizes are two numbers a path: sent to the children while they are few enough, else joined by a shuffle
        few = counts.filter(is_small).select("path")
        few = F.broadcast(few) if told["paths"] <= BROADCAST_ROWS else few
        small = children.join(few, "path").join(sets, "rep").select("path", "rep", "tokens")
        tables.append(saved(small.repartition("path").sortWithinPartitions("path").mapInArrow(_close, "a long, b long"), f"path-links-{level}"))
        spent += [children, counts]
        large = counts.filter(~is_small)
        if level == DEPTH:
            tables.append(saved(children.join(large, "path").select(F.col("rep").alias("a"), F.col("least").alias("b")), "path-whole"))
        if level == DEPTH or not told["large"]:
            break
        rows = int(told["large"] / threshold)  # the rows that are split again, as counted
        nodes = children.join(large.select("path"), "path").join(sets, "rep").select("rep", "tokens", "path")
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    out = saved(out.filter("a <> b").distinct(), "ngram-candidates")
    for t in [*spent, *tables]:
        forget(sets.sparkSession, t)
    return out


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: products of 0/1 matrices over slices of the tokens they share."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)

    def coded(sets, flat):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(shared, flat)
        ok = at < len(shared)
        ok[ok] = shared[at[ok]] == flat[ok]
        return row[ok], at[ok]

    (row_a, col_a), (row_b, col_b) = coded(a, flat_a), coded(b, flat_b)
    for lo in range(0, len(shared), 4096):
        wide = min(4096, len(shared) - lo)
        m = []
        for row, col, n in ((row_a, col_a, len(a)), (row_b, col_b, len(b))):
            some = (col >= lo) & (col < lo + wide)
            x = np.zeros((n, wide), np.float32)
            x[row[some], col[some] - lo] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of two lists of sketches agree in LOOSE of their coordinates."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for k in range(a.shape[1]):
        out += a[:, None, k] == b[None, :, k]
    return out >= LOOSE * a.shape[1]


def verify_unit(rows: list[tuple[int, int, np.ndarray]], same: bool, threshold: float, sketched: bool = False) -> list[tuple[int, int, int]]:
    """rows (rep, side, shingles) of a unit; same: one block against itself; sketched: only pairs with agreeing sketches are compared.
    Per set: (rep, links, smallest linked or itself)."""
    left = [r for r in rows if r[1] == 0]
    right = left if same else [r for r in rows if r[1] == 1]
    links = {r[0]: 0 for r in rows}
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ids = np.array([r[0] for r in right], np.int64)
    sizes = np.array([len(r[2]) for r in right], np.float64)
    scale, shift = hash_rows()
    tokens = np.stack([sketch(r[2], scale, shift) for r in right]) if sketched and right else None
    for i in range(0, len(left), 128):  # memory: 128 x (other side) numbers
        some = left[i : i + 128]
        if not len(right):
            break
        own = np.array([len(r[2]) for r in some], np.float64)
        near = np.zeros((len(some), len(right)), bool)
        used = np.arange(len(right))
        if sketched:
            agree = _agreeing(tokens[i : i + 128] if same else np.stack([sketch(r[2], scale, shift) for r in some]), tokens)
            used = np.flatnonzero(agree.any(0))
        if len(used):
            shared = _overlaps([r[2] for r in some], [right[k][2] for k in used]).astype(np.float64)
            near[:, used] = shared >= threshold * (own[:, None] + sizes[None, used] - shared) - 1e-9
        for k, r in enumerate(some):
            found = ids[near[k]]
            found = found[found != r[0]]
            links[r[0]] += len(found)
            if not same:
                for other in found.tolist():
                    links[other] += 1
            for other in found.tolist():
                x, y = find(r[0]), find(other)
                if x != y:
                    root[max(x, y)] = min(x, y)
    return [(x, n, find(x)) for x, n in links.items() if n]


def _by_block(batches):
    """Rows (label, class, block, many, rep, sets), sorted: one ((label, class, block, many), [(rep, side 0, shingles)]) per block."""
    key, held = None, []
    for b in batches:
        for label, size_class, block, many, rep, raw in zip(*[b.column(k).to_pylist() for k in range(6)], strict=True):
            if (label, size_class, block, many) != key:
                if key:
                    yield key, held
                key, held = (label, size_class, block, many), []
            if not held or held[-1][0] != rep:  # a doc_id that repeats counts once
                held.append((rep, 0, np.frombuffer(raw, np.uint64)))
    if key:
        yield key, held


def _links_batch(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], ["rep", "links", "root"])


def exact_links(docs: DataFrame, groups: DataFrame, sizes: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """groups (node, label), sizes (rep, size): the linked pairs of each group by their texts' sets, to (rep, links, root) per unit.

    Each block is compared with itself where its sets come together; blocks of groups with several are put into the shared
    folder there, and every pair of such blocks that can hold a link is a unit that reads its two files, so no set is shuffled more than once."""
    spark = docs.sparkSession
    # a class holds sizes within a factor of 1 / threshold, so linked sets are in one class or in neighbours
    size_class = F.floor(F.log("size") / math.log(1 / threshold)).cast("int")
    members = groups.join(sizes, groups["node"] == sizes["rep"]).select("node", "label", size_class.alias("class"), "size")
    wide = F.sum(F.col("size") * 8)
    per_group = groups.join(sizes, groups["node"] == sizes["rep"]).groupBy("label").agg(F.count(F.lit(1)).alias("m"), wide.alias("bytes"))
    per_group = per_group.select("label", ((F.col("m") > BLOCK) | ((F.col("m") > 1) & (F.col("bytes") > BLOCK_BYTES))).alias("many"))
    spent = members = saved(members.join(per_group, "label").withColumn("class", F.when(F.col("many"), F.col("class")).otherwise(0)), "ngram-members")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, wide / BLOCK_BYTES))
    per_class = saved(members.filter("many").groupBy("label", "class").agg(blocks.cast("int").alias("blocks")), "ngram-classes-sizes")
    members = members.join(per_class, ["label", "class"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.lit(0)))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    folder = fresh(spark, "ngram-blocks")

    def shingled(batches):
        shingler = Shingler(n)
        for b in batches:
            t = pa.Table.from_batches([b])
            sets = pa.array([shingler(x.as_py()).tobytes() for x in t.column("text")], pa.binary())
            yield from t.drop_columns(["text"]).append_column("sets", sets).to_batches()

    def inside(batches):
        for (label, size_class, block, many), held in _by_block(batches):
            if many:
                keep_block(folder, f"{label}-{size_class}-{block}", [(r, x) for r, _, x in held])
            yield _links_batch(verify_unit(held, True, threshold, many) if len(held) > 1 else [])

    def across(batches):
        for b in batches:
            for label, class_u, u, class_v, v in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
                rows = [(r, side, x) for side, name in ((0, f"{label}-{class_u}-{u}"), (1, f"{label}-{class_v}-{v}")) for r, x in read_block(folder, name)]
                yield _links_batch(verify_unit(rows, False, threshold, True))

    schema = "rep long, links long, root long"
    # few of all texts are candidates: where their identifiers are few enough to be sent everywhere, only they are moved
    members = checked_side(members.select(F.col("node").alias("rep"), "label", "class", "block", "many"), "ngram-members")
    rows = texts.join(members, "rep").select("label", "class", "block", "many", "rep", "text").mapInArrow(shingled, "label long, class int, block int, many boolean, rep long, sets binary")
    own = saved(rows.repartition("label", "class", "block").sortWithinPartitions("label", "class", "block", "rep", "sets").mapInArrow(inside, schema), "ngram-inside")
    every = per_class.select("label", F.col("class").alias("class_u"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("u"), F.col("blocks"))
    same = every.filter(F.col("u") + 1 < F.col("blocks")).select("label", "class_u", "u", F.col("class_u").alias("class_v"), F.explode(F.sequence(F.col("u") + 1, F.col("blocks") - 1)).alias("v"))
    after = per_class.select("label", (F.col("class") - 1).alias("class_u"), F.col("blocks").alias("blocks_v"))
    beside = every.join(after, ["label", "class_u"]).select("label", "class_u", "u", (F.col("class_u") + 1).alias("class_v"), F.explode(F.sequence(F.lit(0), F.col("blocks_v") - 1)).alias("v"))
    units = same.union(beside)
    other = saved(units.repartition("label", "class_u", "u", "class_v", "v").mapInArrow(across, schema), "ngram-across")
    forget_folder(spark, folder)  # the blocks
    found = saved(own.union(other), "ngram-links")
    for t in (spent, members, per_class, own, other):
        forget(spark, t)
    return found


def keep_block(folder: str, name: str, rows: list[tuple[int, np.ndarray]]) -> None:
    """Write a block under its attempt's name, then move it: repeated tasks leave the same whole file."""
    fs, base = opened(folder)
    fs.create_dir(base, recursive=True)
    tmp = f"{base}/.{name}-{uuid.uuid4().hex[:8]}"
    table = pa.table({"rep": pa.array([r for r, _ in rows], pa.int64()), "sets": pa.array([x.tobytes() for _, x in rows], pa.large_binary())})
    with fs.open_output_stream(tmp) as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    fs.move(tmp, f"{base}/{name}")


def read_block(folder: str, name: str) -> list[tuple[int, np.ndarray]]:
    """A block's sets; one to which the hash dealt no member has no file."""
    fs, base = opened(folder)
    path = f"{base}/{name}"
    if fs.get_file_info(path).type == pa.fs.FileType.NotFound:
        return []
    with fs.open_input_file(path) as f:
        t = pa.ipc.open_file(f).read_all()
    return [(r, np.frombuffer(x, np.uint64)) for r, x in zip(t.column("rep").to_pylist(), t.column("sets").to_pylist(), strict=True)]


def _classes(docs: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """ngram_classes() for doc_ids that are unique and not null."""
    spark = docs.sparkSession
    own = saved(sketches(docs, n), "ngram-sketches")
    of_print = own.filter("print is not null").groupBy("print")
    sets = saved(of_print.agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "ngram-sets")
    links = candidates(sets.select("rep", "tokens"), threshold, recall)
    groups = components(links, "ngram-groups", links.count())
    forget(spark, links)
    found = exact_links(docs, groups, sets.select("rep", "size"), n, threshold)
    classes = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "ngram-classes", groups.count())
    per_set = (
        sets.select("print", "rep", "rows").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
        .join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").select("print", F.col("rep").alias("rep_id"), "label", "links", "rows")
    )
    per_set = saved(per_set, "ngram-per-set")
    rows, least = own.select("doc_id", "print", "size"), max(HOT_ROWS, own.count() // 1000)
    # copies of a common text are joined where they lie: there are at most a thousand such texts; rows without a set need no join
    hot = F.broadcast(per_set.filter(F.col("rows") >= least).drop("rows"))
    cold = rows.filter("print is not null").join(hot.select("print"), "print", "left_anti").join(per_set.filter(F.col("rows") < least).drop("rows"), "print")
    none = rows.filter("print is null").withColumns({"rep_id": F.lit(None).cast("long"), "label": F.lit(None).cast("long"), "links": F.lit(None).cast("long")})
    every = cold.unionByName(rows.join(hot, "print")).unionByName(none)
    rep = F.coalesce("rep_id", "doc_id")
    out = saved(every.select("doc_id", F.coalesce("label", rep).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), rep.alias("rep_id"), F.col("size").alias("n_shingles")), "ngram-documents")
    for t in (own, sets, groups, found, classes, per_set):
        forget(spark, t)
    return out


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """None if every row has a doc_id of its own. Else the rows as (__id, __sha, text); each pair of doc_id and text as (__id, __sha, __rows, doc_id),
    numbered in that order, nulls last; and the numbered texts (doc_id, text)."""
    long_id = docs["doc_id"].cast("long")
    shared = shared_ids(docs, "ngram-shared")
    if shared is not None:
        forget(docs.sparkSession, shared)
    elif not docs.filter("doc_id is null").limit(1).count():
        return None
    sha = F.sha2(F.encode(F.coalesce(docs["text"].cast("string"), F.lit("")), "UTF-8"), 256)
    rows = docs.select(long_id.alias("__id"), sha.alias("__sha"), docs["text"].cast("string").alias("text"))
    pairs = rows.groupBy("__id", "__sha").agg(F.count(F.lit(1)).alias("__rows"))
    ids = saved(pairs.orderBy(F.col("__id").asc_nulls_last(), "__sha").select("*", F.monotonically_increasing_id().alias("doc_id")), "ngram-ids")
    # one text of each pair, found by pre-aggregation so that a pair with many rows meets in no task
    texts = rows.groupBy("__id", "__sha").agg(F.first("text").alias("text"))
    return rows, ids, saved(texts.join(ids, _same(texts, ids)).select(ids["doc_id"], texts["text"]), "ngram-texts")


def _same(a: DataFrame, b: DataFrame):
    return a["__id"].eqNullSafe(b["__id"]) & (a["__sha"] == b["__sha"])


def ngram_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, rep_id, n_shingles."""
    numbered = _numbered(docs)
    if numbered is None:
        return _classes(docs, n, threshold, recall)
    rows, ids, texts = numbered
    found, spark = _classes(texts, n, threshold, recall), docs.sparkSession
    name = ids.select("doc_id", "__id")
    told = found.join(ids, "doc_id")
    for c in ("class_id", "rep_id"):
        told = told.join(name.select(F.col("doc_id").alias(c), F.col("__id").alias(f"__{c}")), c)
    told = saved(told.select("__id", "__sha", F.col("__class_id").alias("class_id"), "n_links", F.col("__rep_id").alias("rep_id"), "n_shingles"), "ngram-told")
    out = rows.drop("text").join(told, _same(rows, told)).select(rows["__id"].alias("doc_id"), "class_id", "n_links", "rep_id", "n_shingles")
    for t in (ids, texts, found):
        forget(spark, t)
    return out


def ngram_filter(docs: DataFrame) -> DataFrame:
    """One document of each class, with the columns of docs: the one with the smallest doc_id.

    Where rows share a doc_id or have none, each pair of doc_id and text is a document of its own, numbered in the order of doc_id (nulls last),
    and of rows with the same doc_id and text one stays. Other columns pass through whatever their names."""
    long_id, spark = docs["doc_id"].cast("long"), docs.sparkSession
    numbered = _numbered(docs)
    if numbered is None:
        classes = _classes(docs, N, THRESHOLD, RECALL)
        gone = checked_side(classes.filter("doc_id <> class_id").select(F.col("doc_id").alias("__gone")), "ngram-gone")
        forget(spark, classes)
        return docs.join(gone, long_id == F.col("__gone"), "left_anti")
    _, ids, texts = numbered
    classes = _classes(texts, N, THRESHOLD, RECALL)
    decided = saved(classes.select("doc_id", (F.col("doc_id") != F.col("class_id")).alias("__gone")).join(ids, "doc_id").filter("__gone or __rows > 1").select("__id", "__sha", "__gone"), "ngram-decided")
    gone, repeated = checked_side(decided.filter("__gone"), "ngram-gone"), checked_side(decided.filter("not __gone"), "ngram-repeated")
    for t in (ids, texts, classes, decided):
        forget(spark, t)
    sha = F.sha2(F.encode(F.coalesce(docs["text"].cast("string"), F.lit("")), "UTF-8"), 256)
    own = free_name(docs, "__own")
    fits = lambda side: long_id.eqNullSafe(side["__id"]) & (sha == side["__sha"])
    kept = docs.join(gone, fits(gone), "left_anti")
    once = docs.join(repeated, fits(repeated), "left_semi").withColumn(own, sha).dropDuplicates(["doc_id", own])
    return kept.join(repeated, fits(repeated), "left_anti").unionByName(once.select(*[once[c] for c in docs.columns]))

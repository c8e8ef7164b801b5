"""Operator 7: exact duplicates by Patricia tries.

Texts are equal when their UTF-8 bytes are, after each run of the bytes 20 and 09-0D has become one space. Each task first puts its own rows
into a compressed radix trie (so copies meet before the shuffle, and a group holding a third of all rows sends one row per task and
flush); the survivors are dealt by length and content hash, and each partition inserts the full byte strings into its trie.
Terminal nodes hold the smallest identifier and the number of rows. A trie that outgrows its byte bound spills its heaviest
subtree to a file of the task's own folder; later insertions below that subtree follow it there, and the file is read back into a trie of its
own at the end. Local files are gone when the task ends; a lost executor's tasks start over.

Null text: equal to the empty text. A null doc_id is never the smallest unless all of a group are null. Rows that repeat the smallest doc_id
of a group are all marked kept by exact_groups(), as nothing tells them apart there; exact_filter() keeps one of them. Texts of any length are whole keys.
Other columns pass through exact_filter() whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import pickle
import shutil
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserix.runtime import checked_side, free_name, saved, shared_ids

#: Bytes of edge labels a trie holds before it spills, and a combiner before it flushes.
MOST_BYTES = 96 << 20
COMBINE_BYTES = 48 << 20
#: Bytes of rows that a spill holds before it writes them.
HELD_BYTES = 1 << 18
#: Smaller groups are never joined apart.
HOT_ROWS = 1000
#: Bytes counted for a node besides its label.
NODE = 400


class Node:
    """An edge's label and what lies below. gone: the spill that has taken this subtree's place."""

    __slots__ = ("label", "kids", "least", "rows", "gone")

    def __init__(self, label: bytes, gone=None):
        self.label, self.kids, self.least, self.rows, self.gone = label, {}, None, 0, gone


def smaller(a, b):
    return b if a is None else a if b is None else min(a, b)


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving: comparisons of slices run in C."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Spill:
    """Rows of a spilled subtree: some in memory, the rest in a file that is open only while it is written or read."""

    def __init__(self, path: str):
        self.path, self.held, self.size = path, [], 0

    def add(self, row: tuple) -> None:
        self.held.append(row)
        self.size += len(row[0]) + NODE
        if self.size > HELD_BYTES:
            self.flush()

    def flush(self) -> None:
        with open(self.path, "ab") as f:
            for row in self.held:
                pickle.dump(row, f)
        self.held, self.size = [], 0

    def rows(self):
        self.flush()
        with open(self.path, "rb") as f:
            while True:
                try:
                    yield pickle.load(f)
                except EOFError:
                    break
        os.unlink(self.path)


class PatriciaTrie:
    """Byte strings with the smallest identifier and number of rows of each."""

    def __init__(self, most_bytes: int = MOST_BYTES, folder: str | None = None):
        self.root, self.most, self.size = Node(b""), most_bytes, 0
        self.folder, self.own, self.spilled, self.made = folder, None, [], 0

    def insert(self, key: bytes, least, rows: int) -> None:
        node, at = self.root, 0
        while True:
            rest = key[at:]
            if not rest:
                break
            kid = node.kids.get(rest[0])
            if kid is None:
                kid = node.kids[rest[0]] = Node(rest)
                self.size += len(rest) + NODE
                node = kid
                break
            n = len(kid.label)
            if not rest.startswith(kid.label):
                n = _shared(rest, kid.label)
                upper = Node(kid.label[:n])
                kid.label = kid.label[n:]
                upper.kids[kid.label[0]] = kid
                node.kids[rest[0]] = upper
                self.size += NODE
                kid = upper
            node, at = kid, at + n
            if node.gone:
                node.gone.add((key, least, rows))
                return
        node.least = least if not node.rows else smaller(node.least, least)
        node.rows += rows
        if self.size > self.most:
            self._spill()

    def _walk(self, node: Node, before: bytes):
        """(key, node) of the terminals below, without recursion."""
        todo = [(node, before)]
        while todo:
            node, before = todo.pop()
            key = before + node.label
            if node.rows:
                yield key, node
            todo += [(k, key) for k in node.kids.values()]

    def _weight(self, node: Node) -> int:
        """Bytes below a node; what is spilled already weighs nothing."""
        total, todo = 0, [] if node.gone else [node]
        while todo:
            x = todo.pop()
            total += len(x.label) + NODE
            todo += [k for k in x.kids.values() if not k.gone]
        return total

    def _gone(self, node: Node) -> list[Spill]:
        found, todo = [], [node]
        while todo:
            x = todo.pop()
            found += [x.gone] if x.gone else []
            todo += x.kids.values()
        return found

    def _spill(self) -> None:
        """Write the heaviest subtree out. Down from the root as long as one child holds nearly all."""
        node, before = self.root, b""
        while node.kids:
            weights = {k: self._weight(v) for k, v in node.kids.items()}
            k = max(weights, key=weights.get)
            kid = node.kids[k]
            if not weights[k]:
                return
            if weights[k] < sum(weights.values()) or node.rows or not kid.kids:
                if self.own is None:
                    self.own = tempfile.mkdtemp(prefix="trie-", dir=self.folder)
                self.made += 1
                spill = Spill(os.path.join(self.own, str(self.made)))
                for key, t in self._walk(kid, before + node.label):
                    spill.add((key, t.least, t.rows))
                for below in self._gone(kid):  # spills inside go on in the new one
                    for row in below.rows():
                        spill.add(row)
                    self.spilled.remove(below)
                self.spilled.append(spill)
                node.kids[k] = Node(kid.label, spill)
                self.size -= weights[k]
                return
            before, node = before + node.label, kid

    def items(self):
        """(key, least, rows) of every distinct key; frees the trie."""
        try:
            for key, t in self._walk(self.root, b""):
                yield key, t.least, t.rows
            self.root = Node(b"")
            for spill in self.spilled:
                # what was spilled gets a trie of twice the bound, so that splitting ends
                sub = PatriciaTrie(self.most * 2, self.folder)
                for row in spill.rows():
                    sub.insert(*row)
                yield from sub.items()
        finally:
            self.close()

    def close(self) -> None:
        if self.own:
            shutil.rmtree(self.own, ignore_errors=True)


def normalised(text: str | None) -> bytes:
    """UTF-8 with each run of white space (20, 09-0D) as one space: bytes.split() cuts at just these bytes."""
    raw = (text or "").encode("utf-8")
    out = b" ".join(raw.split())
    if not out:
        return b" " if raw else b""
    return (b" " if raw[:1].isspace() else b"") + out + (b" " if raw[-1:].isspace() else b"")


def _combine(batches):
    """A task's rows (doc_id, text) to distinct texts."""
    import hashlib

    def flushed(trie):
        keys, least, rows = [], [], []
        for key, first, n in trie.items():
            keys.append(key)
            least.append(first)
            rows.append(n)
            if len(keys) == 2000:
                yield batch(keys, least, rows)
                keys, least, rows = [], [], []
        if keys:
            yield batch(keys, least, rows)

    def batch(keys, least, rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(map(len, keys), pa.int64()), pa.array([int.from_bytes(hashlib.blake2b(k, digest_size=8).digest(), "little", signed=True) for k in keys], pa.int64()), pa.array(keys, pa.binary()), pa.array(least, pa.int64()), pa.array(rows, pa.int64())],
            ["len", "hash", "key", "least", "rows"],
        )

    trie = PatriciaTrie(1 << 60)
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            trie.insert(normalised(text), doc_id, 1)
            if trie.size > COMBINE_BYTES:
                yield from flushed(trie)
                trie = PatriciaTrie(1 << 60)
    yield from flushed(trie)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _digests(batches):
    """(doc_id, text) to (doc_id, digest of the normalised text)."""
    import hashlib

    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.sha256(normalised(t.as_py())).hexdigest() for t in b.column(1)], pa.string())], ["doc_id", "text_sha256"])


def owners(docs: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per distinct normalised text: sha, keep_id, group_size. The digest stands for its text in later joins."""

    def run(batches):
        import hashlib

        trie = PatriciaTrie(most_bytes)
        for b in batches:
            for key, least, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                trie.insert(key, least, rows)
        out: list[tuple] = []
        for key, least, rows in trie.items():
            out.append((hashlib.sha256(key).hexdigest(), least, rows))
            if len(out) == 4000:
                yield made(out)
                out = []
        if out:
            yield made(out)

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["sha", "keep_id", "group_size"])

    local = _texts(docs).mapInArrow(_combine, "len long, hash long, key binary, least long, rows long")
    return local.repartition("len", "hash").select("key", "least", "rows").mapInArrow(run, "sha string, keep_id long, group_size long")


def exact_groups(docs: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Groups with a thousandth of all rows or more are at most 1,000: they are sent to all tasks and their rows joined where they lie, so that only
    rows of smaller groups are dealt by digest."""
    rows = _texts(docs).mapInArrow(_digests, "doc_id long, text_sha256 string")
    found = saved(owners(docs, most_bytes), "exact-owners")
    least = max(HOT_ROWS, (found.agg(F.sum("group_size")).first()[0] or 0) // 1000)
    hot = F.broadcast(found.filter(F.col("group_size") >= least).select(F.col("sha").alias("__hot"), F.col("keep_id").alias("__keep"), F.col("group_size").alias("__size")))
    # a row of a hot group needs nothing from the shuffle: its key there is no digest, and spreads such rows out
    spread = F.concat(F.lit("hot "), F.coalesce(F.col("doc_id"), F.spark_partition_id().cast("long")))
    rows = rows.join(hot, F.col("text_sha256") == F.col("__hot"), "left").withColumn("__key", F.when(F.col("__hot").isNull(), F.col("text_sha256")).otherwise(spread))
    cold = found.filter(F.col("group_size") < least)
    found = rows.join(cold, F.col("__key") == F.col("sha"), "left").withColumns({"keep_id": F.when(F.col("__hot").isNull(), F.col("keep_id")).otherwise(F.col("__keep")), "group_size": F.coalesce("group_size", "__size")})
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_filter(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group of equal texts, with the columns of docs. Only identifiers are shuffled for the decision.

    Rows that share a doc_id, or have none, go by doc_id and text, so that a copy doesn't take other texts along; of those with the same
    doc_id and text one stays."""
    gone, shared = exact_groups(docs).filter("not kept").select(F.col("doc_id").alias("__gone"), F.col("text_sha256").alias("__sha")), shared_ids(docs, "exact-shared")
    id_of = docs["doc_id"].cast("long")
    if shared is None:
        gone = checked_side(gone.select("__gone"), "exact-gone")
        return docs.join(gone, id_of.eqNullSafe(F.col("__gone")), "left_anti")
    mark, own, text = free_name(docs, "__is_shared"), free_name(docs, "__own"), F.regexp_replace(F.coalesce(docs["text"].cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    gone = gone.join(shared, F.col("__gone").eqNullSafe(F.col("__shared")), "left").select("__gone", F.when(F.col("__is_shared"), F.col("__sha")).alias("__sha")).distinct()
    shared = shared.withColumnRenamed("__is_shared", mark)
    rows = docs.join(shared, id_of.eqNullSafe(shared["__shared"]), "left").withColumn(own, F.when(F.col(mark), F.sha2(F.encode(text, "UTF-8"), 256)))
    rows = rows.select(*[rows[c] for c in docs.columns], rows[mark], rows[own])
    gone = checked_side(gone, "exact-gone")
    rows = rows.join(gone, rows["doc_id"].cast("long").eqNullSafe(gone["__gone"]) & rows[own].eqNullSafe(gone["__sha"]), "left_anti")
    repeats = rows.filter(F.col(mark)).dropDuplicates(["doc_id", own])
    return rows.filter(F.col(mark).isNull()).unionByName(repeats).select(*docs.columns)


EXACT_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""

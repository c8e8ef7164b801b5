"""Queries on originals, features and report tables: identity, sampling, vectors, merges, integrity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserix.functions import hashing, scalars, table_functions
from tesserix.operators import acquisition, identity, integrity, metrics, sampling, tables, vectors
from tesserix.plans.base import ACC, AUC, FEATURES, MANIFEST, SCORED, query, sql_hash, sql_ranked, sql_values
from tesserix.runtime import saved, table
from tesserix.sources import relations
from tesserix.sources.relations import CHAINS, PRESETS, ROLE_CONDITIONS, features, manifest, scored_views

# labels, paths, registries


@query("SELECT doc_id, p AS path, coalesce(try_cast(nullif(regexp_extract(regexp_extract(p, '([^/]*?)(\\.[^./]*)?$', 1), '^([0-9]+)_', 1), '') AS INTEGER), CASE WHEN regexp_extract(p, '([^/]*)/[^/]*$', 1) = 'aigc' THEN 1 ELSE 0 END) AS sid, split_part(p, '/', 1) AS split, CASE WHEN split_part(p, '/', 2) = 'real' THEN 0 WHEN split_part(p, '/', 2) = 'aigc' THEN 1 END AS label FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'train' ELSE 'val' END || '/' || CASE WHEN doc_id % 3 = 0 THEN 'real' ELSE 'aigc' END || '/' || CASE WHEN doc_id % 4 = 0 THEN 'foo' ELSE (doc_id % 3)::VARCHAR || '_' || lpad(doc_id::VARCHAR, 6, '0') END || '.jpg' AS p FROM documents)")
def path_labels(spark, d):
    """Split, label and sid from paths."""
    i = F.col("doc_id")
    name = F.when(i % 4 == 0, "foo").otherwise(F.concat((i % 3).cast("string"), F.lit("_"), F.lpad(i.cast("string"), 6, "0")))
    p = F.concat(F.when(i % 5 == 0, "train").otherwise("val"), F.lit("/"), F.when(i % 3 == 0, "real").otherwise("aigc"), F.lit("/"), name, F.lit(".jpg"))
    part = lambda k: F.split_part(F.col("path"), F.lit("/"), F.lit(k))
    return table(spark, d, "documents").select("doc_id", p.alias("path")).select("doc_id", "path", scalars.sid_from_path(F.col("path")).alias("sid"), part(1).alias("split"), F.when(part(2) == "real", 0).when(part(2) == "aigc", 1).alias("label"))


@query("SELECT doc_id, (doc_id % 5)::INTEGER AS sid, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS label, CASE WHEN doc_id % 5 = 0 THEN 'real' ELSE 'aigc' END AS folder FROM documents WHERE doc_id % 5 < 3")
def binary_label_map(spark, d):
    """Unknown sids have no label and are dropped."""
    sid = (F.col("doc_id") % 5).cast("int")
    return table(spark, d, "documents").select("doc_id", sid.alias("sid"), scalars.binary_label(sid).alias("label"), scalars.folder(scalars.binary_label(sid)).alias("folder")).filter("label IS NOT NULL")


ROLE_ROWS = [(g, r, n, i) for (g, r), names in ROLE_CONDITIONS.items() for i, n in enumerate(names)]
REGISTRY = sql_values("rc", ["generation", "role", "condition", "ord"], ROLE_ROWS)


@query(f"WITH {MANIFEST}, {REGISTRY} SELECT doc_id, role, condition, rc.ord FROM mf JOIN rc USING (role) WHERE generation = 'v4'")
def view_grid(spark, d):
    """Each original once per condition of its role, by a join with the registry."""
    reg = relations.role_conditions(spark).filter("generation = 'v4'").select("role", "condition", "ord")
    return manifest(spark, d).drop("ord").join(F.broadcast(reg), "role").select("doc_id", "role", "condition", "ord")


@query(f"WITH {MANIFEST}, {REGISTRY} SELECT generation, role, count(*) AS n_views, count(DISTINCT doc_id) AS n_originals FROM mf JOIN rc USING (role) GROUP BY generation, role")
def view_counts(spark, d):
    """Views and originals per role and generation."""
    reg = relations.role_conditions(spark).select("generation", "role", "condition")
    return manifest(spark, d).join(F.broadcast(reg), "role").groupBy("generation", "role").agg(F.count(F.lit(1)).alias("n_views"), F.countDistinct("doc_id").alias("n_originals"))


CONDITIONS = sql_values("cr", ["name", "ord", "op", "param"], [(n, i, o, p) for i, (n, o, p) in enumerate(PRESETS)])
STEPS = sql_values("cs", ["name", "step", "op", "param"], [(n, i, o, p) for n, s in CHAINS.items() for i, (o, p) in enumerate(s)])


@query(f"WITH {MANIFEST}, {REGISTRY}, {CONDITIONS} SELECT name, cr.ord, op, param::DOUBLE AS param, count(doc_id) AS n_views FROM cr LEFT JOIN (SELECT doc_id, condition FROM mf JOIN rc USING (role)) v ON v.condition = name GROUP BY ALL")
def condition_registry(spark, d):
    """Presets, and how many views of the table's originals each gives in all generations."""
    views = manifest(spark, d).join(F.broadcast(relations.role_conditions(spark).select("role", F.col("condition").alias("name"))), "role").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return relations.conditions(spark).join(views, "name", "left").select("name", "ord", "op", "param", F.coalesce("n", F.lit(0)).cast("long").alias("n_views"))


@query(f"WITH {MANIFEST}, {REGISTRY}, {STEPS} SELECT doc_id, cs.name, cs.step, cs.op, cs.param::DOUBLE AS param FROM mf JOIN rc USING (role) JOIN cs ON cs.name = condition WHERE generation = 'v4'")
def chain_registry(spark, d):
    """The steps of every chained view of the table's originals."""
    views = manifest(spark, d).join(F.broadcast(relations.role_conditions(spark).filter("generation = 'v4'").select("role", F.col("condition").alias("name"))), "role")
    return views.join(F.broadcast(relations.chains(spark)), "name").select("doc_id", "name", "step", "op", "param")


@query(f"WITH {MANIFEST}, {REGISTRY} SELECT doc_id, role, condition, rc.ord FROM mf JOIN rc USING (role) WHERE generation = 'v3'")
def lateral_views(spark, d):
    """The views of each original by a table function, called from SQL."""
    table_functions.register(spark)
    return spark.sql("SELECT doc_id, role, condition, v.ord FROM {originals} m, LATERAL role_views(m.role, 'v3') v", originals=manifest(spark, d))


# sampling


@query("SELECT source, n AS per_binary, sid::INTEGER AS sid, CASE sid WHEN 0 THEN n WHEN 1 THEN greatest(1, n // 2) ELSE greatest(1, n - greatest(1, n // 2)) END::INTEGER AS quota FROM (SELECT coalesce(source, '') AS source, count(*)::INTEGER AS n FROM documents GROUP BY 1) t, (VALUES (0), (1), (2)) s(sid)")
def sid_quotas(spark, d):
    """Q1: quotas of each source, half of whose documents are real."""
    per = table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).cast("int").alias("per_binary"))
    return sampling.with_quotas(per, "per_binary")


@query(f"WITH {MANIFEST}, r AS (SELECT *, CASE WHEN sid = 0 THEN 0 ELSE 1 END AS label FROM mf), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ord) AS rn FROM r) SELECT doc_id, label FROM k WHERE rn <= CASE WHEN label = 0 THEN 20 ELSE 21 END")
def balanced_slice(spark, d):
    """W1 for 41 rows."""
    rows = manifest(spark, d).withColumn("label", F.when(F.col("sid") == 0, 0).otherwise(1))
    return sampling.balanced_slice(rows, 41).select("doc_id", "label")


@query(f"WITH {MANIFEST}, k AS (SELECT doc_id, sid, row_number() OVER (PARTITION BY sid ORDER BY {sql_hash('q4', 'doc_id')}, doc_id) AS rn FROM mf) SELECT doc_id, sid FROM k WHERE rn <= 50")
def hash_sample_balanced(spark, d):
    """Q4 Q8 Q9."""
    return sampling.hash_sample(manifest(spark, d), ["sid"], "doc_id", 50, "q4").select("doc_id", "sid")


@query(f"WITH {MANIFEST}, k AS (SELECT doc_id, domain, sid, row_number() OVER (PARTITION BY domain, sid ORDER BY {sql_hash('q5', 'doc_id')}) AS rn, count(*) OVER (PARTITION BY domain, sid) AS n FROM mf) SELECT doc_id, domain, sid, CASE WHEN rn * 2 <= n THEN 0 ELSE 1 END AS half FROM k")
def stratified_halves(spark, d):
    """Q5."""
    return sampling.stratified_halves(manifest(spark, d), ["domain", "sid"], "doc_id", "q5").select("doc_id", "domain", "sid", "half")


@query(f"WITH {MANIFEST}, k AS (SELECT doc_id, row_number() OVER (ORDER BY {sql_hash('q6', 'doc_id')}) AS rn, count(*) OVER () AS n FROM mf) SELECT doc_id, CASE WHEN rn <= greatest(1, least(n - 1, floor(n * 0.3))) THEN 'cal' ELSE 'test' END AS part FROM k")
def cal_test_split(spark, d):
    """Q6."""
    return sampling.cal_test_split(manifest(spark, d), "doc_id", 0.3, "q6").select("doc_id", "part")


@query(f"WITH s AS (SELECT conv_id AS grp, count(*) AS n_views FROM conversations GROUP BY 1) SELECT grp, n_views, ((row_number() OVER (ORDER BY n_views DESC, {sql_hash('folds', 'grp')}) - 1) % 3)::INTEGER AS fold FROM s")
def group_folds(spark, d):
    """Q7."""
    return sampling.group_folds(table(spark, d, "conversations").withColumnRenamed("conv_id", "grp"), "grp", 3)


FILL = f"""WITH {MANIFEST}, u AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY ord) AS f FROM mf), q(sid, quota) AS (VALUES (0, 120), (1, 60), (2, 100000)),
g AS (SELECT u.doc_id, u.sid, row_number() OVER (PARTITION BY u.sid ORDER BY ord) AS slot, quota FROM u JOIN q USING (sid) WHERE f = 1)"""


@query(FILL + " SELECT doc_id, sid, slot::INTEGER AS slot FROM g WHERE slot <= quota")
def quota_fill(spark, d):
    """Content is unique, quotas are filled in order."""
    return sampling.quota_fill(manifest(spark, d), spark.createDataFrame([(0, 120), (1, 60), (2, 100000)], "sid int, quota int"), "sid", "ord", "sha")[0].select("doc_id", "sid", "slot")


@query(FILL + " SELECT q.sid, q.quota, count(g.doc_id) FILTER (slot <= g.quota) AS filled, q.quota - count(g.doc_id) FILTER (slot <= g.quota) AS short FROM q LEFT JOIN g USING (sid) GROUP BY q.sid, q.quota")
def quota_shortfall(spark, d):
    """Q2: what quotas lack."""
    return sampling.quota_fill(manifest(spark, d), spark.createDataFrame([(0, 120), (1, 60), (2, 100000)], "sid int, quota int"), "sid", "ord", "sha")[1]


@query(f"WITH {MANIFEST}, k AS (SELECT doc_id, model, row_number() OVER (PARTITION BY model ORDER BY ord) AS slot FROM mf) SELECT doc_id, model, slot::INTEGER AS slot, CASE WHEN slot <= 12 THEN 'test' WHEN slot <= 18 THEN 'cal' ELSE 'train' END AS assigned FROM k WHERE slot <= 38")
def roles_by_quota(spark, d):
    """Ranks to roles by cumulative quota."""
    return sampling.roles_by_quota(manifest(spark, d).drop("role"), "model", "ord", [("test", 12), ("cal", 6), ("train", 20)]).select("doc_id", "model", "slot", F.col("role").alias("assigned"))


@query("WITH t AS (SELECT count(*) AS n FROM documents), b AS (SELECT i, floor(i * n / 7) AS lo, floor((i + 1) * n / 7) AS hi FROM t, (SELECT unnest(range(0, 7)) AS i)) SELECT doc_id, i::INTEGER AS shard FROM documents JOIN b ON doc_id >= lo AND doc_id < hi")
def contiguous_shards(spark, d):
    """Ordinals to seven contiguous shards."""
    docs = table(spark, d, "documents")
    return sampling.contiguous_shards(docs, "doc_id", docs.count(), 7).select("doc_id", "shard")


# identity


@query(f"WITH {MANIFEST} SELECT doc_id, sha FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY ord) AS rn FROM mf) WHERE rn = 1")
def dedupe_keep_first(spark, d):
    """U6 F1."""
    return identity.keep_first(manifest(spark, d), "sha", "ord").select("doc_id", "sha")


@query(f"WITH {MANIFEST} SELECT doc_id, role FROM mf WHERE role <> 'train' AND sha NOT IN (SELECT sha FROM mf WHERE role = 'train')")
def exclude_training_content(spark, d):
    """J3 U5."""
    m = manifest(spark, d)
    return identity.exclude_seen(m.filter("role <> 'train'"), m.filter("role = 'train'"), "sha").select("doc_id", "role")


@query(f"WITH {MANIFEST} SELECT sha, count(DISTINCT role) AS n_roles, count(*) AS n_rows FROM mf GROUP BY sha HAVING count(DISTINCT role) > 1")
def split_overlap(spark, d):
    """Content in more than one role, in one pass."""
    return identity.role_overlap(manifest(spark, d))


@query(f"WITH {MANIFEST}, r AS (SELECT *, row_number() OVER (PARTITION BY role, sha ORDER BY ord) = 1 AS f, sha IN (SELECT sha FROM mf WHERE role = 'train') AS t FROM mf) SELECT role, count(*) AS n_rows, sum((role = 'train' AND NOT f)::INT)::BIGINT AS training_copies, sum((role <> 'train' AND t)::INT)::BIGINT AS leaks_excluded, sum((NOT (role = 'train' AND NOT f) AND NOT (role <> 'train' AND t))::INT)::BIGINT AS n_kept FROM r GROUP BY role")
def audit_manifest(spark, d):
    """V1 A1."""
    return identity.audit(manifest(spark, d))


@query(f"WITH {MANIFEST} SELECT role, model, count(*) AS n, count(DISTINCT sha) AS n_distinct, count(*) FILTER (sid = 2) AS n_tampered FROM mf GROUP BY role, model")
def manifest_counts(spark, d):
    """A1 V2: counters by role and model."""
    return manifest(spark, d).groupBy("role", "model").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sha").alias("n_distinct"), F.count(F.when(F.col("sid") == 2, 1)).alias("n_tampered"))


@query("SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''")
def protected_contamination(spark, d):
    """T5: documents that hold a protected passage, however short."""
    return identity.protected_contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


DHASH = "list_sum(list_transform(range(56), lambda i: CASE WHEN x[(i // 7) * 8 + i % 7 + 2] > x[(i // 7) * 8 + i % 7 + 1] THEN 1::BIGINT << i ELSE 0 END))::BIGINT"
BASIS = "[" + ", ".join(repr(v) for v in hashing.dct_basis()) + "]"
DCT = f"""tm AS (SELECT *, list_transform(range(64), lambda k: list_sum(list_transform(range(8), lambda r: {BASIS}[(k // 8) * 8 + r + 1] * x[r * 8 + k % 8 + 1]))) AS half FROM fv),
d1 AS (SELECT *, list_transform(range(64), lambda k: list_sum(list_transform(range(8), lambda c: {BASIS}[(k % 8) * 8 + c + 1] * half[(k // 8) * 8 + c + 1]))) AS dct FROM tm), dc AS (SELECT *, list_sort(dct[2:64])[32] AS med FROM d1)"""
PHASH = "list_sum(list_transform(range(63), lambda i: CASE WHEN dct[i + 2] > med THEN 1::BIGINT << i ELSE 0 END))::BIGINT"


@query(f"WITH {FEATURES} SELECT vec_id, {DHASH} AS dhash FROM fv")
def dhash_bits(spark, d):
    """F4 on 8 x 8 blocks."""
    return features(spark, d).select("vec_id", hashing.dhash(F.col("x")).alias("dhash"))


@query(f"WITH {FEATURES}, {DCT} SELECT vec_id, {PHASH} AS phash FROM dc")
def phash_bits(spark, d):
    """F5 on 8 x 8 blocks."""
    return features(spark, d).select("vec_id", hashing.phash(F.col("x")).alias("phash"))


@query(f"WITH {FEATURES}, {DCT}, e AS (SELECT vec_id, list_sum(list_transform(range(64), lambda k: CASE WHEN k // 8 >= 2 AND k % 8 >= 2 THEN abs(dct[k + 1]) ELSE 0 END)) / 36 AS high, list_sum(list_transform(range(64), lambda k: CASE WHEN k // 8 < 2 AND k % 8 < 2 THEN abs(dct[k + 1]) ELSE 0 END)) / 4 AS low FROM dc) SELECT vec_id, high / (low + 0.000001) AS ratio FROM e", ("ratio",))
def dct_energy(spark, d):
    """High against low frequencies of a block."""
    c = features(spark, d).select("vec_id", hashing.dct2(F.col("x")).alias("c"))
    mean = lambda keep, n: F.aggregate(F.transform("c", lambda v, k: F.when(keep(k), F.abs(v)).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b) / n
    high = mean(lambda k: (F.floor(k / 8) >= 2) & (k % 8 >= 2), 36)
    low = mean(lambda k: (F.floor(k / 8) < 2) & (k % 8 < 2), 4)
    return c.select("vec_id", (high / (low + 1e-6)).alias("ratio"))


NEAR = f"""WITH {FEATURES}, {DCT}, b AS (SELECT grp AS g, {DHASH} AS d0, {PHASH} AS p0 FROM dc WHERE view_idx = 0),
h AS (SELECT vec_id AS id, xor(d0, CASE WHEN view_idx = 0 THEN 0::BIGINT ELSE 1::BIGINT << view_idx END) AS d, xor(p0, CASE WHEN view_idx = 0 THEN 0::BIGINT ELSE 7::BIGINT << (view_idx * 5) END) AS p FROM fv JOIN b ON grp = g)"""


def _hashes(spark, d):
    """Near copies: each original's hashes, with one bit of d and three of p changed per view."""
    f = features(spark, d)
    base = f.filter("view_idx = 0").select(F.col("grp").alias("g"), hashing.dhash(F.col("x")).alias("d0"), hashing.phash(F.col("x")).alias("p0"))
    moved = lambda of, bits, at: F.col(of).bitwiseXOR(F.when(F.col("view_idx") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(bits).cast("long"), at)))
    return f.join(base, F.col("grp") == F.col("g")).select(F.col("vec_id").alias("id"), moved("d0", 1, F.col("view_idx")).alias("d"), moved("p0", 7, F.col("view_idx") * 5).alias("p"))


REPS = NEAR + ", r AS (SELECT p, d, min(id) AS id FROM h GROUP BY p, d)"


@query(REPS + " SELECT a.id AS a, b.id AS b, bit_count(xor(a.p, b.p))::INTEGER AS p_dist, bit_count(xor(a.d, b.d))::INTEGER AS d_dist FROM r a JOIN r b ON a.id < b.id WHERE bit_count(xor(a.p, b.p)) <= 4 AND bit_count(xor(a.d, b.d)) <= 2")
def near_dup_pairs(spark, d):
    """Pairs between the representatives of different hashes; a banded join in place of a nested loop, then the exact radii."""
    return identity.near_groups(_hashes(spark, d))


@query(NEAR + " SELECT id, min(id) OVER (PARTITION BY p, d) AS rep, count(*) OVER (PARTITION BY p, d) AS n FROM h")
def near_dup_members(spark, d):
    """Who stands for whom in near_dup_pairs."""
    h = _hashes(spark, d)
    return identity.hash_members(h, identity.hash_groups(h))


ROLES = "k AS (SELECT h.*, sha256('content ' || (id % 97)::VARCHAR) AS sha, CASE WHEN id % 10 = 0 THEN 'protected' WHEN id % 3 = 2 THEN 'tampered' ELSE 'training' END AS role FROM h)"


def _roles(spark, d):
    """Every tenth vector is protected; digests repeat, so that some protected content is in training to the bit."""
    i = F.col("id")
    return _hashes(spark, d).select("id", "p", "d", F.sha2(F.concat(F.lit("content "), (i % 97).cast("string")), 256).alias("sha"), F.when(i % 10 == 0, "protected").when(i % 3 == 2, "tampered").otherwise("training").alias("role"))


@query(NEAR + f", {ROLES} SELECT DISTINCT a.id FROM k a JOIN k b ON a.role = 'protected' AND b.role <> 'protected' AND (a.sha = b.sha OR (bit_count(xor(a.p, b.p)) <= 4 AND bit_count(xor(a.d, b.d)) <= 2))")
def protected_matches(spark, d):
    """V3 V4: protected originals whose content is in training, by digest or by both hashes."""
    k = _roles(spark, d)
    return identity.protected_matches(k.filter("role = 'protected'"), k.filter("role <> 'protected'"))


@query(NEAR + f", {ROLES} SELECT a.id AS a, b.id AS b, bit_count(xor(a.p, b.p))::INTEGER AS p_dist, bit_count(xor(a.d, b.d))::INTEGER AS d_dist FROM (SELECT p, d, min(id) AS id FROM k WHERE role = 'protected' GROUP BY p, d) a JOIN (SELECT p, d, min(id) AS id FROM k WHERE role = 'tampered' GROUP BY p, d) b ON bit_count(xor(a.p, b.p)) <= 12 AND bit_count(xor(a.d, b.d)) <= 10")
def parent_candidates(spark, d):
    """Protected against tampered originals, within the looser radii, by multi-index hashing; representatives of their hashes."""
    k = _roles(spark, d)
    reps = lambda role: identity.hash_groups(k.filter(F.col("role") == role)).select(F.col("rep").alias("id"), "p", "d")
    return acquisition.loose_pairs(reps("protected"), reps("tampered"), 12, 10)


@query(NEAR + """, e AS (SELECT a.id AS a, b.id AS b FROM h a JOIN h b ON a.id < b.id WHERE bit_count(xor(a.p, b.p)) <= 4 AND bit_count(xor(a.d, b.d)) <= 2), ids AS (SELECT list(id ORDER BY id) AS l FROM h), n AS (SELECT list(DISTINCT a::VARCHAR || '-' || b::VARCHAR) AS near FROM e),
t AS (SELECT list_reduce(list_prepend([]::BIGINT[], list_transform(l, lambda i: [i])), lambda kept, one: CASE WHEN len(list_filter(kept, lambda x: list_contains(near, x::VARCHAR || '-' || one[1]::VARCHAR))) > 0 THEN kept ELSE list_append(kept, one[1]) END) AS kept FROM ids, n)
SELECT id, list_contains(kept, id) AS accepted FROM h, t""")
def greedy_acceptance(spark, d):
    """First-come acceptance without near neighbours, in parallel rounds; the SQL goes through the rows one after the other."""
    return acquisition.accept_in_order(*_in_order(_hashes(spark, d))).select("id", "accepted")


def _in_order(h):
    """Rows by id and hash, and what tells which of some hashes are near."""
    h = saved(h, "hashes")
    groups = saved(identity.hash_groups(h), "hash-groups")

    def near(hashes):
        reps = groups.join(hashes.select(F.col("h").alias("rep")), "rep", "left_semi").select(F.col("rep").alias("id"), "p", "d")
        return identity.near_pairs(reps, reps).filter("a < b")

    return identity.hash_members(h, groups).select("id", F.col("rep").alias("h")), near


def _fold(first: str, order: str, role: str, limits: str) -> str:
    """Rows taken one after the other: kept holds (id, role) of the accepted ones; role is what the next one would get, limits whether it has room."""
    return (
        NEAR + ", e AS (SELECT a.id AS a, b.id AS b FROM h a JOIN h b ON a.id <> b.id WHERE bit_count(xor(a.p, b.p)) <= 4 AND bit_count(xor(a.d, b.d)) <= 2), "
        f"ids AS (SELECT list(id ORDER BY {order}) AS l FROM h), n AS (SELECT list(a::VARCHAR || '-' || b::VARCHAR) AS near FROM e), "
        "t AS (SELECT list_reduce(list_prepend([]::STRUCT(id BIGINT, role VARCHAR)[], list_transform(l, lambda i: [{'id': i, 'role': ''}])), lambda kept, one: CASE WHEN "
        f"len(list_filter(kept, lambda x: list_contains(near, x.id::VARCHAR || '-' || one[1].id::VARCHAR))) > 0 OR NOT ({limits}) THEN kept ELSE list_append(kept, {{'id': one[1].id, 'role': {role}}}) END) AS kept FROM ids, n) "
        + first
    )


@query(_fold("SELECT id, list_contains(list_transform(kept, lambda x: x.id), id) AS accepted FROM h, t", "id", "''", "len(list_filter(kept, lambda x: x.id % 15 = one[1].id % 15)) < 4 AND len(list_filter(kept, lambda x: x.id % 3 = one[1].id % 3)) < 18"))
def capped_acceptance(spark, d):
    """Q3: first come, no near copies, at most 4 of each (role, model) and 18 of each role."""
    rows, near = _in_order(_hashes(spark, d))
    rows = rows.withColumn("role", F.col("id") % 3).withColumn("model", F.col("id") % 5)
    return acquisition.accept_in_order(rows, near, [(["role", "model"], 4), (["role"], 18)]).select("id", "accepted")


SOURCES = [("s1", [("train", 20), ("dev", 10)], 6), ("s0", [("train", 15), ("test", 10)], None)]
OWN = "len(list_filter(kept, lambda x: x.id % 2 = one[1].id % 2))"
ROLE = f"CASE WHEN one[1].id % 2 = 1 THEN CASE WHEN {OWN} < 20 THEN 'train' WHEN {OWN} < 30 THEN 'dev' END WHEN {OWN} < 15 THEN 'train' WHEN {OWN} < 25 THEN 'test' END"


@query(_fold("SELECT u.id, 's' || (u.id % 2)::VARCHAR AS source, 'm' || ((u.id // 4) % 5)::VARCHAR AS model, u.role FROM (SELECT unnest(kept) AS u FROM t)", "id % 2 DESC, id", ROLE,
             f"({ROLE}) IS NOT NULL AND (one[1].id % 2 = 0 OR len(list_filter(kept, lambda x: x.id % 2 = 1 AND x.role = ({ROLE}) AND (x.id // 4) % 5 = (one[1].id // 4) % 5)) < 6)"))
def acquired_roles(spark, d):
    """Q3: two sources fill their roles one after the other; near copies are refused across sources, models are capped in the first."""
    rows, near = _in_order(_hashes(spark, d))
    i = F.col("id")
    rows = rows.withColumn("source", F.concat(F.lit("s"), (i % 2).cast("string"))).withColumn("model", F.concat(F.lit("m"), (F.floor(i / 4) % 5).cast("string")))
    return acquisition.acquire(rows, near, SOURCES)[0]


# vectors


@query(f"WITH {FEATURES}, n AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS len FROM fv) SELECT vec_id, len AS norm, list_sum(list_transform(range(64), lambda i: (i + 1) * x[i + 1] / (len + 0.00000001))) AS checksum FROM n", ("norm", "checksum"))
def vector_normalise(spark, d):
    """F7."""
    v = features(spark, d).select("vec_id", scalars.norm(F.col("x")).alias("norm"), scalars.normalised(F.col("x")).alias("u"))
    return v.select("vec_id", "norm", F.aggregate(F.transform("u", lambda x, i: (i + 1) * x), F.lit(0.0), lambda a, b: a + b).alias("checksum"))


LONG = f"{FEATURES}, lg AS (SELECT vec_id, grp, view_idx, y, unnest(range(64))::INTEGER AS pos, unnest(x) AS v FROM fv)"


@query(f"WITH {LONG} SELECT grp, pos, min(y) AS y, avg(v) AS mean FROM lg GROUP BY grp, pos", ("mean",))
def group_mean_vectors(spark, d):
    """A15."""
    return vectors.group_means(features(spark, d))


@query(f"WITH {LONG} SELECT grp, pos, stddev_pop(v) AS std, max(v) AS top FROM lg GROUP BY grp, pos", ("std", "top"))
def corner_summary(spark, d):
    """I16: the four views as corners."""
    return vectors.corner_summary(features(spark, d))


@query(f"WITH {LONG}, n AS (SELECT vec_id, sqrt(sum(v * v)) + 0.00000001 AS len FROM lg GROUP BY vec_id), u AS (SELECT grp, pos, v / len AS v FROM lg JOIN n USING (vec_id)) SELECT grp, pos, stddev_pop(v) AS std, greatest(max(v) - avg(v), avg(v) - min(v)) AS max_dev FROM u GROUP BY grp, pos", ("std", "max_dev"))
def pooled_tokens(spark, d):
    """The four views as tokens."""
    return vectors.pooled_tokens(features(spark, d))


@query(f"WITH {LONG}, n AS (SELECT vec_id, sqrt(sum(v * v)) + 0.00000001 AS len FROM lg GROUP BY vec_id), u AS (SELECT grp, pos, avg(v / len) AS v FROM lg JOIN n USING (vec_id) GROUP BY grp, pos), m AS (SELECT grp, sqrt(sum(v * v)) + 0.00000001 AS len FROM u GROUP BY grp) SELECT grp, sum((pos + 1) * v / len) AS checksum FROM u JOIN m USING (grp) GROUP BY grp", ("checksum",))
def tta_mean(spark, d):
    """Mean of unit vectors, normalised again."""
    return vectors.tta_mean(features(spark, d)).select("grp", F.aggregate(F.transform("x", lambda v, i: (i + 1) * v), F.lit(0.0), lambda a, b: a + b).alias("checksum"))


@query(f"WITH {FEATURES} SELECT a.grp, a.view_idx, a.y, list_sum(list_transform(range(64), lambda i: (i + 1) * (a.x[i + 1] + b.x[i + 1]) / 2)) AS checksum FROM fv a JOIN fv b ON a.grp = b.grp AND b.view_idx = 0 WHERE a.view_idx > 0", ("checksum",))
def consistency_rows(spark, d):
    """M2 M3."""
    rows = vectors.consistency_rows(features(spark, d))
    return rows.select("grp", "view_idx", "y", F.aggregate(F.transform("x", lambda v, i: (i + 1) * v), F.lit(0.0), lambda a, b: a + b).alias("checksum"))


@query(f"WITH {FEATURES} SELECT grp, view_idx, y, x[1] AS first_value FROM fv UNION ALL SELECT grp, 4, y, x[1] * 2 FROM fv WHERE view_idx = 3", ("first_value",))
def extra_view_merge(spark, d):
    """One more view per original that has a last one, into its block; the others' blocks stay as they are."""
    f = features(spark, d)
    extra = f.filter("view_idx = 3").select("grp", "y", F.transform("x", lambda v: v * 2).alias("x"))
    return vectors.merge_extra_views(f, extra, partial=True).select("grp", "view_idx", "y", F.get("x", 0).alias("first_value"))


@query(f"WITH {FEATURES}, s AS (SELECT vec_id, list_concat(list_concat(x[1:16], x[49:64]), list_transform(range(8), lambda i: 0.0)) AS z FROM fv) SELECT vec_id, len(z)::INTEGER AS width, list_sum(list_transform(range(len(z)), lambda i: (i + 1) * z[i + 1])) AS checksum FROM s", ("checksum",))
def feature_slice_concat(spark, d):
    """Slices, composition, padding, finite and width checks."""
    x = vectors.checked(F.col("x"), 64)
    z = vectors.padded(vectors.fused(vectors.cut(x, 0, 16), vectors.cut(x, 48, 64)), 32, 40)
    return features(spark, d).select("vec_id", z.alias("z")).select("vec_id", F.size("z").alias("width"), F.aggregate(F.transform("z", lambda v, i: (i + 1) * v), F.lit(0.0), lambda a, b: a + b).alias("checksum"))


WEIGHTS = [((i * 37) % 11 - 5) / 10.0 for i in range(64)]


@query(f"WITH {FEATURES}, z AS (SELECT vec_id, list_sum(list_transform(range(64), lambda i: x[i + 1] * {WEIGHTS!r}[i + 1])) AS z, list_sum(list_transform(range(64), lambda i: CASE WHEN i < 32 THEN x[i + 1] * {WEIGHTS!r}[i + 1] ELSE 0 END)) AS h FROM fv) SELECT vec_id, 1 / (1 + exp(-(z + 0.1))) AS score, 0.5 / (1 + exp(-(z + 0.1))) + 0.5 / (1 + exp(-h)) AS blended FROM z", ("score", "blended"))
def linear_score(spark, d):
    """A linear head's probability, and its blend with a sliced head."""
    w = F.array(*map(F.lit, WEIGHTS))
    p = scalars.sigmoid(scalars.dot(F.col("x"), w) + 0.1)
    q = scalars.sigmoid(scalars.dot(F.slice("x", 1, 32), F.slice(w, 1, 32)))
    return features(spark, d).select("vec_id", p.alias("score"), scalars.blend(p, q, 0.5).alias("blended"))


@query(f"WITH {LONG} SELECT pos, avg(v) AS mean, stddev_pop(v) AS std, sum(CASE WHEN y = 1 THEN 2.0 ELSE 1.0 END * v) / sum(CASE WHEN y = 1 THEN 2.0 ELSE 1.0 END) AS weighted_mean FROM lg GROUP BY pos", ("mean", "std", "weighted_mean"))
def scale_stats(spark, d):
    """Scaling statistics, plain and weighted."""
    f = features(spark, d)
    w = vectors.scale_stats(f, weight=F.when(F.col("y") == 1, 2.0).otherwise(1.0)).select("pos", F.col("mean").alias("weighted_mean"))
    return vectors.scale_stats(f).join(w, "pos").select("pos", "mean", "std", "weighted_mean")


@query(f"WITH {FEATURES} SELECT vec_id, sid, CASE WHEN sid = 2 THEN 5.0 ELSE 1.0 END::DOUBLE AS weight FROM fv")
def tampered_weights(spark, d):
    """A18."""
    return features(spark, d).select("vec_id", "sid", vectors.tampered_weight(F.col("sid")).alias("weight"))


@query(f"WITH {FEATURES} SELECT a.vec_id, max(abs(u - v)) AS drift FROM (SELECT vec_id, unnest(range(64)) AS pos, unnest(x) AS u FROM fv) a JOIN (SELECT vec_id, unnest(range(64)) AS pos, unnest(list_transform(range(64), lambda i: CASE WHEN i < 56 THEN x[i + 1] ELSE x[i + 1] + 0.001 * (vec_id % 3) END)) AS v FROM fv) b USING (vec_id, pos) WHERE pos >= 56 GROUP BY a.vec_id", ("drift",))
def prefix_drift(spark, d):
    """A prefix is unchanged, the rest has moved so far."""
    moved = F.transform("x", lambda v, i: F.when(i < 56, v).otherwise(v + 0.001 * (F.col("vec_id") % 3)))
    return features(spark, d).select("vec_id", integrity.max_drift(F.col("x"), moved, 56).alias("drift"))


# report tables: two matched models by condition; "view" plays the clean condition
AB_SQL = (
    f"WITH {SCORED}, {sql_ranked('sv', ['condition'], 'score_a', 'ra')}, {sql_ranked('sv', ['condition'], 'score_b', 'rb')}, "
    f"ab AS (SELECT CASE condition WHEN 'view' THEN 'clean' ELSE condition END AS transform, (row_number() OVER (ORDER BY condition) - 1)::INTEGER AS ord, b, a, y, x FROM (SELECT condition, {AUC} AS a, {ACC} AS x FROM ra GROUP BY condition) JOIN (SELECT condition, {AUC} AS b, {ACC} AS y FROM rb GROUP BY condition) USING (condition)), "
    "c AS (SELECT transform, ord, a AS auc_base, b AS auc_cand, b - a AS delta_auc, x AS acc_base, y AS acc_cand, y - x AS delta_acc, (b - 0.008 > a + 0.008 OR a - 0.008 > b + 0.008) AS ci_disjoint FROM ab)"
)
AB_COLUMNS = ("auc_base", "auc_cand", "delta_auc", "acc_base", "acc_cand", "delta_acc")


def _model(spark, d, score):
    """transform, ord, auc, acc of a model by condition."""
    t = metrics.robustness_table(scored_views(spark, d), ["condition"], score).select("condition", "auc", "acc")
    name = F.when(F.col("condition") == "view", "clean").otherwise(F.col("condition")).alias("transform")
    return t.select(name, (F.row_number().over(Window.orderBy("condition")) - 1).alias("ord"), "auc", "acc")  # one row a condition


def _ab(spark, d):
    side = lambda score: _model(spark, d, score).select("transform", "ord", "auc", (F.col("auc") - 0.008).alias("auc_lo"), (F.col("auc") + 0.008).alias("auc_hi"), "acc")
    return tables.compare(side("score_a"), side("score_b"))


@query(AB_SQL + " SELECT * FROM c", AB_COLUMNS)
def ab_compare(spark, d):
    """J1 D-8 W6: two models side by side, in the baseline's order."""
    return _ab(spark, d)


@query(
    AB_SQL + """ SELECT max(CASE WHEN transform = 'clean' THEN delta_auc END) AS clean_delta, avg(CASE WHEN transform <> 'clean' THEN delta_auc END) AS mean_delta, min(CASE WHEN transform <> 'clean' THEN auc_base END) AS worst_base, min(CASE WHEN transform <> 'clean' THEN auc_cand END) AS worst_cand,
 sum((ci_disjoint AND delta_auc > 0)::INT)::BIGINT AS n_gains, sum((ci_disjoint AND delta_auc < 0)::INT)::BIGINT AS n_losses, max_by(transform, delta_auc) FILTER (transform <> 'clean') AS best_row, min_by(transform, delta_auc) FILTER (transform <> 'clean') AS worst_row,
 CASE WHEN avg(CASE WHEN transform <> 'clean' THEN delta_auc END) > 0.002 THEN 'better' WHEN avg(CASE WHEN transform <> 'clean' THEN delta_auc END) < -0.002 THEN 'worse' ELSE 'level' END AS verdict FROM c""",
    ("clean_delta", "mean_delta", "worst_base", "worst_cand"),
)
def ab_summary(spark, d):
    """A21."""
    return tables.compare_summary(_ab(spark, d))


@query(AB_SQL + ", w AS (SELECT transform, auc_cand FROM c WHERE transform <> 'clean' ORDER BY auc_cand LIMIT 1) SELECT max(CASE WHEN c.transform = 'clean' THEN c.auc_cand END) AS clean_auc, avg(CASE WHEN c.transform <> 'clean' THEN c.auc_cand END) AS mean_auc, any_value(w.auc_cand) AS worst_auc, any_value(w.transform) AS worst_row, avg(CASE WHEN c.transform <> 'clean' THEN c.auc_cand END) - max(CASE WHEN c.transform = 'clean' THEN c.auc_cand END) AS mean_delta, any_value(w.auc_cand) - max(CASE WHEN c.transform = 'clean' THEN c.auc_cand END) AS worst_delta, avg(CASE WHEN c.transform <> 'clean' THEN c.acc_cand END) AS mean_tpr_at_1fpr FROM c, w", ("clean_auc", "mean_auc", "worst_auc", "mean_delta", "worst_delta", "mean_tpr_at_1fpr"))
def headline(spark, d):
    """A22 on the candidate (its accuracy stands in for the TPR column)."""
    return tables.headline(_ab(spark, d).select("transform", F.col("auc_cand").alias("auc"), F.col("acc_cand").alias("tpr_at_1fpr")))


def _parts(spark, d):
    base, cand = _model(spark, d, "score_a"), _model(spark, d, "score_b")
    first = base.filter("ord < 3").select("transform", F.col("ord").alias("row"), "auc")  # an old shard, without acc
    second = cand.filter("ord >= 2 AND ord < 4").select("transform", F.col("ord").alias("row"), "auc", "acc")
    return tables.merge_shards([first, second], base.select(F.col("transform").alias("name"), "ord"))


@query(AB_SQL + " SELECT transform, ord, CASE WHEN ord >= 2 THEN b ELSE a END AS auc, CASE WHEN ord >= 2 THEN y END AS acc FROM ab WHERE ord < 4", ("auc", "acc"))
def merge_shards_complete(spark, d):
    """The last shard wins, old columns are blank, the registry gives the order."""
    return _parts(spark, d)[0].select("transform", "ord", "auc", "acc")


@query(AB_SQL + " SELECT transform, ord FROM ab WHERE ord >= 4")
def merge_shards_missing(spark, d):
    """What the registry has and the shards lack."""
    return _parts(spark, d)[1].select("transform", "ord")


ABL = f"{SCORED}, hd AS (SELECT condition AS transform, head, avg(CASE head WHEN 'h1' THEN score_a WHEN 'h2' THEN score_b ELSE (score_a + score_b) / 2 END) AS auc FROM sv, (VALUES ('h1'), ('h2'), ('h3')) h(head) GROUP BY ALL)"


def _heads(spark, d):
    h = F.explode(F.create_map(F.lit("h1"), F.col("score_a"), F.lit("h2"), F.col("score_b"), F.lit("h3"), (F.col("score_a") + F.col("score_b")) / 2)).alias("head", "s")
    return scored_views(spark, d).select(F.col("condition").alias("transform"), h).groupBy("transform", "head").agg(F.avg("s").alias("auc"))


@query(f"WITH {ABL}, n AS (SELECT * REPLACE (CASE transform WHEN 'view' THEN 'clean' ELSE transform END AS transform) FROM hd) SELECT head, avg(auc) AS mean_auc, min_by(transform, auc) AS worst_row, min(auc) AS worst_auc, count(*) AS n_rows FROM n WHERE transform <> 'clean' GROUP BY head", ("mean_auc", "worst_auc"))
def ablation_matrix(spark, d):
    """Heads against conditions."""
    rows = _heads(spark, d).withColumn("transform", F.when(F.col("transform") == "view", "clean").otherwise(F.col("transform"))).withColumn("ord", F.lit(0))
    return tables.ablation_matrix(rows)


@query(f"WITH {ABL}, p AS (SELECT * FROM hd WHERE NOT (transform = 'click' AND head = 'h2') AND transform <> 'view') SELECT t.transform, h.head FROM (SELECT DISTINCT transform FROM p) t, (VALUES ('h1'), ('h2'), ('h3')) h(head) WHERE (t.transform, h.head) NOT IN (SELECT (transform, head) FROM p)")
def ablation_missing_cells(spark, d):
    """Cells missing for conditions that occur."""
    rows = _heads(spark, d).filter("NOT (transform = 'click' AND head = 'h2') AND transform <> 'view'")
    return tables.missing_cells(rows, ["h1", "h2", "h3"])


@query(f"WITH {ABL} SELECT a.head, a.transform, a.auc, b.auc AS control, a.auc - b.auc AS delta FROM hd a JOIN hd b ON a.head = b.head AND b.transform = 'view' WHERE a.transform <> 'view'", ("auc", "control", "delta"))
def leakage_deltas(spark, d):
    """A23."""
    return tables.deltas_to(_heads(spark, d), "head", "transform", "view")


SHARDS = "sh AS (SELECT doc_id // 50 AS k, min(doc_id) - CASE WHEN (doc_id // 50) % 5 = 2 THEN 3 ELSE 0 END AS start, count(*) AS n FROM documents WHERE doc_id % 350 <> 75 GROUP BY doc_id // 50)"


@query(f"WITH {SHARDS}, s AS (SELECT start, coalesce(lag(start + n) OVER (ORDER BY start, n), 0) AS expected FROM sh), e AS (SELECT max(start + n) AS start, (SELECT max(doc_id) + 101 FROM documents) AS expected FROM sh) SELECT start::BIGINT AS start, expected::BIGINT AS expected, CASE WHEN start > expected THEN 'gap' ELSE 'overlap' END AS problem FROM s WHERE start <> expected UNION ALL SELECT start::BIGINT, expected::BIGINT, 'short' FROM e WHERE start <> expected")
def shard_gap_check(spark, d):
    """Documents in shards of 50; some begin too early, some lack a row, and the last ones are missing."""
    docs = table(spark, d, "documents")
    k = F.floor(F.col("doc_id") / 50)
    shards = docs.filter("doc_id % 350 <> 75").groupBy(k.alias("k")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    shards = shards.select((F.col("least") - F.when(F.col("k") % 5 == 2, 3).otherwise(0)).alias("start"), "rows")
    return tables.shard_gaps(shards, docs.agg(F.max("doc_id") + 101).first()[0])


# integrity


RECEIPT = "e AS (SELECT doc_id AS path, sha256(text) AS sha256 FROM documents WHERE doc_id % 17 <> 0), a AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 29 = 0 THEN text || '!' ELSE text END) AS sha256 FROM documents WHERE doc_id % 23 <> 0)"


@query(f"WITH {RECEIPT} SELECT coalesce(e.path, a.path) AS path, e.sha256 AS expected, a.sha256 AS actual, CASE WHEN a.sha256 IS NULL THEN 'missing' WHEN e.sha256 IS NULL THEN 'unexpected' ELSE 'changed' END AS problem FROM e FULL JOIN a ON e.path = a.path WHERE e.sha256 IS DISTINCT FROM a.sha256")
def receipt_check(spark, d):
    """J10 V6 V7."""
    docs = table(spark, d, "documents")
    expected = docs.filter("doc_id % 17 <> 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    actual = docs.filter("doc_id % 23 <> 0").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 29 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return integrity.receipt_mismatches(expected, actual)


SOURCE_SQL = """f AS (SELECT doc_id AS i, CASE WHEN doc_id % 41 = 0 THEN '../' ELSE 'src/' END || doc_id::VARCHAR AS path, sha256(coalesce(text, '')) AS sha FROM documents), p AS (SELECT path, i, sha, 'old/' || i::VARCHAR AS snap FROM f)"""


@query(f"""WITH {SOURCE_SQL} SELECT path, CASE WHEN i % 41 = 0 THEN 'outside' WHEN i % 13 = 0 THEN 'missing' WHEN i % 11 = 0 THEN 'changed' WHEN i % 3 > 0 THEN 'current' WHEN i % 7 = 0 THEN 'unrecorded' WHEN i % 5 = 0 THEN 'snapshot missing' WHEN i % 2 = 0 THEN 'snapshot changed' ELSE 'archived' END AS status FROM p""")
def source_status(spark, d):
    """V7: texts as sources; every third has changed since its receipt and has a snapshot; each fault occurs."""
    i = F.col("i")
    f = table(spark, d, "documents").select(F.col("doc_id").alias("i"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    f = f.withColumns({"path": F.concat(F.when(i % 41 == 0, "../").otherwise("src/"), i.cast("string")), "snap": F.concat(F.lit("old/"), i.cast("string")), "was": F.sha2("sha", 256)})
    receipts = f.select("path", F.when(i % 3 > 0, F.col("sha")).when(i % 7 == 0, F.lit("another")).otherwise(F.col("was")).alias("sha256"))
    registry = f.filter(i % 3 == 0).select("path", F.col("sha").alias("current"), F.col("was").alias("archived"), F.col("snap").alias("snapshot"))
    now = f.filter(i % 13 > 0).select("path", F.when(i % 11 == 0, F.lit("edited")).otherwise(F.col("sha")).alias("sha256"))
    kept = f.filter((i % 3 == 0) & (i % 5 > 0)).select(F.col("snap").alias("path"), F.when(i % 2 == 0, F.lit("edited")).otherwise(F.col("was")).alias("sha256"))
    return integrity.source_status(receipts, registry, now.unionByName(kept))


@query(f"WITH {SCORED}, o AS (SELECT grp, condition, score_a, CASE WHEN grp % 13 = 0 THEN score_a + 0.1 ELSE score_a END AS b FROM sv) SELECT grp, condition, score_a AS a, b FROM o WHERE score_a IS DISTINCT FROM b", ("a", "b"))
def packaging_equality(spark, d):
    """Scores that a packaged model changes."""
    sv = scored_views(spark, d)
    other = sv.withColumn("score_a", F.when(F.col("grp") % 13 == 0, F.col("score_a") + 0.1).otherwise(F.col("score_a")))
    return integrity.packaging_mismatches(sv, other, ["grp", "condition"], "score_a")


@query(f"WITH {SCORED}, c AS (SELECT * FROM sv WHERE NOT (grp % 10 = 0 AND condition = 'click')) SELECT grp, count(*) AS n_rows, count(DISTINCT condition) AS n_conditions FROM c GROUP BY grp HAVING count(*) <> 5 OR count(DISTINCT condition) <> 5")
def grid_check(spark, d):
    """Originals without every condition."""
    return integrity.grid_problems(scored_views(spark, d).filter("NOT (grp % 10 = 0 AND condition = 'click')"), "grp", "condition", 5)


@query(f"WITH {MANIFEST} SELECT doc_id, sha, sha256(CASE WHEN doc_id % 31 = 0 THEN sha ELSE 'x' END) AS frozen FROM mf WHERE doc_id % 31 = 0")
def identity_check(spark, d):
    """Records whose content isn't the frozen one."""
    m = manifest(spark, d).withColumn("frozen", F.when(F.col("doc_id") % 31 == 0, F.sha2("sha", 256)).otherwise(F.col("sha")))
    return identity.identity_mismatches(m, "frozen", F.col("sha")).select("doc_id", "sha", "frozen")


@query("SELECT item_id, sha1(item_id::VARCHAR) AS revision, '{\"a\":\"' || sha1(item_id::VARCHAR) || '\",\"b\":\"' || repeat('0', 40) || '\"}' AS snapshots_json, sha256('v4' || chr(10) || sha256(text) || chr(10) || '{\"a\":\"' || sha1(item_id::VARCHAR) || '\",\"b\":\"' || repeat('0', 40) || '\"}') AS fingerprint, true AS valid FROM benchmark")
def feature_fingerprints(spark, d):
    """Versions of features by content and encoder revisions."""
    b = table(spark, d, "benchmark").withColumn("revision", F.sha1(F.col("item_id").cast("string")))
    m = F.create_map(F.lit("b"), F.repeat(F.lit("0"), 40), F.lit("a"), F.col("revision"))
    return integrity.versioned(b, "v4", F.sha2("text", 256), m).select("item_id", "revision", "snapshots_json", "fingerprint", integrity.valid_snapshots(m).alias("valid"))


@query("SELECT doc_id, n_chars, regexp_replace(printf('%.4f', n_chars / 7919.0), '', '') AS shown, round((n_chars / 7919.0)::DECIMAL(18, 10), 4)::DOUBLE AS half_up FROM documents")
def fixed_point_text(spark, d):
    """Fixed-point text and decimal rounding."""
    v = F.col("n_chars") / F.lit(7919.0)
    return table(spark, d, "documents").select("doc_id", "n_chars", F.format_string("%.4f", v).alias("shown"), scalars.half_up(v, 4).cast("double").alias("half_up"))


@query(f"WITH {MANIFEST} SELECT doc_id, role FROM mf WHERE role = 'test' AND sha IN (SELECT sha FROM mf WHERE doc_id % 2 = 0)")
def allowed_rows(spark, d):
    """A split restricted to an allow-list; a list that can't be read fails instead of letting all through."""
    m = manifest(spark, d)
    return m.filter("role = 'test'").join(m.filter("doc_id % 2 = 0").select("sha"), "sha", "left_semi").select("doc_id", "role")


@query(f"WITH {MANIFEST} SELECT doc_id, domain, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ord) AS rank FROM mf) WHERE rank <= 15")
def first_per_label(spark, d):
    """S10 W5 A19."""
    return sampling.first_n(manifest(spark, d), ["domain"], ["ord"], 15).select("doc_id", "domain", "rank")


@query("SELECT doc_id, (doc_id // 4)::BIGINT AS source_group FROM documents ORDER BY doc_id DESC LIMIT 48")
def tail_rows(spark, d):
    """The last rows, and row to source group."""
    return table(spark, d, "documents").orderBy(F.desc("doc_id")).limit(48).select("doc_id", F.floor(F.col("doc_id") / 4).cast("long").alias("source_group"))

"""How queries are registered: a function and, where SQL can express it, SQL; doubles are rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 6

SCORED = """sv AS (SELECT grp, condition, CASE WHEN grp % 2 = 0 THEN 'even' ELSE 'odd' END AS domain, sid, y, (a + 60 * y) / (a + 60 * y + 50) AS score_a, (b + 3 * y) / (b + 3 * y + 50) AS score_b
FROM (SELECT user_id AS grp, event_type AS condition, (user_id % 3)::INTEGER AS sid, CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 END AS y, max(value) AS a, min(value) AS b FROM events GROUP BY ALL))"""
LARGE = """lv AS (SELECT grp, condition, sid, y, (a + 20000 * y) / (a + 20000 * y + 50000) AS score_a
FROM (SELECT l_orderkey AS grp, l_returnflag || '_' || l_linestatus AS condition, (l_orderkey % 3)::INTEGER AS sid, CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE 1 END AS y, max(l_extendedprice) AS a FROM lineitem GROUP BY ALL))"""
FEATURES = """fv AS (SELECT vec_id, (vec_id // 4)::BIGINT AS grp, (vec_id % 4)::INTEGER AS view_idx, (['clean', 'jpeg', 'blur', 'resize'])[vec_id % 4 + 1] AS condition, ((vec_id // 4) % 3)::INTEGER AS sid, CASE WHEN (vec_id // 4) % 3 = 0 THEN 0 ELSE 1 END AS y, embedding::DOUBLE[] AS x FROM embeddings)"""


def sql_hash(seed: str, key: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}::VARCHAR), 1, 15))::BIGINT"


MANIFEST = f"""mf AS (SELECT doc_id, doc_id AS ord, sha256(text) AS sha, lang AS domain, source AS model, (doc_id % 3)::INTEGER AS sid,
CASE WHEN {sql_hash('role', 'doc_id')} % 10 < 6 THEN 'train' WHEN {sql_hash('role', 'doc_id')} % 10 < 7 THEN 'cal' WHEN {sql_hash('role', 'doc_id')} % 10 < 8 THEN 'dev' ELSE 'test' END AS role FROM documents)"""


def sql_values(name: str, columns: list[str], rows) -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
    return f"{name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"


def sql_ranked(rel: str, keys: list[str], score: str, out: str = "rk", weight: str = "1", y: str = "y") -> str:
    """CTEs that end in `out`: per (keys, s) p, n, nb, pb (below) and pa, na (all)."""
    k = ", ".join(keys)
    part = f"PARTITION BY {k}" if keys else ""
    below = f"OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    lead = f"{k}, " if keys else ""
    return (
        f"{out}_h AS (SELECT {lead}{score} AS s, sum(CASE WHEN {y} = 1 THEN {weight} ELSE 0 END)::BIGINT AS p, sum(CASE WHEN {y} = 0 THEN {weight} ELSE 0 END)::BIGINT AS n FROM {rel} WHERE {score} IS NOT NULL GROUP BY {lead}{score}), "
        f"{out} AS (SELECT *, coalesce(sum(n) {below}, 0)::BIGINT AS nb, coalesce(sum(p) {below}, 0)::BIGINT AS pb, (sum(p) OVER ({part}))::BIGINT AS pa, (sum(n) OVER ({part}))::BIGINT AS na FROM {out}_h)"
    )


AUC = "CASE WHEN any_value(pa) > 0 AND any_value(na) > 0 THEN sum(p * (2 * nb + n))::DOUBLE / (2.0 * any_value(pa)::DOUBLE * any_value(na)) END"
ACC = "sum(CASE WHEN s >= 0.5 THEN p ELSE n END)::DOUBLE / sum(p + n)"


def sql_tpr(target: float) -> str:
    return f"CASE WHEN any_value(pa) > 0 AND any_value(na) > 0 THEN coalesce(max(CASE WHEN (na - nb) / na::DOUBLE <= {target} THEN (pa - pb) / pa::DOUBLE END), 0.0) END"


def sql_fpr(target: float) -> str:
    return f"CASE WHEN any_value(pa) > 0 AND any_value(na) > 0 THEN min(CASE WHEN (pa - pb) / pa::DOUBLE >= {target} THEN (na - nb) / na::DOUBLE END) END"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, doubles: tuple[str, ...] = (), digits: int = DIGITS):
    """Register a function under its name; doubles are rounded to `digits` places in both forms."""

    def keep(f):
        def run(spark, sf_dir):
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in doubles}) if doubles else df

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            cut = ", ".join(f"round({c}::DOUBLE, {digits}) + 0.0 AS {c}" for c in doubles)
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({cut}) FROM ({sql})" if doubles else sql
        return f

    return keep

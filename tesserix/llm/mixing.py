"""Operator 1: mix sources to target weights by iterative proportional fitting, in DataFrame expressions only.

Tokens are counted per cell (source x language x topic). Raking scales the cells' token weights until every marginal has its
target share. A document's weight per token is its cell's raked tokens over its cell's tokens; one factor turns weights into
probabilities, capped at 1, that keep the asked share of all tokens in expectation; a hash of doc_id and text decides.

Null source, lang or text: levels "(null)" and an empty text. Empty texts hold no tokens and weigh 0, so they aren't kept.
Texts of any length are counted whole. Rows with equal doc_id and text get equal decisions, all others (null doc_ids too) their own. An empty table gives an empty result. Other columns pass through mix_filter
whatever their names; names beginning with __mx_ are reserved and refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserix.runtime import checked_side, forget, saved

WORD = r"[^ \t\n\r\f\x0B]+"
DIMS = ("source", "lang", "topic")
#: A number is the exponent of a level's own share; a mapping names shares (other levels have their own share).
TARGETS = {"source": 0.5, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, "topic": 0.7}
KEEP = 0.7
ROUNDS = 10
FILL_ROUNDS = 8
SEED = "mix-1"
#: Cells up to this number are raked in one task and broadcast; more are raked by their levels and joined by a shuffle, with the same result.
MOST_CELLS = 50_000


def _occurrences(text: Column, signs: str) -> Column:
    """How often any of the characters occurs: lengths before and after removing each, which copies no text without it."""
    return sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in signs), F.lit(0))


def n_tokens(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def topic(text: Column, tokens: Column) -> Column:
    """A coarse topic from the text's form; another column can take its place."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(tokens == 0, "empty").when(_occurrences(t, "|") * 20 >= tokens, "table").when(_occurrences(t, "%*&$#@") * 5 >= tokens, "markup")
        .when(tokens < 100, "note").when(tokens < 600, "article").otherwise("report")
    )


def _annotated(docs: DataFrame) -> DataFrame:
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(null)"))
    return (
        docs.withColumn("__mx_source", level("source")).withColumn("__mx_lang", level("lang"))
        .withColumn("__mx_tokens", n_tokens(F.col("text"))).withColumn("__mx_topic", topic(F.col("text"), F.col("__mx_tokens")))
    )


def _share(dim: str, target) -> Column:
    """The unnormalised target of a row's level, given __own, the level's own share."""
    if isinstance(target, (int, float)):
        return F.pow(F.col("__own"), F.lit(float(target)))
    out = F.when(F.lit(False), F.lit(0.0))
    for k, v in target.items():
        out = out.when(F.col(f"__mx_{dim}") == k, F.lit(float(v)))
    return out.otherwise(F.col("__own"))


def rake_by_levels(cells: DataFrame, targets=None, keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """The same as rake() for any number of cells (a source may be a domain): levels' sums are pre-aggregated and joined back, and no
    task sees all cells. Each round's weights are written to the shared folder."""
    targets, spark = targets or TARGETS, cells.sparkSession
    names = [f"__mx_{d}" for d in DIMS]
    c = cells.filter("tokens > 0").select(*names, "tokens", F.col("tokens").cast("double").alias("weight"))
    total = float(c.agg(F.sum("tokens")).first()[0] or 0)

    def by_level(rows: DataFrame, name: str, joined: DataFrame) -> DataFrame:
        return joined.join(checked_side(rows, "mix-levels", MOST_CELLS), name)

    for d, name in zip(DIMS, names, strict=True):
        levels = c.groupBy(name).agg((F.sum("tokens") / total).alias("__own")).withColumn("__raw", _share(d, targets[d]))
        norm = float(levels.agg(F.sum("__raw")).first()[0] or 1)
        c = by_level(levels.select(name, (F.col("__raw") / norm * total).alias(f"__t_{d}")), name, c)
    c = saved(c, "mix-weights")
    for _ in range(rounds):
        for d, name in zip(DIMS, names, strict=True):
            sums = c.groupBy(name).agg(F.sum("weight").alias("__sum"))
            after = by_level(sums, name, c).withColumn("weight", F.col("weight") * F.col(f"__t_{d}") / F.col("__sum")).drop("__sum")
            after, before = saved(after, "mix-weights"), c
            forget(spark, before)
            c = after
    c = c.withColumn("ratio", F.col("weight") / F.col("tokens"))
    budget = keep * total
    factor = budget / float(c.agg(F.sum("weight")).first()[0] or 1)
    for _ in range(FILL_ROUNDS):
        full = factor * F.col("ratio") >= 1
        r = c.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        factor = max(factor, (budget - r["full"]) / r["open"]) if r["open"] else factor
    return c.withColumn("prob", F.least(F.lit(1.0), F.lit(factor) * F.col("ratio"))).select(*names, "tokens", "weight", "ratio", "prob")


def marginal_gaps(raked: DataFrame, targets=None) -> DataFrame:
    """dim, level, share, target, gap of raked cells: how far each marginal is from its target after the rounds."""
    targets, out = targets or TARGETS, None
    total = raked.agg(F.sum("tokens").cast("double").alias("__all"), F.sum("weight").alias("__mass"))
    for d in DIMS:
        levels = raked.groupBy(f"__mx_{d}").agg(F.sum("tokens").alias("__t"), F.sum("weight").alias("__w")).crossJoin(total)
        levels = levels.withColumn("__own", F.col("__t") / F.col("__all")).withColumn("__raw", _share(d, targets[d]))
        levels = levels.crossJoin(levels.agg(F.sum("__raw").alias("__norm")))
        one = levels.select(F.lit(d).alias("dim"), F.col(f"__mx_{d}").alias("level"), (F.col("__w") / F.col("__mass")).alias("share"), (F.col("__raw") / F.col("__norm")).alias("target"))
        out = one if out is None else out.union(one)
    return out.withColumn("gap", F.abs(F.col("share") - F.col("target")))


def rake(cells: DataFrame, targets=None, keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """cells (__mx_<dim>..., tokens) with weight (raked tokens), ratio and prob.

    For up to MOST_CELLS cells: they are put in one partition, so that the windows need no shuffle. More go to rake_by_levels().
    """
    targets = targets or TARGETS
    by = {d: Window.partitionBy(f"__mx_{d}") for d in DIMS}
    every = Window.partitionBy()
    c = cells.filter("tokens > 0").coalesce(1).withColumn("__all", F.sum("tokens").over(every).cast("double"))
    for d in DIMS:
        c = c.withColumn("__own", F.sum("tokens").over(by[d]) / F.col("__all")).withColumn("__raw", _share(d, targets[d]))
        # each level counts once in the normaliser
        c = c.withColumn("__n", F.count(F.lit(1)).over(by[d]))
        c = c.withColumn(f"__t_{d}", F.col("__raw") / F.sum(F.col("__raw") / F.col("__n")).over(every))
    c = c.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for d in DIMS:
            c = c.withColumn("weight", F.col("weight") * F.col(f"__t_{d}") * F.col("__all") / F.sum("weight").over(by[d]))
    c = c.withColumn("ratio", F.col("weight") / F.col("tokens"))
    budget = F.lit(float(keep)) * F.col("__all")
    c = c.withColumn("__c", budget / F.sum("weight").over(every))
    for _ in range(FILL_ROUNDS):
        full = F.col("__c") * F.col("ratio") >= 1
        c = c.withColumn("__full", F.sum(F.when(full, F.col("tokens")).otherwise(0)).over(every)).withColumn("__open", F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).over(every))
        c = c.withColumn("__c", F.when(F.col("__open") > 0, F.greatest(F.col("__c"), (budget - F.col("__full")) / F.col("__open"))).otherwise(F.col("__c")))
    c = c.withColumn("prob", F.least(F.lit(1.0), F.col("__c") * F.col("ratio")))
    return c.select(*[f"__mx_{d}" for d in DIMS], "tokens", "weight", "ratio", "prob")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on seed, doc_id and text alone: rows without an identifier, or that share one, are drawn by their texts."""
    text = F.md5(F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8"))
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text)
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _with_prob(docs: DataFrame, targets, keep: float) -> DataFrame:
    if clash := [c for c in docs.columns if c.startswith("__mx_")]:
        raise ValueError(f"names beginning with __mx_ are reserved: {clash}")
    spark, rows = docs.sparkSession, _annotated(docs)
    names = [f"__mx_{d}" for d in DIMS]
    counted = saved(rows.groupBy(*names).agg(F.sum("__mx_tokens").alias("tokens")), "mix-cells")
    few = counted.count() <= MOST_CELLS
    raked = saved((rake if few else rake_by_levels)(counted, targets, keep).select(*names, F.col("ratio").alias("__mx_ratio"), F.col("prob").alias("__mx_prob")), "mix-raked")
    forget(spark, counted)
    side = F.broadcast(raked) if few else raked
    return (
        rows.join(side, names, "left").withColumn("__mx_ratio", F.coalesce("__mx_ratio", F.lit(0.0))).withColumn("__mx_prob", F.coalesce("__mx_prob", F.lit(0.0)))
        .withColumn("__mx_kept", draw(F.col("doc_id"), F.col("text")) < F.col("__mx_prob"))
    )


def mix_weights(docs: DataFrame, targets=None, keep: float = KEEP) -> DataFrame:
    """One row per document: its levels, tokens, calibrated weight per token, probability and decision."""
    return _with_prob(docs, targets, keep).select(
        "doc_id", F.col("__mx_source").alias("source"), F.col("__mx_lang").alias("lang"), F.col("__mx_topic").alias("topic"), F.col("__mx_tokens").alias("n_tokens"),
        F.round("__mx_ratio", 6).alias("weight"), F.round("__mx_prob", 6).alias("keep_prob"), F.col("__mx_kept").alias("kept"),
    )


def mix_filter(docs: DataFrame, targets=None, keep: float = KEEP) -> DataFrame:
    """The sampled documents, with the columns of docs."""
    return _with_prob(docs, targets, keep).filter("__mx_kept").select(*docs.columns)


def mix_sql(table: str = "documents", keep: float = KEEP, rounds: int = ROUNDS) -> str:
    """The same in SQL for DuckDB, rounds written out."""
    count = lambda signs: " + ".join(f"length(t) - length(replace(t, chr({ord(c)}), ''))" for c in signs)
    parts = [
        f"a AS (SELECT doc_id, coalesce(text, '') t, coalesce(source, '(null)') source, coalesce(lang, '(null)') lang, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT n_tokens FROM {table})",
        f"b AS (SELECT *, CASE WHEN n_tokens = 0 THEN 'empty' WHEN ({count('|')}) * 20 >= n_tokens THEN 'table' WHEN ({count('%*&$#@')}) * 5 >= n_tokens THEN 'markup' WHEN n_tokens < 100 THEN 'note' WHEN n_tokens < 600 THEN 'article' ELSE 'report' END topic FROM a)",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE tokens, sum(sum(n_tokens)) OVER ()::DOUBLE total FROM b GROUP BY source, lang, topic HAVING sum(n_tokens) > 0)",
    ]
    last = "c"
    for d in DIMS:
        t = TARGETS[d]
        own = f"(sum(tokens) OVER (PARTITION BY {d}) / total)"
        raw = f"pow({own}, {float(t)})" if isinstance(t, (int, float)) else "CASE " + " ".join(f"WHEN {d} = '{k}' THEN {float(v)}" for k, v in t.items()) + f" ELSE {own} END"
        parts += [f"r_{d} AS (SELECT *, {raw} raw_{d}, count(*) OVER (PARTITION BY {d}) n_{d} FROM {last})", f"t_{d} AS (SELECT *, raw_{d} / sum(raw_{d} / n_{d}) OVER () AS share_{d} FROM r_{d})"]
        last = f"t_{d}"
    parts.append(f"w0 AS (SELECT source, lang, topic, tokens, total, share_source, share_lang, share_topic, tokens w FROM {last})")
    n = 0
    for _ in range(rounds):
        for d in DIMS:
            parts.append(f"w{n + 1} AS (SELECT * REPLACE (w * share_{d} * total / sum(w) OVER (PARTITION BY {d}) AS w) FROM w{n})")
            n += 1
    parts.append(f"f0 AS (SELECT source, lang, topic, tokens, total, w, w / tokens ratio, {keep} * total / sum(w) OVER () c FROM w{n})")
    for i in range(FILL_ROUNDS):
        parts.append(f"g{i} AS (SELECT *, sum(CASE WHEN c * ratio >= 1 THEN tokens ELSE 0 END) OVER () closed, sum(CASE WHEN c * ratio >= 1 THEN 0 ELSE w END) OVER () opened FROM f{i})")
        parts.append(f"f{i + 1} AS (SELECT source, lang, topic, tokens, total, w, ratio, CASE WHEN opened > 0 THEN greatest(c, ({keep} * total - closed) / opened) ELSE c END c FROM g{i})")
    parts.append(f"p AS (SELECT source, lang, topic, ratio, least(1.0, c * ratio) prob FROM f{FILL_ROUNDS})")
    return (
        "WITH " + ", ".join(f"{x.split(' AS ', 1)[0]} AS MATERIALIZED {x.split(' AS ', 1)[1]}" for x in parts)
        + f" SELECT b.doc_id, b.source, b.lang, b.topic, b.n_tokens, round(coalesce(p.ratio, 0), 6) weight, round(coalesce(p.prob, 0), 6) keep_prob,"
        f" ('0x' || substr(md5('{SEED}:' || coalesce(b.doc_id::VARCHAR, '') || ':' || md5(b.t)), 1, 13))::BIGINT / {float(1 << 52)!r} < coalesce(p.prob, 0) kept"
        " FROM b LEFT JOIN p ON b.source = p.source AND b.lang = p.lang AND b.topic = p.topic"
    )

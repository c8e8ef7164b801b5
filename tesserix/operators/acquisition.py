"""First-come acceptance: rows are taken in order, near copies of accepted rows and rows beyond a capacity are not.

The rule is sequential (a row's fate depends on those of all rows before it), but it is decided in parallel rounds that give the sequential outcome:

- a row is refused as soon as an accepted row before it is near, or one of its groups is full;
- a row is sure of its places if in each of its groups at most `cap` rows that aren't refused stand up to it. A sure row without undecided near rows before it is accepted;
- a sure row that waits for one near row alone is the opposite of that row. Such dependencies are followed to their ends by pointer doubling, so that a chain
  of n near rows takes about log2 n rounds.

All accepted rows of a group stand among its first `cap` that aren't refused, so when `cap` are accepted every undecided row comes later, and is refused. Ranks are
limited before the shuffle: a group sends `cap` rows a task, however many it has. Near rows are told by hash: rows of one hash are summed up as their
smallest accepted and two smallest undecided ids.

Where there are limits, rounds go over blocks of rows, in their order: what comes later changes nothing for a block, and rows of a group that is full by then are refused without
rounds and without their near rows. Blocks grow fourfold, so groups that never fill take some log4 n of them, and all blocks together hold each row once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserix.runtime import forget, saved


def _first(df: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """The first rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("rank") <= most)


def _near_before(state: DataFrame, near: DataFrame) -> DataFrame:
    """Per hash: the smallest accepted and the two smallest undecided ids among all rows whose hash is near."""
    undecided = _first(state.filter("accepted is null").select("h", "id"), ["h"], "id", 2).select("h", "id", F.lit(True).alias("open"))
    accepted = state.filter("accepted").groupBy("h").agg(F.min("id").alias("id")).select("h", "id", F.lit(False).alias("open"))
    # what each hash hears from the hashes near it; ranks limit it to two undecided rows and an accepted one before the shuffle
    heard = near.join(undecided.unionByName(accepted).withColumnRenamed("h", "b").hint("merge"), "b").select(F.col("a").alias("h"), "id", "open")
    heard = _first(heard, ["h", "open"], "id", 2)
    at = lambda is_open, rank: F.min(F.when((F.col("open") == is_open) & (F.col("rank") == rank), F.col("id")))
    return heard.groupBy("h").agg(at(False, 1).alias("taken"), at(True, 1).alias("one"), at(True, 2).alias("two"))


#: Rows of the first block; each later one has four times as many.
BLOCK_ROWS = 20_000
#: Sampled rows that tell where a block ends.
CUT_ROWS = 1_000


def accept_in_order(rows: DataFrame, near: DataFrame | Callable[[DataFrame], DataFrame], limits: list[tuple[list[str], int]] = (), rounds: list[int] | None = None) -> DataFrame:
    """rows (id, h, columns of limits, and perhaps accepted for rows decided before) with accepted, in the order of id.

    h: the row's hash, or whatever stands for it; near: pairs (a, b) of different hashes that are near, in any direction, or what gives those among some hashes (h); rows of equal h are near.
    limits: (columns, cap): at most cap accepted rows for each value of the columns. rounds: gets the number of rounds."""
    own, n = [c for c in rows.columns if c != "accepted"], []
    start = F.col("accepted") if "accepted" in rows.columns else F.lit(None).cast("boolean")
    rows = saved(rows.select(*own, start.alias("accepted")), "accept-rows")
    if limits:
        out = _in_blocks(rows, near, limits, n)
    else:
        out = _in_rounds(rows, near(rows.select("h").distinct()) if callable(near) else near, limits, n)
    forget(rows.sparkSession, rows)
    if rounds is not None:
        rounds.append(sum(n))
    return out


def _open(rows: DataFrame, taken: DataFrame, limits: list[tuple[list[str], int]]) -> DataFrame:
    """Undecided rows whose groups aren't full."""
    rows = rows.filter("accepted is null")
    for columns, cap in limits:
        rows = rows.join(taken.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= cap), columns, "left_anti")
    return rows


def _in_blocks(rows: DataFrame, near: DataFrame | Callable[[DataFrame], DataFrame], limits: list[tuple[list[str], int]], rounds: list[int]) -> DataFrame:
    """accept_in_order() block by block: the open rows up to an id, with all that were accepted before them. Where a block ends changes its size alone."""
    spark, own, size = rows.sparkSession, rows.columns, BLOCK_ROWS
    taken, rest = saved(rows.filter("accepted"), "accept-taken"), saved(_open(rows, rows.filter("accepted"), limits), "accept-rest")
    pairs = None if callable(near) else saved(near.select("a", "b"), "accept-pairs")
    while n := rest.count():
        block, cut = rest, None
        if n > size:
            # some CUT_ROWS of a block's rows are in the sample; written, so that it is drawn once
            cut = saved(rest.select("id").sample(min(1.0, CUT_ROWS / size), seed=0).orderBy("id").limit(CUT_ROWS).agg(F.max("id").alias("cut")), "accept-cut", 1)
            block = rest.join(F.broadcast(cut), F.col("id") <= F.col("cut"))  # one row
        block = saved(block.select(*own).unionByName(taken), "accept-block")
        hashes = block.select("h").distinct()
        of_block = near(hashes) if callable(near) else pairs.join(hashes.withColumnRenamed("h", "a"), "a", "left_semi").join(hashes.withColumnRenamed("h", "b"), "b", "left_semi")
        found = _in_rounds(block, of_block, limits, rounds)
        done = [block, taken, rest, found]
        taken = saved(found.filter("accepted").select(*own), "accept-taken")
        # rows of a block are all decided: what is left comes after it
        later = rest.filter("false") if cut is None else rest.join(F.broadcast(cut), F.col("id") > F.col("cut")).select(*own)
        rest, size = saved(_open(later, taken, limits), "accept-rest"), 4 * size
        for t in done + ([] if cut is None else [cut]):
            forget(spark, t)
    # no open row is left: what isn't accepted was refused in its block, or is in a full group
    told = rows.join(taken.select("id", F.lit(True).alias("taken")), "id", "left")
    out = saved(told.select(*[c for c in own if c != "accepted"], F.coalesce("accepted", "taken", F.lit(False)).alias("accepted")), "accept-state")
    for t in (taken, rest, *([] if pairs is None else [pairs])):
        forget(spark, t)
    return out


def _in_rounds(rows: DataFrame, near: DataFrame, limits: list[tuple[list[str], int]], rounds: list[int]) -> DataFrame:
    """accept_in_order() of all rows at once."""
    spark, columns = rows.sparkSession, [c for c in rows.columns if c != "accepted"]
    kind = rows.schema["id"].dataType
    state = saved(rows.withColumns({"parent": F.lit(None).cast(kind), "flip": F.lit(False)}), "accept-state")
    hashes = near.select("a", "b").union(near.select("b", "a")).union(rows.select(F.col("h").alias("a"), F.col("h").alias("b")))
    hashes, n = saved(hashes.distinct(), "accept-near"), 0
    while state.filter("accepted is null").limit(1).count():
        n += 1
        # what grows with the rows is merged where it lies: broadcasts of every round would add up on the driver
        heard = state.join(_near_before(state, hashes).hint("merge"), "h", "left")
        refused = F.coalesce(F.col("taken") < F.col("id"), F.lit(False))
        waits = F.coalesce(F.col("one") < F.col("id"), F.lit(False))
        one_only = waits & F.coalesce(F.col("two") >= F.col("id"), F.lit(True))
        # refused rows are written first: places are counted without them in the same round
        heard = saved(heard.select(*columns, F.coalesce("accepted", F.when(refused, False)).alias("accepted"), "parent", "flip", waits.alias("waits"), F.when(one_only, F.col("one")).alias("one")), "accept-heard")
        after, sure, full = heard, F.lit(True), F.lit(False)
        for k, (keys, cap) in enumerate(limits):
            places = _first(heard.filter("accepted is null or accepted").select(*keys, "id"), keys, "id", cap).select("id", F.lit(True).alias(f"place{k}"))
            ended = heard.filter("accepted").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= cap).select(*keys, F.lit(True).alias(f"full{k}"))
            after = after.join(places, "id", "left").join(ended, keys, "left")
            sure, full = sure & F.coalesce(f"place{k}", F.lit(False)), full | F.coalesce(f"full{k}", F.lit(False))
        above = heard.filter("accepted is not null or parent is not null").select(F.col("id").alias("parent"), F.col("accepted").alias("of"), F.col("parent").alias("next"), F.col("flip").alias("turn"))
        after = after.join(above.hint("merge"), "parent", "left")
        told = F.col("of") != F.col("flip")
        decided = F.coalesce("accepted", F.when(full, False).when(F.col("of").isNotNull(), told).when(sure & ~F.col("waits"), True))
        follows = sure & F.col("one").isNotNull()
        parent = F.when(F.col("parent").isNull(), F.when(follows, F.col("one"))).otherwise(F.coalesce("next", "parent"))
        flip = F.when(F.col("parent").isNull(), follows).otherwise(F.when(F.col("next").isNull(), F.col("flip")).otherwise(F.col("flip") != F.col("turn")))
        done = decided.isNotNull()
        after = after.select(*columns, decided.alias("accepted"), F.when(~done, parent).alias("parent"), F.coalesce(flip & ~done, F.lit(False)).alias("flip"))
        before, state = state, saved(after, "accept-state")
        for t in (before, heard):
            forget(spark, t)
    forget(spark, hashes)
    rounds.append(n)
    return state.drop("parent", "flip")


def first_come(nodes: DataFrame, edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(id, accepted): a node is accepted unless a smaller accepted node is its neighbour. nodes (id), edges (a, b)."""
    return accept_in_order(nodes.select("id", F.col("id").alias("h")), edges, rounds=rounds).select("id", "accepted")


def acquire(rows: DataFrame, near: DataFrame | Callable[[DataFrame], DataFrame], sources: list[tuple[str, list[tuple[str, int]], int | None]]) -> tuple[DataFrame, list[tuple[str, str, int, int]]]:
    """Fill roles from several sources: rows (id, h, source, model) to the accepted (id, source, model, role), and what each role was asked for and got.

    Sources are gone through in the order given, their rows in the order of id. Each has roles with quotas, filled one after the other: a role begins where the one
    before it was filled. At most cap (None: any number) rows of a model go to a role of a source. Near copies of anything accepted before, from whichever source, are refused. A role that
    can't be filled takes the rest of its source, and the roles after it get nothing."""
    spark, taken, told = rows.sparkSession, None, []
    for source, roles, cap in sources:
        after = None
        for role, quota in roles:
            own = rows.filter(F.col("source") == source)
            if after is not None:
                own = own.filter(F.col("id") > after)
            own = own.select("id", "h", "source", "model", F.lit(role).alias("role"), F.lit(None).cast("boolean").alias("accepted"), F.lit(1).alias("now"))
            if taken is not None:
                own = own.unionByName(taken.select("id", "h", "source", "model", "role", F.lit(True).alias("accepted"), F.lit(0).alias("now")))
            # what earlier sources gave comes before every row of this one
            own = own.withColumn("at", F.col("id")).withColumn("id", F.struct("now", "at"))
            limits = [(["now", "source", "role"], quota)] + ([(["now", "source", "role", "model"], cap)] if cap is not None else [])
            limits = [(c, n) for c, n in limits if n < 1 << 31]
            found = accept_in_order(own, near, limits)
            new = found.filter("accepted").select(F.col("at").alias("id"), "h", "source", "model", "role", "now")
            last = new.filter("now = 1").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).first()
            before, taken = taken, saved(new.drop("now"), "acquired")
            forget(spark, found)
            if before is not None:
                forget(spark, before)
            told.append((source, role, quota, last["n"]))
            if last["n"] < quota:
                told += [(source, r, q, 0) for r, q in roles[roles.index((role, quota)) + 1 :]]
                break
            after = last["last"]
    empty = rows.select("id", "source", "model", F.lit("").alias("role")).filter("false")
    return (empty if taken is None else taken.select("id", "source", "model", "role")), told


def neighbours(width: int, radius: int) -> list[int]:
    """All masks of up to `radius` of `width` bits."""
    masks, last = [0], [0]
    for _ in range(radius):
        # a mask goes on with bits above its highest one, so none comes twice
        last = [m | 1 << b for m in last for b in range(m.bit_length(), width)]
        masks += last
    return masks


def _cuts(radius: int, pieces: int, bits: int) -> list[tuple[int, int, int]]:
    """(first bit, width, radius) of the pieces: two hashes within `radius` agree within its own radius in one of them at least, as the sum of (radius + 1) is radius + 1."""
    each, more = divmod(radius + 1, pieces)
    wide, rest = divmod(bits, pieces)
    out, at = [], 0
    for i in range(pieces):
        # pieces with the larger radius are the wider ones
        w = wide + (1 if i < rest else 0)
        out.append((at, w, each + (1 if i < more else 0) - 1))
        at += w
    return [c for c in out if c[2] >= 0]


def _probes(df: DataFrame, value: str, cuts: list[tuple[int, int, int]], half: bool, out: str) -> DataFrame:
    """df with one row per piece and neighbour of it. half: the smaller part of the radius, else the larger one."""

    def around(k: int, at: int, width: int, radius: int) -> Column:
        piece = F.shiftrightunsigned(F.col(value), at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        masks = F.array(*[F.lit(m).cast("long") for m in neighbours(width, radius // 2 if half else radius - radius // 2)])
        return F.transform(masks, lambda m: F.struct(F.lit(k).alias("piece"), piece.bitwiseXOR(m).alias("value")))

    return df.withColumn(out, F.explode(F.concat(*[around(k, *cut) for k, cut in enumerate(cuts)])))


#: Meetings of one key beyond which its rows are parted further by their other hash.
HOT_PAIRS = 100_000


def loose_pairs(left: DataFrame, right: DataFrame, p_radius: int = 12, d_radius: int = 10, bits: tuple[int, int] = (64, 64), pieces: tuple[int, int] = (4, 3)) -> DataFrame:
    """near_pairs() for radii at which bands alone select little: multi-index hashing. (id, p, d) to pairs (a, b) with both distances within their radii.

    d is cut into wide pieces, each with its share of the radius; in one of them a pair agrees within that share. Both sides enumerate the neighbours of
    their pieces, each for half of the share, and meet where the neighbours are equal; the exact distances decide. A key at which many meet (a
    piece that most images share) is parted by pieces of p in the same way, so no pair is lost, whatever the data. bits: of p and d."""
    from tesserix.functions.hashing import hamming

    d_cuts, p_cuts = _cuts(d_radius, pieces[1], bits[1]), _cuts(p_radius, pieces[0], bits[0])
    a = _probes(left.select(F.col("id").alias("a"), F.col("p").alias("a_p"), F.col("d").alias("a_d")), "a_d", d_cuts, False, "key")
    b = _probes(right.select(F.col("id").alias("b"), F.col("p").alias("b_p"), F.col("d").alias("b_d")), "b_d", d_cuts, True, "key")
    a, b = saved(a, "loose-left"), saved(b, "loose-right")
    met = a.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(b.groupBy("key").agg(F.count(F.lit(1)).alias("m")), "key")
    hot = saved(met.filter(F.col("n") * F.col("m") > HOT_PAIRS).select("key"), "loose-hot")
    within = (hamming(F.col("a_p"), F.col("b_p")) <= p_radius) & (hamming(F.col("a_d"), F.col("b_d")) <= d_radius)
    cold = a.join(hot, "key", "left_anti").join(b, "key").filter(within)
    few, many = (_probes(x.join(hot, "key", "left_semi"), f"{n}_p", p_cuts, half, "other") for x, n, half in ((a, "a", False), (b, "b", True)))
    found = cold.drop("key").unionByName(few.join(many, ["key", "other"]).filter(within).drop("key", "other")).distinct()
    found = found.select("a", "b", hamming(F.col("a_p"), F.col("b_p")).alias("p_dist"), hamming(F.col("a_d"), F.col("b_d")).alias("d_dist"))
    out = saved(found, "loose-pairs")
    for t in (a, b, hot):
        forget(left.sparkSession, t)
    return out

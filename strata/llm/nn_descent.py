"""Embedding near-duplicates by NN-descent over representatives.

1. Equal vectors are one class. Leader rounds then gather classes into balls: every member
   lies within half the threshold's angle of the ball's centre, itself a vector, so by the
   triangle inequality of angles all members link with each other and need no comparison.
   A ball has a radius, the largest angle of a member to the centre. Lists, joins and edges
   are between balls; a class that no ball takes is a ball of its own with radius 0.
2. The first neighbour graph comes from random-projection trees. A ball stands in each
   bucket that one of its members falls into, once; so two rows that link meet as often as
   if all rows were compared. The number of trees grows with the table so that two rows at
   the threshold meet with probability RECALL; they are taken `trees` at a time, so what is
   on disk stays bounded. A bucket larger than a block is compared tile by tile, whole.
3. Lists hold the `k` nearest balls. A list whose last entry could still hold a link (its
   angle is at most the threshold's and both radii) is saturated: it takes in all such
   partners, so none is dropped, and what it gives to the next round of
   neighbours-of-neighbours joins doubles.
4. Threshold edges: two single classes link by their cosine. Balls link whole where the
   triangle inequality proves it; else all members of the larger ball are compared with all
   members of all its possible partners, tile by tile, giving counts and no pairs.
5. An audit compares a bounded set of queries with all rows; while the mean recall of those
   that have links stays below `target`, a further forest of other projections is added,
   and after `forests` of them a missed target is an error.

Every decision is made on cosines in double precision; bounds by angles keep SLACK off.

Defined cases: a null vector, an empty or a zero one, or one with null or non-finite
components links with nothing; vectors of different lengths never link; copies link with
each other; rows that repeat a vec_id with one vector are copies of each other, those that repeat it
with different vectors are compared as vectors of their own, and a null vec_id gives a row with a null component; an empty table gives no row; other columns are
ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.components import components
from strata.llm.scratch import Scratch

BLOCK = 2048
CHUNK = 1024
RECALL = 0.999
SLACK = 1e-7  # radians
LEADER_ROUNDS = 4


def _unit(rows) -> np.ndarray:
    return _unit_rows(np.array([np.asarray(r, np.float64) for r in rows]))


def _unit_rows(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    x = x / top  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _angle(cos):
    return np.arccos(np.clip(cos, -1.0, 1.0))


def _lengths(column) -> np.ndarray:
    """Lengths of the rows of an Arrow list column."""
    return np.diff(column.offsets.to_numpy())


def _rows(column, at: np.ndarray, d: int) -> np.ndarray:
    """Rows `at`, all of length d, of an Arrow list column without nulls."""
    values = column.values.to_numpy(zero_copy_only=False)
    return _unit_rows(values[column.offsets.to_numpy()[at][:, None] + np.arange(d)].astype(np.float64))


def usable(c: str) -> Column:
    """Vectors that can link: finite, not all zero."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(c).isNotNull() & (F.size(c) > 0) & ~bad & F.exists(c, lambda x: x != 0)


def trees_for(bits: int, threshold: float, recall: float = RECALL) -> int:
    """Trees of `bits` projections in which two rows at the threshold meet at least once, with this probability."""
    met = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    if met <= 0:
        raise ValueError("no number of trees reaches the recall at this threshold")
    return 1 if met == 1 else math.ceil(math.log(1 - recall) / math.log1p(-met))


def bits_for(total: int) -> int:
    """Projections of a tree whose buckets hold half a block on average."""
    return max(0, math.ceil(math.log2(max(1, total) / (BLOCK // 2)))) if total > BLOCK else 0


def _project(trees: range, bits: int, seed: int):
    """(tree, code, ball) of rows (ball, embedding): the signs of `bits` random projections, once for each tree."""

    def run(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            ball, vec = batch.column(0), batch.column(1)
            dims = _lengths(vec)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = _rows(vec, at, d)
                for t in trees:
                    if (t, d) not in planes:
                        planes[t, d] = np.random.default_rng([seed, t, int(d)]).standard_normal((int(d), max(1, bits)))
                    code = ((x @ planes[t, d]) > 0) @ (1 << np.arange(max(1, bits), dtype=np.int64)) if bits else np.zeros(len(at), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(code * 100_003 + int(d)), ball.take(pa.array(at))], ["tree", "code", "ball"])

    return run


# Balls


def _lead(tight: float):
    """Within a block, the centre that each row follows: rows of large balls lead first, then by a hash."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ball = pdf["ball"].to_numpy()
        x = _unit(pdf["embedding"])
        near = np.concatenate([(x[a : a + CHUNK] @ x.T) >= tight for a in range(0, len(x), CHUNK)])
        free, out = np.ones(len(x), bool), ball.copy()
        some = np.flatnonzero(near.sum(1) > 1)
        for k in some[np.lexsort((pdf["h"].to_numpy()[some], -pdf["n"].to_numpy()[some]))]:
            if free[k]:
                mine = near[k] & free
                out[mine], free[mine] = ball[k], False
        moved = out != ball
        return pd.DataFrame({"ball": ball[moved], "to": out[moved]})

    return run


def _cos_to(rows: DataFrame, extra: list[str], types: str) -> DataFrame:
    """Rows (..., x, y) with the cosine of x and y instead; -2 where the lengths differ."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                x, y = b.column("x"), b.column("y")
                dims = np.where(_lengths(x) == _lengths(y), _lengths(x), 0)
                cos = np.full(len(dims), -2.0)
                for d in np.unique(dims[dims > 0]):
                    at_d = np.flatnonzero(dims == d)
                    cos[at_d] = (_rows(x, at_d, d) * _rows(y, at_d, d)).sum(1)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in extra), pa.array(cos)], [*extra, "cos"])

    return rows.select(*extra, "x", "y").mapInArrow(run, f"{types}, cos double")


def gather(scratch: Scratch, classes: DataFrame, total: int, threshold: float, seed: int) -> DataFrame:
    """(rep, ball, cos): the ball of each class (rep, embedding) and its cosine to the centre. Ids of balls are those of their centres.

    A round lets the centres of one tree's buckets follow each other. The members of a
    centre that follows another are compared with that one: they go along if half of them
    fit, and those that do not become single again.
    """
    tight = math.cos(math.acos(threshold) / 2 - SLACK)
    bits = bits_for(total)
    vectors = classes.select(F.col("rep").alias("ball"), "embedding")
    member = scratch.save(classes.select("rep", F.col("rep").alias("ball"), F.lit(1.0).alias("cos")), "member")
    for n in range(LEADER_ROUNDS):
        size = member.groupBy("ball").agg(F.count(F.lit(1)).alias("n"))
        active = size.join(vectors, "ball")
        coded = active.select("ball", "embedding").mapInArrow(_project(range(n, n + 1), bits, seed + 1), "tree int, code long, ball long")
        rows = coded.join(active, "ball")
        large = coded.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")).filter("parts > 1")
        rows = rows.join(large, "code", "left").withColumn("sub", F.pmod(F.xxhash64("ball", F.lit(n)), F.coalesce("parts", F.lit(1))))
        moves = rows.select("code", "sub", "ball", "n", F.xxhash64("ball").alias("h"), "embedding").groupBy("code", "sub").applyInPandas(_lead(tight), "ball long, to long")
        moves = scratch.save(moves, "moves")
        if moves.isEmpty():
            scratch.drop(moves)
            break
        going = member.join(moves, "ball").select("rep", "ball", "to")
        going = going.join(vectors.toDF("rep", "x"), "rep").join(vectors.toDF("to", "y"), "to")
        tried = scratch.save(_cos_to(going, ["rep", "ball", "to"], "rep long, ball long, to long"), "tried")
        fits = F.col("cos") >= tight
        go = tried.groupBy("ball").agg((F.sum(fits.cast("int")) * 2 >= F.count(F.lit(1))).alias("go")).filter("go").select("ball")
        went = tried.join(go, "ball").select("rep", F.when(fits, F.col("to")).otherwise(F.col("rep")).alias("ball"), F.when(fits, F.col("cos")).otherwise(1.0).alias("cos"))
        after = scratch.save(member.join(went.select("rep"), "rep", "left_anti").select("rep", "ball", "cos").union(went), "member")
        scratch.drop(member, moves, tried)
        member = after
        if not bits:
            break
    return member


# The neighbour graph


def _linkable(cos, r, angle: float):
    """Angles at most the threshold's and both radii r (summed)."""
    return _angle(cos) <= angle + r + SLACK


def _tile(k: int, explore: float, threshold: float, lists: bool):
    """Pairs (u, v, cos, link) of a tile: all that could hold a link, and with `lists` each row's k nearest others from `explore` on."""
    angle = math.acos(threshold)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ball, r, side = pdf["ball"].to_numpy(), pdf["r"].to_numpy(), pdf["part"].to_numpy()
        x = _unit(pdf["embedding"])
        same = key[2] == key[3]
        left, right = (np.arange(len(x)),) * 2 if same else (np.flatnonzero(side == key[2]), np.flatnonzero(side == key[3]))
        u, v, c, link = [], [], [], []

        def keep(i, j, cos, flag):
            u.append(ball[i])
            v.append(ball[j])
            c.append(cos)
            link.append(np.full(len(i), flag))

        for at in range(0, len(left) if len(right) else 0, CHUNK):
            rows = left[at : at + CHUNK]
            s = x[rows] @ x[right].T
            if same:
                s[np.arange(len(rows)), at + np.arange(len(rows))] = -2
            least = math.cos(min(math.pi, angle + SLACK + float(r[rows].max() + r[right].max())))
            i, j = np.nonzero(s >= least - 1e-9)
            ok = (s[i, j] >= threshold) | ((r[rows[i]] + r[right[j]] > 0) & _linkable(s[i, j], r[rows[i]] + r[right[j]], angle))
            i, j = i[ok], j[ok]
            first = (ball[rows[i]] < ball[right[j]]) | (not same)
            keep(rows[i[first]], right[j[first]], s[i[first], j[first]], True)
            if lists:
                s[i, j] = -2
                m = min(k, s.shape[1])
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                i, j = np.nonzero(np.take_along_axis(s, top, 1) >= explore)
                j = top[i, j]
                keep(rows[i], right[j], s[i, j], False)
        if not u:
            return pd.DataFrame({"u": ball[:0], "v": ball[:0], "cos": np.zeros(0), "link": np.zeros(0, bool)})
        a, b = np.concatenate(u), np.concatenate(v)
        return pd.DataFrame({"u": np.minimum(a, b), "v": np.maximum(a, b), "cos": np.concatenate(c), "link": np.concatenate(link)})

    return run


EDGE = "u long, v long, cos double, link boolean"


def _once(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u", "v").agg(F.max("cos").alias("cos"), F.max("link").alias("link"))


def _meet(scratch: Scratch, members: DataFrame, units: DataFrame, some: range, bits: int, seed: int, k: int, explore: float, threshold: float, lists: bool) -> DataFrame:
    """Pairs of balls that meet in a bucket of these trees; members (ball, embedding), units (ball, embedding, r)."""
    there = members.mapInArrow(_project(some, bits, seed), "tree int, code long, ball long").distinct()
    there = scratch.save(there, "there") if bits else there
    large = there.groupBy("tree", "code").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).filter("parts > 1")
    none = F.lit(0)
    rows = there.join(units, "ball").select("*", none.alias("i"), none.alias("j"), none.alias("part"))
    if not large.isEmpty():
        crowded = there.join(large, ["tree", "code"]).withColumn("part", F.pmod(F.xxhash64("ball", "tree"), F.col("parts")).cast("int"))
        tiles = crowded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        tiles = tiles.select("tree", "code", "ball", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part").join(units, "ball")
        rows = rows.join(large, ["tree", "code"], "left_anti").select("tree", "code", "i", "j", "part", "ball", "r", "embedding").union(tiles.select("tree", "code", "i", "j", "part", "ball", "r", "embedding"))
    found = scratch.save(rows.groupBy("tree", "code", "i", "j").applyInPandas(_tile(k, explore, threshold, lists), EDGE), "near")
    scratch.drop(there)
    return found


def _nearest(pairs: DataFrame, k: int, doubled: int) -> DataFrame:
    """Each ball's k nearest, as (u, v), from pairs in one direction; of a saturated list, doubled so often, all possible partners that fit."""
    both = pairs.select("u", "v", "cos", "link").union(pairs.select("v", "u", "cos", "link"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.col("cos").desc(), "v"))
    return both.withColumn("rank", rank).filter((F.col("rank") <= k) | (F.col("link") & (F.col("rank") <= k << doubled))).select("u", "v")


def refine(scratch: Scratch, pairs: DataFrame, units: DataFrame, k: int, explore: float, threshold: float, rounds: int) -> DataFrame:
    """Pairs after neighbours-of-neighbours joins, until hardly any is added or the rounds are used up.

    A round keeps all pairs that could hold a link, whatever k. It joins each ball's k
    nearest with those of its neighbours; lists still saturated are doubled from round to round.
    """
    angle = math.acos(threshold)
    left, right = units.toDF("u", "x", "ru"), units.toDF("v", "y", "rv")
    for n in range(rounds):
        near = scratch.save(_nearest(pairs, k, n), "lists")
        a, b = near.alias("a"), near.alias("b")
        reach = a.join(b, F.col("a.v") == F.col("b.u")).select(F.col("a.u").alias("u"), F.col("b.v").alias("v")).filter("u < v").distinct()
        new = reach.join(pairs.select("u", "v"), ["u", "v"], "left_anti").join(left, "u").join(right, "v").withColumn("r", F.col("ru") + F.col("rv"))
        cos = _cos_to(new, ["u", "v", "r"], "u long, v long, r double")
        could = (F.col("cos") >= threshold) | ((F.col("r") > 0) & (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cos"))) <= F.lit(angle + SLACK) + F.col("r")))
        more = scratch.save(cos.select("u", "v", "cos", could.alias("link")).filter((F.col("cos") >= explore) | F.col("link")), "met")
        found, size = more.count(), pairs.count()
        after = scratch.save(pairs.union(more), f"round{n}")
        scratch.drop(pairs, near, more)
        pairs = after
        if found <= 0.001 * size:
            break
    return pairs


# Links


def _count_tile(threshold: float):
    """A tile of one ball's members against members of its possible partners: counts of links, and which balls link."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        side, rep, w, ball = (pdf[c].to_numpy() for c in ("side", "rep", "w", "ball"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": rep[:0], "n": rep[:0], "a": rep[:0], "b": rep[:0]})
        x = _unit(pdf["embedding"])
        s = (x[left] @ x[right].T) >= threshold
        n_left, n_right = s @ w[right], s.T @ w[left]
        hit = np.unique(ball[right[s.any(0)]])
        zero = np.zeros(len(hit), np.int64)
        reps, counts = np.concatenate((rep[left], rep[right])), np.concatenate((n_left, n_right))
        some = counts > 0
        return pd.concat([
            pd.DataFrame({"rep": reps[some], "n": counts[some], "a": -1, "b": -1}),
            pd.DataFrame({"rep": zero, "n": zero, "a": zero + key[0], "b": hit}),
        ])

    return run


def links(scratch: Scratch, pairs: DataFrame, member: DataFrame, units: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((rep, n), (a, b)): links of each class (rep, ball, w, embedding) to other classes, copies counted, and the balls that link."""
    angle = math.acos(threshold)
    one = scratch.save(_once(pairs.filter("link")).select("u", "v", "cos"), "possible")
    size = units.select("ball", "r", "total", "n")
    both = one.join(size.toDF("u", "ru", "tu", "nu"), "u").join(size.toDF("v", "rv", "tv", "nv"), "v")
    sure = (F.col("nu") == 1) & (F.col("nv") == 1) | (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cos"))) + F.col("ru") + F.col("rv") <= F.lit(angle - SLACK))
    both = scratch.save(both.withColumn("sure", sure), "both")
    whole = both.filter("sure")
    per_ball = whole.select(F.col("u").alias("ball"), F.col("tv").alias("n")).union(whole.select("v", "tu")).groupBy("ball").agg(F.sum("n").alias("more"))
    inside = member.join(units.select("ball", "total"), "ball").join(per_ball, "ball", "left").select("rep", (F.col("total") - F.col("w") + F.coalesce("more", F.lit(0))).alias("n"))

    larger = F.col("nu") >= F.col("nv")
    open_ = both.filter("NOT sure").select(F.when(larger, F.col("u")).otherwise(F.col("v")).alias("big"), F.when(larger, F.col("v")).otherwise(F.col("u")).alias("ball"))
    open_ = scratch.save(open_, "open")
    edges, counts = whole.select(F.col("u").alias("a"), F.col("v").alias("b")), inside
    if not open_.isEmpty():
        n = units.select("ball", "n")
        sizes = open_.join(n, "ball").groupBy("big").agg(F.sum("n").alias("others")).join(n.toDF("big", "own"), "big")
        sizes = sizes.select("big", F.ceil(F.col("own") / BLOCK).cast("int").alias("p"), F.ceil(F.col("others") / BLOCK).cast("int").alias("q"))
        sizes = scratch.save(sizes, "tiles")

        def each(c: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.col(c) - 1))

        def own(c: str) -> Column:
            return F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")

        slim = member.select("rep", "ball")
        ours = slim.join(sizes.withColumnRenamed("big", "ball"), "ball").select(F.col("ball").alias("big"), own("p").alias("i"), each("q").alias("j"), F.lit(0).alias("side"), "rep")
        theirs = open_.join(slim, "ball").join(sizes, "big").select("big", each("p").alias("i"), own("q").alias("j"), F.lit(1).alias("side"), "rep")
        rows = ours.union(theirs).join(member, "rep")
        got = scratch.save(rows.groupBy("big", "i", "j").applyInPandas(_count_tile(threshold), "rep long, n long, a long, b long"), "tiled")
        edges = edges.union(got.filter("n = 0").select("a", "b"))
        counts = counts.union(got.filter("n > 0").select("rep", "n"))
    return counts.groupBy("rep").agg(F.sum("n").alias("n")), edges


def audit(classes: DataFrame, counts: DataFrame, threshold: float, queries: int) -> tuple[float, int]:
    """(mean recall, number) of those among about `queries` classes, chosen by a hash, that have links, against all rows."""
    total = classes.count()
    rate = int(min(1.0, max(queries / max(1, total), 0.0)) * (1 << 30))
    few = classes.filter(F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 30)) < rate).select("rep", "embedding").limit(2 * queries)
    got = few.toPandas()
    if not len(got):
        return 1.0, 0
    by_dim = {d: (part["rep"].to_numpy(), _unit(part["embedding"])) for d, part in got.groupby(got["embedding"].map(len))}
    shared = classes.sparkSession.sparkContext.broadcast(by_dim)  # at most 2 * queries vectors

    def run(batches):
        n: dict[int, int] = {}
        for batch in batches:
            rep, w, vec = batch.column("rep").to_numpy(), batch.column("w").to_numpy(), batch.column("embedding")
            dims = _lengths(vec)
            for d in np.unique(dims):
                if d in shared.value:
                    q, x = shared.value[d]
                    at = np.flatnonzero(dims == d)
                    hit = (_rows(vec, at, d) @ x.T) >= threshold
                    hit &= rep[at][:, None] != q[None, :]
                    for r, c in zip(q.tolist(), (w[at] @ hit).tolist()):
                        n[r] = n.get(r, 0) + int(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], ["rep", "true"])

    true = classes.select("rep", "w", "embedding").mapInArrow(run, "rep long, true long").groupBy("rep").agg(F.sum("true").alias("true"))
    both = true.filter(F.col("true") > 0).join(counts, "rep", "left").select((F.least("true", F.coalesce("n", F.lit(0))) / F.col("true")).alias("share"))
    both = both.agg(F.avg("share").alias("recall"), F.count(F.lit(1)).alias("asked")).first()
    return (both.recall if both.asked else 1.0), both.asked


def _classes(scratch: Scratch, able: DataFrame) -> DataFrame:
    """(rep, first, w, embedding) of each different vector. rep is its smallest vec_id, or an unused number where several vectors have that one."""
    found = able.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("w"))
    found = scratch.save(found, "vectors")
    shared = found.groupBy("first").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("first", F.lit(True).alias("shared"))
    low = found.agg(F.min("first")).first()[0] or 0
    rep = F.when(F.col("shared"), F.lit(low - 1) - F.monotonically_increasing_id()).otherwise(F.col("first"))
    return scratch.save(found.join(shared, "first", "left").select(rep.alias("rep"), "first", "w", "embedding"), "classes")


def near_duplicates(df: DataFrame, threshold: float = 0.9, k: int = 12, trees: int = 6, explore: float = 0.6, rounds: int = 3, target: float = 0.99, queries: int = 1000, forests: int = 3, seed: int = 17) -> DataFrame:
    """vec_id, n_links, component_id, kept, recall (as audited): one row for each row of df (vec_id, embedding)."""
    scratch = Scratch(df.sparkSession, "descent")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    able = rows.filter(usable("embedding") & F.col("vec_id").isNotNull())
    classes = _classes(scratch, able)
    total = classes.count()
    bits = bits_for(total)
    each = trees_for(bits, threshold)

    assigned = gather(scratch, classes, total, threshold, seed)
    member = scratch.save(assigned.join(classes.drop("first"), "rep"), "members")
    fat = member.groupBy("ball").agg(F.min("cos").alias("cos"), F.sum("w").alias("total"), F.count(F.lit(1)).alias("n"))
    radius = F.when(F.col("n") > 1, F.acos(F.least(F.lit(1.0), "cos")) + F.lit(SLACK)).otherwise(0.0)
    units = fat.select("ball", radius.alias("r"), "total", "n").join(classes.select(F.col("rep").alias("ball"), "embedding"), "ball")
    units = scratch.save(units, "units")
    centres, points = units.select("ball", "embedding", "r"), member.select("ball", "embedding")

    pairs, counts, joined, recall = None, None, None, 1.0
    for forest in range(forests):
        near = []
        for first in range(forest * each, (forest + 1) * each, trees):
            some = range(first, min(first + trees, (forest + 1) * each))
            near.append(_meet(scratch, points, centres, some, bits, seed, k, explore, threshold, bits > 0 and first == 0))
        found = reduce(DataFrame.union, near if pairs is None else [*near, pairs])
        met = scratch.save(_once(found), "pairs")
        scratch.drop(*near)
        pairs = refine(scratch, met, centres, k, explore, threshold, rounds) if bits else met
        counts, edges = links(scratch, pairs, member, units, threshold)
        counts, joined = scratch.save(counts, "counts"), scratch.save(components(scratch, edges), "joined")
        recall, asked = audit(classes, counts, threshold, queries) if bits else (1.0, 0)
        if recall >= target:
            break
    else:
        raise RuntimeError(f"recall {recall:.4f} of {asked} audited vectors is below {target} after {forests} forests of {each} trees")

    placed = member.join(joined.toDF("ball", "group"), "ball", "left").select("rep", F.coalesce("group", "ball").alias("group"))
    placed = placed.join(classes, "rep")
    smallest = placed.groupBy("group").agg(F.min("first").alias("component_id"))
    labelled = placed.join(smallest, "group").join(counts, "rep", "left")
    labelled = scratch.save(labelled.select((F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id", "embedding"), "labelled")
    scratch.keep_only(labelled)
    linked = able.join(labelled, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~(usable("embedding") & F.col("vec_id").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    return out.withColumn("recall", F.lit(float(recall)))

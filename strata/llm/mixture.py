"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Everything here is DataFrame and SQL functions.

1. Targets. Sources by code point, null last, weigh `weights` in turn and share all words;
   a target stops at `most` times its source's words and the rest is shared anew. Sorted
   by cap over weight, the capped sources are a prefix, so one pass over the source table
   gives the level at which the others stand.
2. Quotas. A source is cut by a hash into blocks of about `block_words` words. It is taken
   whole as often as its target allows; for the rest its blocks are permuted and taken
   while they fit, and the block at the edge gives those of its documents that fit.
3. Splitting tree. The block quotas of all sources are split among `shards` output shards:
   a node of the tree draws how many blocks of each source go left from the multivariate
   hypergeometric distribution, source by source, by inverting its exact distribution
   function within 9 standard deviations of the mode. Leaves are exact quotas.
4. The blocks drawn from a source are permuted anew and numbered; each shard has the stretch
   of numbers that its quota gives it, so what shards draw is disjoint. A document is taken
   as often as the shards hold its block, but for those of the edge that do not fit.
5. The mix itself is dealt by shard and each shard is shuffled locally, by a seeded hash.

Numbers and running sums over the blocks of a source are two-level: sums of SLICES ranges
of the permuting hash come first, so no task has to see a whole source. Only tables with a
row for each source (targets, the nodes of the tree) are taken as a whole.

The hashes are seeded, so reruns agree.

Defined cases: a null text has size 0; a document of size 0 is never taken; a null source
is a source of its own; repeated rows are documents of their own; an empty table gives no
row. Other columns are kept by mix() and ignored by plan().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
FILLS = 4
SLICES = 1024
SHARD_WORDS = 2_000_000  # at least
MOST_SHARDS = 100_000


def _uniform(*of: str) -> str:
    return f"(CAST(shiftrightunsigned(xxhash64({', '.join(of)}), 11) AS DOUBLE) + 0.5D) / 9007199254740992D"


def _hypergeometric(q: str, total: str, n: str, u: str) -> str:
    """SQL for a draw: successes among n of total, q of which are marked; u is uniform."""
    lo, hi = f"greatest(0L, {n} - ({total} - {q}))", f"least({n}, {q})"
    mode = f"CAST(floor(({n} + 1D) * ({q} + 1D) / ({total} + 2D)) AS BIGINT)"
    p = f"(CAST({q} AS DOUBLE) / {total})"
    wide = f"CAST(ceil(9D * sqrt({n} * {p} * (1D - {p}) + 1D)) + 9 AS BIGINT)"
    a, b = f"greatest({lo}, {mode} - {wide})", f"least({hi}, {mode} + {wide})"
    ratio = f"(CAST({q} - x AS DOUBLE) * ({n} - x) / ((x + 1D) * (CAST({total} AS DOUBLE) - {q} - {n} + x + 1D)))"
    # Walk up from a: weights relative to the first, their sum, then the first x whose share reaches u.
    span = f"sequence({a}, {b})"
    whole = f"aggregate({span}, named_struct('w', 1D, 's', 0D), (acc, x) -> named_struct('w', acc.w * {ratio}, 's', acc.s + acc.w), acc -> acc.s)"
    pick = (
        f"aggregate({span}, named_struct('w', 1D, 's', 0D, 'x', CAST(NULL AS BIGINT), 'z', {whole}), "
        f"(acc, x) -> named_struct('w', acc.w * {ratio}, 's', acc.s + acc.w, "
        f"'x', CASE WHEN acc.x IS NULL AND acc.s + acc.w >= {u} * acc.z THEN x ELSE acc.x END, 'z', acc.z), acc -> coalesce(acc.x, {b}))"
    )
    return f"CASE WHEN {lo} >= {hi} THEN {lo} ELSE {pick} END"


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sid, source, source_size, docs, target from rows (source, size). One row for each source."""
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1)
    src = src.withColumn("sid", F.row_number().over(by_name)).withColumn("w", w.cast("double"))
    src = src.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("total", F.sum("source_size").over(everything))
    up = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    before = F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    src = src.withColumn("level", (F.col("total") - before) / rest)
    level = F.first(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")), ignorenulls=True)
    src = src.withColumn("share", F.coalesce(level.over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0)))
    target = F.least(F.col("share") * F.col("w"), "cap")
    return src.select("sid", "source", "source_size", "docs", target.alias("target"))


def _split(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(sid, shard, q, hi): a shard has q blocks of the source, those with the numbers up to hi."""
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("sid", "q"))).alias("all"))
    node = node.select(F.col("all.sid").alias("sids"), F.transform("all", lambda x: x.q).alias("q"), F.lit(0).alias("first"), F.lit(shards).alias("width")).filter(F.size("q") > 0)
    level = 0
    while shards > 1:
        level += 1
        if level % 8 == 0:  # some hundred nodes by now: deal them out
            node = node.repartition("first")
        draw = _hypergeometric("q[i]", "st.total", "st.n", _uniform("i", "first", "width", str(seed)))
        left = f"""aggregate(sequence(0, size(q) - 1), named_struct('total', aggregate(q, 0L, (s, y) -> s + y), 'n', go, 'out', CAST(array() AS ARRAY<BIGINT>)),
            (st, i) -> transform(array({draw}), d -> named_struct('total', st.total - q[i], 'n', st.n - d, 'out', concat(st.out, array(d))))[0],
            st -> st.out)"""
        go = "CAST(floor(aggregate(q, 0L, (s, y) -> s + y) * CAST(ceil(width / 2D) AS BIGINT) / width) AS BIGINT)"
        node = node.withColumn("go", F.expr(go)).withColumn("left", F.when(F.col("width") > 1, F.expr(left)).otherwise(F.col("q")))
        parts = F.expr("""CASE WHEN width > 1 THEN array(
            named_struct('first', first, 'width', CAST(ceil(width / 2D) AS INT), 'q', left),
            named_struct('first', first + CAST(ceil(width / 2D) AS INT), 'width', width - CAST(ceil(width / 2D) AS INT), 'q', zip_with(q, left, (a, b) -> a - b)))
            ELSE array(named_struct('first', first, 'width', width, 'q', q)) END""")
        node = node.select("sids", F.explode(parts).alias("p")).select("sids", "p.q", "p.first", "p.width")
        shards = (shards + 1) // 2
    flat = node.select(F.col("first").alias("shard"), F.posexplode(F.arrays_zip("sids", "q")).alias("k", "z")).select("shard", F.col("z.sids").alias("sid"), F.col("z.q").alias("q"))
    part = F.floor(F.col("shard") / SLICES)
    flat = _running(flat.withColumn("slice", part), ["sid"], "slice", ["shard"], "q", "hi")
    return flat.filter("q > 0").select("sid", "shard", "q", "hi")


def _running(rows: DataFrame, by: list[str], slice_: str, order: list[str], value: str, name: str) -> DataFrame:
    """Running sum of `value` within `by`, in the order of (slice, order), the slices summed first."""
    first = rows.groupBy(*by, slice_).agg(F.sum(value).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*by).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1))
    first = first.select(*by, slice_, F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.sum(value).over(Window.partitionBy(*by, slice_).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn(name, within).join(first, [*by, slice_]).withColumn(name, F.col(name) + F.col("__before")).drop("__before", slice_)


def _permuted(rows: DataFrame, seed: int, *of: str) -> DataFrame:
    """Rows with a seeded hash `__p` and its slice."""
    p = F.xxhash64(*of, F.lit(seed))
    return rows.withColumn("__p", p).withColumn("__slice", F.pmod("__p", F.lit(SLICES)))


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: int = 100_000, shards: int | None = None, seed: int = 20240229) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards (one entry for each copy): a row for each row of docs.

    Without a number of shards there is one for each SHARD_WORDS words, up to MOST_SHARDS larger ones.
    """
    scratch = Scratch(docs.sparkSession, "mixture")
    rows, _, placed, chosen, _ = _plan(scratch, docs.select("doc_id", "source", "text"), weights, most, block_words, shards, seed)
    out = _taken(rows, placed, chosen)
    places = F.coalesce(F.transform("taken", lambda p: p.shard), F.array().cast("array<int>"))
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.size(places) * F.col("size")).cast("long").alias("taken"), places.alias("shards"))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _placed(rows: DataFrame, key: DataFrame, seed: int) -> DataFrame:
    """Rows (doc_id, source, size, th, ...) with their source's figures, hash and block."""
    rows = rows.join(key, rows["source"].eqNullSafe(key["s"])).drop("s")
    rows = rows.withColumn("h", F.xxhash64("doc_id", "source", "size", "th", F.lit(seed)))
    return rows.withColumn("block", F.pmod(F.xxhash64("h", F.lit(1)), F.col("n")))


def _taken(rows: DataFrame, placed: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows with `taken`, the places (extra, pass, shard) where shards have them: those of their block, the edge's only if chosen."""
    out = rows.join(placed, ["sid", "block"], "left").join(chosen, ["sid", "h"], "left")
    edge = F.coalesce("edge", F.lit(False)) & ~F.coalesce("chosen", F.lit(False))
    return out.withColumn("taken", F.when(F.col("size") > 0, F.filter("placed", lambda p: ~(p.extra & edge))))


def _plan(scratch: Scratch, docs: DataFrame, weights, most, block_words, shards, seed) -> tuple[DataFrame, ...]:
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), _size().alias("size"), F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("row"))
    sized = scratch.save(sized, "sized")
    src = targets(sized, weights, most)
    n = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long")
    times = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size") + F.lit(1e-9)))).otherwise(0).cast("int")
    src = src.withColumn("n", n).withColumn("times", times).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("times") * F.col("source_size")))
    src = scratch.save(src, "sources")
    key = src.select("sid", F.col("source").alias("s"), "n", "source_size", "target", "times")
    rows = scratch.save(_placed(sized, key, seed), "rows")

    blocks = rows.filter("size > 0").groupBy("sid", "block").agg(F.sum("size").alias("words"))
    blocks = _running(_permuted(blocks, seed + 1, "sid", "block"), ["sid"], "__slice", ["__p", "block"], "words", "cum").drop("__p")
    blocks = blocks.join(src.select("sid", "rest", "times"), "sid")
    part = F.when(F.col("cum") <= F.col("rest"), 1).when(F.col("cum") - F.col("words") < F.col("rest"), 2).otherwise(0)  # whole, the edge, none
    blocks = scratch.save(blocks.withColumn("part", part).withColumn("left", F.col("rest") - F.col("cum") + F.col("words")), "blocks")

    # The block at the edge, bounded by block_words and one document: documents that fit, in a random order.
    # Equal rows (sid, h) are taken alike, so they count as one with their summed size.
    edge = rows.filter("size > 0").join(blocks.filter("part = 2").select("sid", "block", "left"), ["sid", "block"])
    edge = edge.groupBy("sid", "h", "left").agg(F.sum("size").alias("size"), F.min("row").alias("row"))
    edge = edge.select("sid", "row", "size", "h", "left", F.lit(False).alias("in"))
    within = Window.partitionBy("sid").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("sid")
    for _ in range(FILLS):
        fits = ~F.col("in") & (F.col("size") <= F.col("left"))
        edge = edge.withColumn("c", F.sum(F.when(fits, F.col("size")).otherwise(0)).over(within)).withColumn("new", fits & (F.col("c") <= F.col("left")))
        edge = edge.withColumn("left", F.col("left") - F.sum(F.when(F.col("new"), F.col("size")).otherwise(0)).over(group)).withColumn("in", F.col("in") | F.col("new"))
    near = F.min(F.when(~F.col("in"), F.struct(F.abs(F.col("size") - F.col("left")).alias("off"), "row"))).over(group)
    edge = edge.withColumn("near", near).withColumn("in", F.col("in") | F.coalesce((F.col("near.row") == F.col("row")) & (F.col("near.off") < F.col("left")), F.lit(False)))
    chosen = scratch.save(edge.filter("in").select("sid", "h", F.lit(True).alias("chosen")).distinct(), "chosen")

    drawn = blocks.select("sid", "block", "part", F.explode(F.sequence(F.lit(1), F.lit(most + 1))).alias("pass"), "times")
    drawn = drawn.filter((F.col("pass") <= F.col("times")) | ((F.col("pass") == F.col("times") + 1) & (F.col("part") > 0)))
    drawn = drawn.select("sid", "block", (F.col("pass") > F.col("times")).alias("extra"), (F.col("part") == 2).alias("edge"), "pass", F.lit(1).cast("long").alias("one"))
    drawn = _running(_permuted(drawn, seed + 2, "sid", "block", "pass"), ["sid"], "__slice", ["__p", "block", "pass"], "one", "number")
    drawn = scratch.save(drawn.drop("__p", "one"), "drawn")
    if shards is None:
        words = src.agg(F.sum("target")).first()[0] or 0
        shards = max(1, math.ceil(words / max(SHARD_WORDS, words / MOST_SHARDS)))
    quotas = scratch.save(_split(drawn.groupBy("sid").agg(F.count(F.lit(1)).alias("q")), shards, seed), "quotas")
    numbers = quotas.select("sid", "shard", F.explode(F.sequence(F.col("hi") - F.col("q") + 1, F.col("hi"))).alias("number"))
    placed = drawn.join(numbers, ["sid", "number"]).select("sid", "block", "edge", F.struct("extra", "pass", "shard").alias("p"))
    placed = scratch.save(placed.groupBy("sid", "block").agg(F.array_sort(F.collect_list("p")).alias("placed"), F.max("edge").alias("edge")), "placed")  # at most `most` + 1 places
    return rows, key, placed, chosen, shards


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: int = 100_000, shards: int | None = None, seed: int = 20240229, shard_column: str | None = None) -> DataFrame:
    """The mix itself: rows of docs (doc_id, source, text and others), each as often as it is taken, by shard and shuffled within.

    What is taken is decided on small tables (sources, blocks, documents at the edge); the
    texts move once, to their shards. Rows equal in doc_id, source and text are taken alike.
    """
    scratch = Scratch(docs.sparkSession, "mixture")
    _, key, placed, chosen, shards = _plan(scratch, docs.select("doc_id", "source", "text"), weights, most, block_words, shards, seed)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", F.col("source").cast("string").alias("source"), _size().alias("size"), F.xxhash64("text").alias("th"))
    rows = _taken(_placed(rows.filter("size > 0"), key, seed), placed, chosen).select("doc", "h", F.explode("taken").alias("p"))
    rows = rows.select("doc", F.col("p.shard").alias("shard"), F.xxhash64("h", "p.shard", "p.pass", F.lit(seed + 3)).alias("at"))
    rows = rows.repartitionById(shards, "shard").sortWithinPartitions("at")  # a task for each shard
    return rows.select("doc.*", *([F.col("shard").alias(shard_column)] if shard_column else []))

"""Near-duplicate documents by a chosen-path similarity join on word shingles.

Documents with equal shingle sets are one class, found by a fingerprint of the set. The
smallest doc of each class goes down `trees` independent trees. A node of a tree is the
sequence of minwise tokens its documents have chosen: one token at the root level, and
below a node with more than `limit` members each member follows `BRANCH` more minwise
tokens. A node of up to `limit` members is compared exhaustively. A larger one compares
all members with one pivot, closes if all of them resemble it, and else branches. Closed
nodes, and those still large at the last level, are finished exactly: nodes of one pivot form a group, and
members outside the group's largest component are compared with all its members on full
sets, block by block, giving back no more than a spanning forest.

A comparison first looks at sizes and at 256 sketch bits, whose bound lies 4.5 standard
deviations below the threshold; a link counts only once it is confirmed on the full
shingle sets. The number of trees follows from the wanted recall of a pair that lies at
the threshold.

Defined cases: a null text, or one without words, has an empty set, size 0, and links
with nothing; with fewer words than a shingle has, the whole sequence is the one shingle;
rows that repeat a doc_id count as one document that has each of their texts; a row
without doc_id links with nothing and has no component; an empty table gives no row;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.bytewords import mix, shingle_set, utf8, word_hashes
from strata.llm.components import components
from strata.llm.scratch import Scratch, by_ids

SKETCH = 128  # minwise functions, two bits each
BRANCH = 2
LEVELS = 3
LIMIT = 16
BLOCK = 512  # members of a block of a large group
SLICE = 4096  # shingles of an incidence matrix at a time


def trees_for(threshold: float, recall: float) -> int:
    """Trees after which a pair at the threshold has met with the wanted probability."""
    met = threshold * (1 - (1 - threshold) ** BRANCH) ** (LEVELS - 1)
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def least_bits(threshold: float) -> int:
    """Equal sketch bits that a pair at the threshold has but for 4.5 standard deviations."""
    j = threshold
    var = 4 * j + 1.5 * (1 - j) - (1 + j) ** 2
    return math.floor(SKETCH * (1 + j) - 4.5 * math.sqrt(SKETCH * var))


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, count + 1, dtype=np.uint64)
    return (mix(k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (mix(k) >> np.uint64(32)).astype(np.uint32)


def minwise(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each function over the set."""
    s = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 2048):
        h = s[at : at + 2048, None] * a[None, :]
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x7FEB352D)
        h += b[None, :]
        np.minimum(best, h.min(0), out=best)
    return best


def _signatures(shingle: int, picks: int):
    def run(batches):
        a, b = _functions(SKETCH + picks)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 500):
                n, f1, f2, sketch, sig = [], [], [], [], []
                stop = min(batch.num_rows, at + 500)
                for k in range(at, stop):
                    text = utf8(texts[k])
                    s = shingle_set(word_hashes(text), shingle) if text else np.zeros(0, np.uint64)
                    m = minwise(s, a, b)
                    n.append(len(s))
                    f1.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                    f2.append(int(mix(s ^ np.uint64(0x5555555555555555)).sum(dtype=np.uint64).astype(np.int64)))
                    low = m[:SKETCH]
                    bits = np.packbits(np.concatenate((low & 1, (low >> np.uint32(1)) & 1)).astype(np.uint8))
                    sketch.append(bits.view("<i8"))
                    sig.append(m[SKETCH:].view(np.int32))
                sk = np.array(sketch, np.int64).reshape(-1, 4)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(sig)), picks).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, stop - at), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), *(pa.array(sk[:, j]) for j in range(4)), flat],
                    ["doc_id", "n_shingles", "f1", "f2", "s0", "s1", "s2", "s3", "sig"],
                )

    return run


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 200):
                stop = min(batch.num_rows, at + 200)
                sets = [shingle_set(word_hashes(utf8(texts[k]) or b""), shingle).view(np.int64) for k in range(at, stop)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, stop - at), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return run


def _alike(a: str, b: str, least: int, percent: int) -> Column:
    """Sizes and sketch bits of two rows permit the threshold. Also gives the bits by _bits."""
    size = F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent
    return size & (_bits(a, b) >= least)


def _bits(a: str, b: str) -> Column:
    other = [F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(4)]
    return F.lit(2 * SKETCH) - (other[0] + other[1] + other[2] + other[3])


def sets_of(scratch: Scratch, docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """Full shingle sets (doc_id, shingles) of the wanted doc_ids."""
    sets = by_ids(scratch, docs, wanted, "left_semi").mapInArrow(_sets(shingle), "doc_id long, shingles array<long>")
    return scratch.save(sets, "sets")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    return joined.filter(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent).select("a", "b")


def _roots(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, component) of a forest in which each b has one smaller a, by pointer jumping."""
    r = scratch.save(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")), "roots")
    while True:
        up = r.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        n = r.join(up, "component", "left").select("node", F.coalesce("higher", "component").alias("component"), F.col("higher").isNotNull().alias("moved"))
        n = scratch.save(n, "roots")
        scratch.drop(r)
        r = n
        if n.filter("moved").isEmpty():
            return n


def _block_links(percent: int):
    """Links between the outsiders and the members of a block that join different components.

    Intersections of all pairs come from products of incidence matrices, a slice of the
    shingles at a time; what is returned is a spanning forest of the components met.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0].reset_index(drop=True), pdf[pdf["side"] == 1].reset_index(drop=True)
        edges: list[tuple[int, int]] = []
        if len(left) and len(right):
            nl, nr = (np.array([len(x) for x in side["shingles"]]) for side in (left, right))
            tl, tr = np.concatenate(left["shingles"].to_list()), np.concatenate(right["shingles"].to_list())
            rl, rr = np.repeat(np.arange(len(left)), nl), np.repeat(np.arange(len(right)), nr)
            common = np.intersect1d(tl, tr)
            both = np.zeros((len(left), len(right)), np.float32)
            for at in range(0, len(common), SLICE):
                part = common[at : at + SLICE]
                sides = []
                for t, r, n in ((tl, rl, len(left)), (tr, rr, len(right))):
                    k = np.minimum(np.searchsorted(part, t), len(part) - 1)
                    hit = part[k] == t
                    m = np.zeros((n, len(part)), np.float32)
                    m[r[hit], k[hit]] = 1
                    sides.append(m)
                both += sides[0] @ sides[1].T
            near = both * 100 >= (nl[:, None] + nr[None, :] - both) * percent
            a, b = np.nonzero(near & (left["comp"].to_numpy()[:, None] != right["comp"].to_numpy()[None, :]))
            ca, cb = left["comp"].to_numpy()[a], right["comp"].to_numpy()[b]
            _, one = np.unique(np.stack((np.minimum(ca, cb), np.maximum(ca, cb))), axis=1, return_index=True)
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            for k in one.tolist():
                x, y = root(int(ca[k])), root(int(cb[k]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    edges.append((int(left["rep"][a[k]]), int(right["rep"][b[k]])))
        return pd.DataFrame({"a": pd.Series([e[0] for e in edges], dtype="int64"), "b": pd.Series([e[1] for e in edges], dtype="int64")})

    return run


def _blocks(scratch: Scratch, leftover: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows (pivot, o, m, side, rep, comp): outsiders of each large group against all its members, in blocks.

    Nodes of one pivot are one group. Outsiders are the members that do not belong to the
    group's largest component; pairs of members inside that one need no comparison.
    """
    group = leftover.select("pivot", "rep").distinct().join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    group = scratch.save(group.select("pivot", "rep", F.coalesce("component", "rep").alias("comp")), "groups")
    per = group.groupBy("pivot", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = per.groupBy("pivot").agg(F.max(F.struct("n", "comp")).alias("x"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    chunks = [F.ceil(c / BLOCK).cast("int").alias(name) for c, name in ((F.col("all") - F.col("x.n"), "os"), (F.col("all"), "ms"))]
    main = scratch.save(main.select("pivot", F.col("x.comp").alias("main"), *chunks), "mains")
    rows = group.join(main, "pivot")
    o, m = F.pmod(F.xxhash64("rep"), F.col("os")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("ms")).cast("int")
    out = rows.filter("comp <> main").select("pivot", o.alias("o"), F.explode(F.sequence(F.lit(0), F.col("ms") - 1)).alias("m"), F.lit(0).alias("side"), "rep", "comp")
    members = rows.select("pivot", F.explode(F.sequence(F.lit(0), F.col("os") - 1)).alias("o"), m.alias("m"), F.lit(1).alias("side"), "rep", "comp")
    return scratch.save(out.union(members), "blocks")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, recall: float = 0.9999, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "paths")
    trees, least = trees_for(percent / 100, recall), least_bits(percent / 100)
    picks = trees * (1 + BRANCH * (LEVELS - 1))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_shingles long, f1 long, f2 long, s0 long, s1 long, s2 long, s3 long, sig array<int>"
    all_rows = scratch.save(docs.mapInArrow(_signatures(shingle, picks), schema), "signatures")

    real = all_rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.save(real.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = real.join(classes, ["n_shingles", "f1", "f2"]).filter("doc_id = rep").dropDuplicates(["rep", "f1", "f2"])
    reps = scratch.save(reps.select("rep", F.col("n_shingles").alias("n"), "s0", "s1", "s2", "s3", "sig"), "reps")

    slim = ["node", "rep", "n", "s0", "s1", "s2", "s3"]
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("t")
    rows = reps.select("*", tree).withColumn("node", F.xxhash64("t", F.element_at("sig", F.col("t") + 1)))
    found, large, level_tables = [], None, []
    for level in range(LEVELS):
        stats = rows.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rep", "n", "s0", "s1", "s2", "s3")).alias("p")).filter("c > 1")
        stats = scratch.save(stats, f"stats{level}")
        level_tables.append(stats)
        small = rows.select(slim).join(stats.filter(F.col("c") <= limit).select("node"), "node", "left_semi")
        a, b = small.alias("a"), small.alias("b")
        pairs = a.join(b, (F.col("a.node") == F.col("b.node")) & (F.col("a.rep") < F.col("b.rep")) & _alike("a", "b", least, percent))
        found.append(scratch.save(pairs.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), _bits("a", "b").alias("bits")), f"small{level}"))
        big = stats.filter(F.col("c") > limit)
        if big.isEmpty():
            break
        member = rows.join(big, "node").select("*", F.col("p.rep").alias("pivot"))
        bits = F.lit(2 * SKETCH) - sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"p.s{k}"))) for k in range(4)), F.lit(0))
        near = (F.least("n", "p.n") * 100 >= F.greatest("n", "p.n") * percent) & (bits >= least)
        member = scratch.save(member.select(*slim, "sig", "t", "c", "pivot", bits.alias("bits"), near.alias("near")), f"member{level}")
        level_tables.append(member)
        found.append(scratch.save(member.filter("near AND rep > pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b"), "bits"), f"stars{level}"))
        closed = member.filter("near").groupBy("node", "c").agg(F.count(F.lit(1)).alias("m")).filter("m = c").select("node")
        closed = scratch.save(closed, f"closed{level}")
        still = member.join(closed, "node", "left_anti")
        last = level + 1 == LEVELS
        rest = member if last else member.join(closed, "node", "left_semi")
        rest = scratch.save(rest.select("pivot", "rep").distinct(), f"rest{level}")
        large = rest if large is None else large.union(rest)
        if not last:
            first = trees + level * trees * BRANCH
            branch = F.explode(F.sequence(F.lit(0), F.lit(BRANCH - 1))).alias("branch")
            pick = F.element_at("sig", F.lit(first + 1) + F.col("t") * BRANCH + F.col("branch"))
            rows = still.select("rep", "n", "s0", "s1", "s2", "s3", "sig", "t", "node", branch).withColumn("node", F.xxhash64("node", "branch", pick)).drop("branch")
            rows = scratch.save(rows, f"rows{level + 1}")
            level_tables.append(rows)

    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.union(more)
    candidates = scratch.save(candidates.groupBy("a", "b").agg(F.max("bits").alias("bits")), "candidates")
    scratch.drop(*found, *level_tables)
    # The likeliest partner of each document first; then only what this has not connected.
    first = candidates.groupBy("b").agg(F.max(F.struct("bits", (-F.col("a")).alias("m"))).alias("best")).select((-F.col("best.m")).alias("a"), "b")
    first = scratch.save(first, "first")
    sets = sets_of(scratch, docs, _ends(first), shingle)
    forest = _roots(scratch, confirm(first, sets, percent))
    joined = scratch.save(forest.select("node", "component"), "joined")
    scratch.drop(forest)
    open_pairs = scratch.save(_apart(candidates.select("a", "b"), joined), "open")
    blocks = _blocks(scratch, large, joined) if large is not None else None
    if blocks is None or blocks.isEmpty():
        blocks, wanted = None, _ends(open_pairs)
    else:
        wanted = _ends(open_pairs).union(blocks.select(F.col("rep").alias("doc_id")))
    if blocks is not None or not open_pairs.isEmpty():
        # Texts are fetched once: sets that the first step made are used again.
        wanted = scratch.save(wanted.distinct(), "wanted")
        again = sets.join(wanted, "doc_id", "left_semi")
        sets = again.union(sets_of(scratch, docs, wanted.join(_ends(first), "doc_id", "left_anti"), shingle))
        links = confirm(open_pairs, sets, percent)
        if blocks is not None:
            full = blocks.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
            links = links.union(full.groupBy("pivot", "o", "m").applyInPandas(_block_links(percent), "a long, b long"))
        links = scratch.save(links, "links")
        ca, cb = joined.toDF("a", "ca"), joined.toDF("b", "cb")
        between = links.join(ca, "a", "left").join(cb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        merged = scratch.save(components(scratch, between), "merged")
        # Roots that the second links joined, then everything below a root.
        below = joined.join(merged.toDF("component", "top"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        joined = scratch.save(below.union(merged.join(joined, "node", "left_anti")), "rejoined")

    scratch.keep_only(all_rows, classes, joined)
    key = ["n_shingles", "f1", "f2"]
    out = all_rows.select("doc_id", *key).join(classes, key, "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    linked = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(linked, "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components so far."""
    ca, cb = joined.toDF("a", "ca"), joined.toDF("b", "cb")
    both = pairs.join(ca, "a", "left").join(cb, "b", "left")
    return both.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

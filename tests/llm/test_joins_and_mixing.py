import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import chosen_path, mixture, nn_descent
from strata.llm import scratch as scratch_module
from strata.llm.components import components
from strata.llm.scratch import Scratch


def find_all(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + k, 401 + k) for k in range(60)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    got = components(Scratch(spark, "cc"), spark.createDataFrame(edges, "a long, b long")).collect()
    want = find_all(600, edges)
    assert {r.node: r.component for r in got} == {x: want[x] for e in edges if e[0] != e[1] for x in e}
    assert components(Scratch(spark, "cc"), spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


@pytest.mark.parametrize("shingle,percent,limit", [(3, 85, 16), (5, 80, 4)])
def test_near_documents_against_all_pairs(spark, shingle, percent, limit):
    rng = random.Random(shingle)
    shared = " ".join(f"license{k}" for k in range(40))
    texts = []
    for g in range(30):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 40, 150]))]
        for _ in range(rng.choice([1, 2, 5, 24])):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words) + (" " + shared if g % 3 == 0 else ""))
    texts += [None, "", " \n", "one", "ONE", "one two", "one two", texts[0], texts[0].upper(), "word " * 4000, "word " * 4001]
    sets = [shingles(t, shingle) for t in texts]
    links = []
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    want = find_all(len(texts), links)
    docs = spark.createDataFrame([(k, t, 0, 0) for k, t in enumerate(texts)], "doc_id long, text string, n int, rep int").repartition(4)
    got = {r.doc_id: r for r in chosen_path.near_duplicates(docs, shingle, percent, limit=limit).collect()}
    assert {k: got[k].n_shingles for k in got} == {k: len(s) for k, s in enumerate(sets)}
    assert {k: got[k].component_id for k in got} == dict(enumerate(want))
    assert all(got[k].kept == (want[k] == k) for k in got)


def test_near_documents_defined_cases(spark):
    schema = "doc_id long, text string"
    assert chosen_path.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "g h i j k l"), (1, "g h i j k l")] + [(5, "r s t u v w")] * 40
    got = chosen_path.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 45 and {(r.doc_id, r.component_id) for r in got} == {(None, None), (1, 1), (2, 1), (5, 5)}


def test_trees_reach_the_recall():
    met = 0.85 * (1 - 0.15**chosen_path.BRANCH) ** (chosen_path.LEVELS - 1)
    assert (1 - met) ** chosen_path.trees_for(0.85, 0.9999) <= 1e-4


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [rng.standard_normal(16) for _ in range(150)]
    for g in range(12):
        rows += [rows[g] + rng.standard_normal(16) * 0.12 for _ in range(20 if g == 0 else 3)]
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = (x @ x.T) >= 0.9
    np.fill_diagonal(s, False)
    n = len(rows)
    want = find_all(n, list(zip(*np.nonzero(s))))
    table = [(k, [float(v) for v in r]) for k, r in enumerate(rows)]
    table += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [1.0, None]), (1005, [1e300] * 8), (1006, [1e-300] * 8), (1007, [float("inf")] * 3), (None, [1.0]), (1010, [2.0, 1.0]), (1009, [2.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in table], "vec_id long, embedding array<double>, rep string, w int").repartition(3)
    got = {r.vec_id: r for r in nn_descent.near_duplicates(df, k=6, trees=4).collect()}
    assert {k: got[k].n_links for k in range(n)} == dict(enumerate(s.sum(1).tolist()))
    assert {k: got[k].component_id for k in range(n)} == dict(enumerate(want))
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in (1000, 1001, 1002, 1003, 1004, 1007))
    assert (got[1005].component_id, got[1006].component_id, got[1006].n_links) == (1005, 1005, 1)
    assert (got[1010].component_id, got[1010].kept, got[1009].kept, got[1009].n_links) == (1009, False, True, 1)
    assert got[None].component_id is None and not got[None].kept
    assert nn_descent.near_duplicates(df.limit(0)).count() == 0


def brute(x, threshold=0.9):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (x @ x.T) >= threshold
    np.fill_diagonal(s, False)
    return s.sum(1).tolist(), find_all(len(x), list(zip(*np.nonzero(np.triu(s)))))


def as_table(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("block", [nn_descent.BLOCK, 16])
def test_links_between_groups_whose_lists_are_full(spark, monkeypatch, block):
    monkeypatch.setattr(nn_descent, "BLOCK", block)
    rng = np.random.default_rng(2)
    a, b = np.eye(24)[0], np.eye(24)[0] * 0.93 + np.eye(24)[1] * np.sqrt(1 - 0.93**2)
    x = np.array([c + rng.standard_normal(24) * 0.012 for c in (a, b) for _ in range(30)])
    assert brute(x) == ([59] * 60, [0] * 60)
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_duplicates(as_table(spark, x)).collect()}
    assert got == {k: (59, 0) for k in range(60)}


@pytest.mark.parametrize("block,bits", [(nn_descent.BLOCK, 0), (64, 6)])
def test_thousands_of_planted_links(spark, monkeypatch, block, bits):
    """Tight groups, loose ones without a centre, a chain, pairs across groups and rows apart, on trees and on one block."""
    monkeypatch.setattr(nn_descent, "BLOCK", block)
    rng = np.random.default_rng(8)
    d = 32

    def around(c, n, noise):
        return [c + rng.standard_normal(d) * noise * np.linalg.norm(c) / math.sqrt(d) for _ in range(n)]

    base = [rng.standard_normal(d) for _ in range(900)]
    rows = list(base)
    for c, n, noise in ((base[0], 150, 0.1), (base[1], 60, 0.25), (base[2], 40, 0.32), *((base[k], 3, 0.15) for k in range(3, 60))):
        rows += around(c, n, noise)
    u, v = base[70] / np.linalg.norm(base[70]), base[71] - (base[71] @ base[70]) / (base[70] @ base[70]) * base[70]
    rows += [math.cos(t) * u + math.sin(t) * v / np.linalg.norm(v) for t in np.linspace(0, 2.5, 90)]  # a chain: neighbours link, ends do not
    x = np.array(rows)
    n_links, group = brute(x)
    assert sum(n_links) > 2 * 10_000 and nn_descent.bits_for(len(x)) == bits
    got = {r.vec_id: r for r in nn_descent.near_duplicates(as_table(spark, x), k=5, trees=8).collect()}
    found = sum(min(got[k].n_links, n) for k, n in enumerate(n_links)) / sum(n_links)
    assert all(got[k].n_links <= n for k, n in enumerate(n_links)) and found >= 0.999
    if not bits:
        assert found == 1.0
    assert sum(got[k].component_id == g for k, g in enumerate(group)) >= 0.998 * len(x)
    assert got[0].recall >= 0.99


def test_crowded_buckets_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 8)
    monkeypatch.setattr(nn_descent, "bits_for", lambda total: 1)
    x = np.array([[1.0, 0.02 * k, 0.3 * (k % 3)] for k in range(120)])
    n_links, group = brute(x, 0.98)
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_duplicates(as_table(spark, x), 0.98).collect()}
    assert got == {k: (n_links[k], group[k]) for k in range(120)}


def test_members_of_balls_link_with_each_other(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 32)
    rng = np.random.default_rng(3)
    x = np.array([rng.standard_normal(16) + 14 * np.eye(16)[k % 5] for k in range(400)])
    scratch = Scratch(spark, "balls")
    classes = as_table(spark, x).withColumnRenamed("vec_id", "rep")
    balls = defaultdict(list)
    for r in nn_descent.gather(scratch, classes, 400, 0.9, 1).collect():
        balls[r.ball].append(r.rep)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert sum(map(len, balls.values())) == 400 and max(map(len, balls.values())) > 1
    for ball, reps in balls.items():
        assert ball in reps and (u[reps] @ u[reps].T >= 0.9).all()


def test_trees_grow_with_the_table():
    for rows in (2_000, 200_000, 2_000_000, 20_000_000):
        bits = nn_descent.bits_for(rows)
        met = (1 - math.acos(0.9) / math.pi) ** bits
        assert (1 - met) ** nn_descent.trees_for(bits, 0.9) <= 1 - nn_descent.RECALL
    assert nn_descent.trees_for(0, 0.9) == 1


def test_audit_is_by_query_and_a_missed_target_is_an_error(spark, monkeypatch):
    rows = [(k, 1, [1.0, 0.001 * k, 0.0]) for k in range(20)] + [(30 + k, 1, [0.0, 0.01 * k, 1.0]) for k in range(2)]
    classes = spark.createDataFrame(rows, "rep long, w long, embedding array<double>")
    counts = spark.createDataFrame([(k, 19) for k in range(20)], "rep long, n long")
    assert nn_descent.audit(classes, counts, 0.9, 1000) == (20 / 22, 22)  # of links, 380 of 382
    monkeypatch.setattr(nn_descent, "audit", lambda *_: (0.95, 22))
    monkeypatch.setattr(nn_descent, "BLOCK", 8)
    with pytest.raises(RuntimeError, match="0.9500 of 22"):
        nn_descent.near_duplicates(classes.selectExpr("rep AS vec_id", "embedding"), forests=2)


def test_refinement_finds_neighbours_of_neighbours_and_lists_grow(spark):
    scratch = Scratch(spark, "refine")
    units = spark.createDataFrame([(k, [1.0, 0.01 * k], 0.0) for k in range(12)], "ball long, embedding array<double>, r double")
    chain = scratch.save(spark.createDataFrame([(k, k + 1, 0.99, True) for k in range(11)], nn_descent.EDGE), "chain")
    got = nn_descent.refine(scratch, chain, units, 3, 0.5, 0.9, 12)  # lists of 3, each of 11 possible partners
    assert got.select("u", "v").distinct().count() == 66 == got.filter("link").count()


def test_vectors_of_one_id_are_vectors_of_their_own(spark):
    rows = [(7, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (9, [0.02, 1.0]), (3, [1.0, 0.01])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(3, 1, 3), (7, 1, 3), (7, 2, 7), (7, 2, 7), (9, 2, 7)]


# Mixing


def water(sizes, weights=(1, 2, 3), most=3):
    """Targets by repeated resharing; sizes in source order."""
    w = {k: weights[k % len(weights)] for k in range(len(sizes))}
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        level = left / sum(w[k] for k in free)
        over = {k for k in free if level * w[k] > most * sizes[k]}
        if not over:
            for k in free:
                target[k] = level * w[k]
            break
        for k in over:
            target[k] = most * sizes[k]
            left -= target[k]
        free -= over
    return target


def test_mixture(spark):
    rng = random.Random(9)
    names = ["Z", "a", "b", "é", "\U0001f600", None]
    rows, k = [], 0
    for s, n in zip(names, (200, 20, 3, 60, 1, 90)):
        for _ in range(n):
            rows.append((k, s, " ".join(["w"] * rng.choice([1, 4, 30, 80])), "keep", 7))
            k += 1
    rows += [(k, "a", None, "x", 7), (k + 1, "zero", "", "x", 7), (0, "Z", rows[0][2], "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size string, sid int").repartition(5)
    got = mixture.plan(df, block_words=150, shards=5).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, s, t, *_ in rows:
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = dict(zip(order, water([size[s] for s in order])))
    source = {r[0]: r[1] for r in rows}
    taken, places = defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size
        assert len(r.shards) * r.size == r.taken
        taken[s] += r.taken
        for p in r.shards:
            places[p] += 1
    for s in want:
        assert abs(taken[s] - want[s]) <= 40, s
    assert set(places) == set(range(5))
    again = mixture.plan(df.repartition(2), block_words=150, shards=5).collect()
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixture.mix(df, block_words=150, shards=5)
    assert mixed.columns == df.columns
    assert mixed.filter("doc_id > 0").count() == sum(r.taken // r.size for r in got if r.size and r.doc_id)
    assert mixture.plan(df.limit(0)).count() == 0 == mixture.mix(df.limit(0)).count()


def test_shards_hold_their_quotas_and_are_shuffled(spark):
    rng = random.Random(1)
    rows = [(k, "abc"[k % 3], " ".join(["w"] * rng.randrange(1, 60))) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    scratch = Scratch(spark, "quotas")
    sized, key, placed, chosen, _ = mixture._plan(scratch, df, (1, 2, 3), 3, 200, 7, 5)
    drawn, quota = defaultdict(int), defaultdict(int)
    for r in placed.collect():
        for p in r.placed:
            drawn[r.sid, p.shard] += 1
    assert len({(r.sid, r.block, p["pass"]) for r in placed.collect() for p in r.placed}) == sum(drawn.values())
    blocks = defaultdict(int)
    for (sid, _), n in drawn.items():
        blocks[sid] += n
    rows_of = mixture._split(spark.createDataFrame(list(blocks.items()), "sid int, q long"), 7, 5).collect()
    for r in rows_of:
        quota[r.sid, r.shard] = r.q
    assert dict(drawn) == dict(quota)
    planned = defaultdict(list)
    for r in mixture.plan(df, block_words=200, shards=7, seed=5).collect():
        for s in r.shards:
            planned[s].append(r.doc_id)
    mixed = mixture.mix(df, block_words=200, shards=7, seed=5, shard_column="shard").collect()
    dealt = defaultdict(list)
    for r in mixed:
        dealt[r.shard].append(r.doc_id)
    assert {s: sorted(d) for s, d in dealt.items()} == {s: sorted(d) for s, d in planned.items()}
    assert [r.shard for r in mixed] == sorted((r.shard for r in mixed), key=[r.shard for r in mixed].index)  # each shard in one run
    apart = sum(a != b for d in dealt.values() for a, b in zip(d, d[1:])) / (len(mixed) - 7)
    assert apart > 0.9 and all(d != sorted(d) for d in dealt.values())
    again = [(r.shard, r.doc_id) for r in mixture.mix(df.repartition(2), block_words=200, shards=7, seed=5, shard_column="shard").collect()]
    assert sorted(again) == sorted((r.shard, r.doc_id) for r in mixed)
    assert [d for s, d in again if s == 3] == dealt[3]


def test_running_sums_in_slices(spark, monkeypatch):
    monkeypatch.setattr(mixture, "SLICES", 4)
    rows = mixture._permuted(spark.range(200).selectExpr("id % 3 AS sid", "id AS block", "id AS q"), 1, "sid", "block")
    got = mixture._running(rows, ["sid"], "__slice", ["__p", "block"], "q", "cum").collect()
    for sid in range(3):
        mine = sorted((r for r in got if r.sid == sid), key=lambda r: r.cum)
        assert [r.cum - r.q for r in mine] == [0, *(r.cum for r in mine)][: len(mine)] and len(mine) in (66, 67)


def test_the_plan_of_a_mixture_is_native(spark):
    df = spark.createDataFrame([(1, "a", "x y")], "doc_id long, source string, text string")
    plan = mixture.plan(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_splits_are_exact_and_follow_the_distribution(spark):
    q = {1: 4000, 2: 1000, 3: 7}
    counts = spark.createDataFrame(list(q.items()), "sid int, q long")
    shares = []
    for seed in range(12):
        rows = mixture._split(counts, 8, seed).collect()
        each = defaultdict(dict)
        for r in rows:
            each[r.sid][r.shard] = r.hi
        for s in q:
            assert max(each[s].values()) == q[s]
        part, before = defaultdict(int), 0
        for shard in sorted(each[1]):
            part[shard] = each[1][shard] - before
            before = each[1][shard]
        shares += list(part.values())
    total = sum(q.values())
    sd = np.sqrt(total / 8 * (4000 / total) * (1 - 4000 / total) * (1 - 1 / 8))
    assert abs(np.mean(shares) - 500) < 1 and 0.7 * sd < np.std(shares) < 1.3 * sd


def test_a_draw_matches_the_exact_distribution(spark):
    from math import comb

    draw = mixture._hypergeometric("q", "total", "n", "u")
    df = spark.range(2000).select(F.lit(6).cast("long").alias("q"), F.lit(20).cast("long").alias("total"), F.lit(9).cast("long").alias("n"), ((F.col("id") + 0.5) / 2000).alias("u"))
    got = {r.x: r["count"] for r in df.select(F.expr(draw).alias("x")).groupBy("x").count().collect()}
    for x in range(7):
        assert abs(got.get(x, 0) - 2000 * comb(6, x) * comb(14, 9 - x) / comb(20, 9)) < 2


# Rows by id


@pytest.mark.parametrize("bits", [scratch_module.BITMAP, 1 << 6])
def test_rows_by_ids_whether_the_bitmap_settles_much_or_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(scratch_module, "BITMAP", bits)
    rows = spark.range(3000).selectExpr("id * 7 - 700 AS doc_id", "'x' AS __page", "id AS ids").union(spark.sql("SELECT CAST(NULL AS BIGINT), 'y', 0L"))
    ids = spark.range(0, 21000, 21).selectExpr("id AS doc_id").union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    scratch = Scratch(spark, "ids")
    for how in ("left_semi", "left_anti"):
        got = scratch_module.by_ids(scratch, rows, ids, how)
        assert got.columns == rows.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(ids, "doc_id", how).select(rows.columns).collect()))
    assert scratch_module.by_ids(scratch, rows, ids.limit(0), "left_anti").count() == 3001
    plan = scratch_module.by_ids(scratch, rows, ids, "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and "SortMergeJoin" in plan

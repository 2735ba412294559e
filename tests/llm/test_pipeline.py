import random
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from strata.llm import language_id, queries  # noqa: E402
from strata.llm.encode import load  # noqa: E402

WORDS = {
    "en": "the with which thing would shall there whether through thought".split(),
    "fr": "le est très façon élève où garçon toujours français déjà".split(),
}
ITEM = "a question about seven old bridges over the river that nobody has crossed twice since the long winter of the great flood"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, folder, rows = random.Random(1), tmp_path_factory.mktemp("corpus"), []
    for k in range(120):
        lang = list(WORDS)[k % 2]
        rows.append((k, " ".join(f"{rng.choice(WORDS[lang])}{rng.choice('aeiou')}{rng.choice('nrst')}" for _ in range(40)), lang, f"s{k % 4}"))
    rows += [(200 + k, rows[2][1].upper() if k % 2 else rows[2][1] + " more", "en", "s1") for k in range(30)]
    rows += [(300, "12345 !!!", "en", "s0"), (301, None, "en", "s0"), (302, "", None, None)]
    rows += [(400 + k, rows[k][1] + " " + ITEM + " " + rows[k + 2][1], "en", "s2") for k in range(5)]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), {r[0]: r for r in rows}


def test_stages_in_order(spark, corpus):
    folder, rows = corpus
    docs = queries.table(spark, folder, "documents")
    columns, left = docs.columns, set(rows)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns, name
        ids = [r.doc_id for r in docs.collect()]
        assert len(ids) == len(set(ids))
        gone, left = left - set(ids), set(ids)
        want = {"language_id": {300, 301, 302}, "near_dedup": {200 + k for k in range(30)}, "decontaminate": {400 + k for k in range(5)}}[name]
        assert gone == want, name
    mixed = corpus_pipeline.to_weights(spark, docs, folder).cache()
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= left
    out = corpus_pipeline.to_token_files(spark, mixed, folder).collect()
    enc = load(queries.vocabulary())
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in mixed.collect())
    for r in out:
        ids = [*np.frombuffer(enc.encode(rows[r.doc_id][1]), enc.dtype), 2]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_run_equals_the_stages_and_reruns_agree(spark, corpus):
    folder, _ = corpus
    one, two = ({(r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()} for _ in range(2))
    assert one and one == two


CLASHING = ["rejected", "lang_pred", "score", "kept", "component_id", "shard", "h", "sid", "size", "taken", "copies", "edge", "c0", "n_tokens", "__bits", "tree", "code"]


@pytest.mark.parametrize("kept", ["all", "none"])
def test_clashing_columns_nulls_repeats_and_empty_tables(spark, corpus, tmp_path, kept):
    folder, rows = corpus
    docs = queries.table(spark, folder, "documents")
    docs = docs.union(docs.filter("doc_id < 3")).union(docs.filter("doc_id = 5").selectExpr("CAST(NULL AS BIGINT) doc_id", "text", "lang", "source", "n_chars"))
    docs = docs.selectExpr("*", *(f"concat('{c}', doc_id) AS `{c}`" for c in CLASHING)).limit(0 if kept == "none" else 10**9)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder).cache()
        if name != "token_files":
            assert docs.schema.simpleString() == before.schema.simpleString(), name
            assert docs.exceptAll(before.dropDuplicates()).dropDuplicates().join(before.select("doc_id", "rejected"), ["doc_id", "rejected"], "left_anti").filter("doc_id IS NOT NULL").isEmpty()
        if name == "near_dedup" and kept == "all":
            got = [r.doc_id for r in docs.select("doc_id").collect()]
            assert None in got or 5 in got
            assert sum(d in (5, None) for d in got) == 1 and all(got.count(d) == 1 for d in (0, 1))
            assert sum(d == 2 or d is not None and 200 <= d < 230 for d in got) == 1
    assert (docs.count() == 0) == (kept == "none")


def test_no_benchmark_at_all(spark, corpus, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = queries.table(spark, corpus[0], "documents")
    assert corpus_pipeline.no_benchmark(spark, docs, str(tmp_path)).count() == docs.count()


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mixture", "token_files"]
    assert corpus_pipeline.ORACLE_SQL is None and language_id.UND == "und"

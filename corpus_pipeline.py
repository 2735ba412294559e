"""A corpus pipeline of five stages, each an operator of strata.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import chosen_path, decontaminate, language_id, mixture, queries, token_files
from strata.llm.scratch import Scratch, by_ids


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those the classifier rejects go.

    Learned from text and lang of the documents that are not held out, predicted from whole
    texts. A null text, or one without letters, goes; a null lang or source does not matter;
    repeated rows fare alike; where nothing can be learned every document goes; an empty
    table gives an empty one. All columns come back, whatever their names.
    """
    return language_id.recognised(docs, language_id.fit(docs, ~language_id.held_out()))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8, whole texts) stays: the one of the smallest doc_id.

    Rows that repeat a doc_id, or have none, are documents of their own: of equal ones one
    row stays. A null text, or one without words, has no duplicates and stays. An empty
    table gives an empty one. All columns come back, whatever their names.
    """
    scratch = Scratch(spark, "one")
    names = [f"c{k}" for k in range(len(docs.columns))]
    key, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    rows = docs.toDF(*names).withColumn("doc_id", F.col(key).cast("long"))
    repeated = rows.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    repeated = scratch.save(repeated, "repeated")
    low = rows.agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("null")).first()
    if low.null or not repeated.isEmpty():
        # Numbers of their own, below all ids, for rows that an id does not tell apart.
        odd = by_ids(scratch, rows, repeated, "left_semi").union(rows.filter("doc_id IS NULL"))
        odd = scratch.save(odd.withColumn("doc_id", F.lit((low.low or 0) - 1) - F.monotonically_increasing_id()), "odd")
        rows = by_ids(scratch, rows.filter("doc_id IS NOT NULL"), repeated, "left_anti").union(odd)
    gone = chosen_path.near_duplicates(rows.select("doc_id", F.col(text).alias("text"))).filter("NOT kept").select("doc_id")
    return by_ids(scratch, rows, gone, "left_anti").select(names).toDF(*docs.columns)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, word for word or re-parameterised, in any letter case.

    Each row is judged by its own whole text, whatever its doc_id; null and empty texts, and
    all rows where the benchmark is empty, stay. All columns come back, whatever their names.
    """
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"), case_blind=True)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets; a document stands as often as it is taken, by shard, shuffled within.

    A null source is a source of its own; a null text, or one without words, is never taken;
    repeated rows are documents of their own, taken alike; an empty table gives an empty one.
    All columns come back, whatever their names.
    """
    return mixture.mix(docs)


def to_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, as read back: doc_id, start, n_tokens, ids_crc32, shard.

    A null text is the end id alone; a null doc_id stands first; rows that repeat a doc_id
    each have their ids; other columns are ignored; an empty table gives no file and no row.
    """
    return token_files.round_trip(docs, queries.vocabulary())


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each),
    ("decontaminate", no_benchmark),
    ("mixture", to_weights),
    ("token_files", to_token_files),
]

#: No SQL expresses these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, name)
    return docs

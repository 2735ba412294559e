"""Token totals by source, language and tokenizer version, maintained from signed changes.

A change is an insert (+1 document, +n tokens), a delete (-1, -n) or a revision (0, new -
old). A batch of changes is summed by group before anything is kept, written to a staging
folder and published by one rename to the folder of its batch id. A batch id that is
already published is left alone, so a batch may be sent any number of times. Totals are
the sums over published batches. Compaction sums what is published into a base, published
by one rename too, that remembers the ids of its batches; a batch that a base holds counts
there and nowhere else, so neither a crash between the steps nor a late writer of an old
id changes a total.

A change may stand for several equal documents, by a column `docs`.

Defined cases: null source or language are groups of their own; a null text has 0 tokens;
repeated rows in one batch count each time; an empty batch publishes nothing but its id;
groups that have come down to no document and no token are left out; a null count is 0.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.encode import load
from strata.llm.scratch import bound_batches

GROUP = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def _changes(counts: DataFrame, sign: int, tokens: Column) -> DataFrame:
    n = F.coalesce("docs", F.lit(1)) if "docs" in counts.columns else F.lit(1)
    return counts.select(*GROUP, (sign * n).cast("long").alias("docs"), (tokens * n).cast("long").alias("tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    return _changes(counts, 1, F.coalesce("n_tokens", F.lit(0)))


def deletes(counts: DataFrame) -> DataFrame:
    return _changes(counts, -1, -F.coalesce("n_tokens", F.lit(0)))


def revisions(counts: DataFrame) -> DataFrame:
    """Rows with n_tokens and old_tokens."""
    return _changes(counts, 0, F.coalesce("n_tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0)))


class Rollup:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/batches"))

    def _to(self, batch_id: str):
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        return self._path(f"{self.folder}/batches/{batch_id}")

    def _names(self, below: str) -> list[str]:
        at = self._path(f"{self.folder}/{below}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _base(self) -> str | None:
        """Folder of the newest base."""
        found = self._names("bases")
        return f"{self.folder}/bases/{found[-1]}" if found else None

    def _in_base(self, base: str | None) -> set[str]:
        return {r.id for r in self.spark.read.schema("id string").parquet(f"{base}/ids").collect()} if base else set()  # one id for each batch

    def published(self) -> list[str]:
        return sorted({*self._names("batches"), *self._in_base(self._base())})

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Publish a batch; False, and no work, if it is published already."""
        to = self._to(batch_id)
        if self._fs.exists(to) or batch_id in self._in_base(self._base()):  # in this order: a compaction deletes a batch after its base is there
            return False
        staged = self._path(f"{self.folder}/staging-{uuid.uuid4().hex}")
        summed = changes.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        summed.write.parquet(staged.toString())
        won = not self._fs.exists(to) and self._fs.rename(staged, to)
        if not won or self._fs.exists(self._path(to, staged.getName())):  # another writer of this id was first; a rename into its folder is undone
            self._fs.delete(self._path(to, staged.getName()) if won else staged, True)
            return False
        return True

    def _sum(self, base: str | None, batches: list[str]) -> DataFrame:
        folders = [f"{self.folder}/batches/{n}" for n in batches] + ([f"{base}/totals"] if base else [])
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*folders)
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        base = self._base()
        held = self._in_base(base)
        return self._sum(base, [n for n in self._names("batches") if n not in held]).filter("docs <> 0 OR tokens <> 0")

    def compact(self) -> bool:
        """Sum all published batches into a new base; False where another compaction was first."""
        base = self._base()
        held = self._in_base(base)
        new = [n for n in self._names("batches") if n not in held]
        if new:
            staged = f"{self.folder}/staging-{uuid.uuid4().hex}"
            self._sum(base, new).write.parquet(f"{staged}/totals")
            self.spark.createDataFrame([(x,) for x in sorted({*held, *new})], "id string").coalesce(1).write.parquet(f"{staged}/ids")
            to = f"{int(base.rsplit('/', 1)[1]) + 1 if base else 0:010d}"
            self._fs.mkdirs(self._path(f"{self.folder}/bases"))
            if self._fs.exists(self._path(f"{self.folder}/bases/{to}")) or not self._fs.rename(self._path(staged), self._path(f"{self.folder}/bases/{to}")):
                self._fs.delete(self._path(staged), True)
                return False
        for name in {*held, *new} & set(self._names("batches")):
            self._fs.delete(self._path(f"{self.folder}/batches/{name}"), True)
        return True


def count_tokens(docs: DataFrame, vocabulary: str, version: str) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_words, n_tokens of whole texts."""

    def run(batches):
        enc = load(vocabulary)
        for batch in batches:
            text = batch.column(4)
            n = [len(enc.encode(text[k].as_py())) // enc.dtype.itemsize for k in range(len(text))]
            columns = [*(batch.column(k) for k in range(3)), pa.array([version] * len(n), pa.string()), batch.column(3), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *GROUP, "n_words", "n_tokens"])

    bound_batches(docs.sparkSession)
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_words")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), words, "text")
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_words long, n_tokens long")

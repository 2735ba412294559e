"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing parquet below ``spark.checkpoint.dir``. A table that is
written there survives the loss of any executor. Where the setting is absent (unit
tests on one machine) a temporary folder is made, which goes with the process.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return (found if "://" in found or found.startswith("file:") else f"file://{found}").rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        made = tempfile.mkdtemp(prefix="strata-")
        atexit.register(shutil.rmtree, made, True)
        _FALLBACK[app] = f"file://{made}"
    return _FALLBACK[app]


BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let no batch of rows that goes to Python hold more than about BATCH_BYTES: a fixed number of rows would be far more where texts are long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(str(spark.conf.get(key)).rstrip("bB"))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


class Scratch:
    """A folder of this run below the shared one."""

    def __init__(self, spark: SparkSession, label: str):
        bound_batches(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/strata-{label}-{uuid.uuid4().hex[:12]}"
        self._n, self._tables = 0, []

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return it as read back, with its schema."""
        to = self.path(name)
        df.write.mode("overwrite").parquet(to)
        out = self.spark.read.schema(df.schema).parquet(to)
        out._strata_path = to
        self._tables.append(out)
        return out

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete every table of this run but the given ones."""
        kept = {t._strata_path for t in tables}
        self.drop(*(t for t in self._tables if t._strata_path not in kept))
        self._tables = list(tables)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in tables:
            to = getattr(df, "_strata_path", None)
            if to:
                jvm = self.spark.sparkContext._jvm
                p = jvm.org.apache.hadoop.fs.Path(to)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


BITMAP = 1 << 26  # bits: at most 8 MB are broadcast, whatever the number of ids
_PAGE = 32768  # bits of one row of the bitmap, as Spark's bitmap functions have them


def _bit(column: str, of: DataFrame | None = None) -> tuple[Column, Column]:
    """(page, position in the page) of the bit that stands for an id."""
    at = F.pmod(F.xxhash64(F.col(column) if of is None else of[column]), F.lit(BITMAP))
    return F.floor(at / _PAGE).cast("int"), F.pmod(at, F.lit(_PAGE))


def by_ids(scratch: Scratch, rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """left_semi or left_anti of wide rows with doc_id and a table of ids of any size, by one plan at every size.

    A bitmap of the ids' hashes, bounded by BITMAP, is broadcast and settles where they are
    read nearly all rows that have no id in the table; only the others are shuffled and
    joined with the ids themselves. With far more ids than bits the bitmap settles little
    and all rows are shuffled once. Rows with a null doc_id match nothing.
    """
    ids = scratch.save(ids.select("doc_id").filter("doc_id IS NOT NULL").distinct(), "ids")
    page, at = _bit("doc_id")
    pages = ids.groupBy(page.alias("__page")).agg(F.bitmap_construct_agg(at).alias("__bits"))
    pages = F.broadcast(scratch.save(pages, "bitmap"))
    page, at = _bit("doc_id", rows)
    byte = F.conv(F.hex(F.substring(pages["__bits"], F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = (page == pages["__page"]) & (F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))) % 2 == 1)
    maybe = rows.join(pages, marked, "left_semi").join(ids.hint("merge"), "doc_id", how)
    if how == "left_semi":
        return maybe.select(rows.columns)
    return rows.join(pages, marked, "left_anti").union(maybe.select(rows.columns))

"""Token ids in flat unsigned integer files with 64-bit document offsets.

Layout of a shard: ``part-NNNNNNNN.bin`` holds ids back to back (two bytes each where every
id of the vocabulary fits, else four; little-endian), ``part-NNNNNNNN.idx`` holds, as 64-bit
integers, the doc ids and then n + 1 offsets, counted in ids from the shard's start. A
manifest table names each shard with its size; the base of a shard is the prefix sum of
the sizes before it, so global positions need no second pass over the documents.

Each task writes under a name of its own and renames when done; a task that runs again
after an executor is lost replaces the file by an equal one.

Defined cases: a null or empty text is one document of the end id alone; rows that repeat
a doc_id each get their ids, ordered by a hash of the text; a null doc_id stands first (as the smallest
64-bit integer in the index, null when read back); an empty table gives no shard and no
row; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.encode import load
from strata.llm.scratch import Scratch, bound_batches

NO_ID = -(1 << 63)
SHARD_BYTES = 16 << 20  # of text, at least
MOST_SHARDS = 100_000
MANIFEST = "shard string, dtype string, first_doc long, n_docs long, n_tokens long"
INDEX = "doc_id long, start long, n_tokens long, ids_crc32 long, shard string"


def _fs(uri: str):
    from pyarrow.fs import FileSystem

    scheme, _, rest = uri.partition("://")
    return FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def _writer(out_dir: str, vocabulary: str, end_id: int):
    def write(batches):
        enc = load(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        fs, base = _fs(out_dir)
        name, own = f"part-{TaskContext.get().partitionId():08d}", f"{base}/tmp-{uuid.uuid4().hex}"
        ids, offsets, sink = [], [0], None
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                if sink is None:
                    sink = fs.open_output_stream(f"{own}.bin")
                got = enc.encode(texts[k].as_py())
                sink.write(got + end)
                doc = docs[k].as_py()
                ids.append(NO_ID if doc is None else doc)
                offsets.append(offsets[-1] + len(got) // enc.dtype.itemsize + 1)
        if sink is not None:
            sink.close()
            with fs.open_output_stream(f"{own}.idx") as f:
                f.write(np.array(ids + offsets, "<i8").tobytes())
            for kind in ("bin", "idx"):
                fs.move(f"{own}.{kind}", f"{base}/{name}.{kind}")
            row = [[name], [enc.dtype.str], [ids[0]], [len(ids)], [offsets[-1]]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["shard", "dtype", "first_doc", "n_docs", "n_tokens"])

    return write


def write_tokens(docs: DataFrame, out_dir: str, vocabulary: str, end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text) into shards below out_dir in ascending doc_id order.

    Returns the manifest (lazy: running it writes the files, so save it once).
    """
    bound_batches(docs.sparkSession)
    fs, base = _fs(out_dir)
    fs.create_dir(base, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(math.ceil(size / max(SHARD_BYTES, size / MOST_SHARDS)), rows.sparkSession.sparkContext.defaultParallelism)
    # Rows that repeat a doc_id, or have none, may be many: their texts' hashes part them among shards.
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    return rows.mapInArrow(_writer(out_dir, vocabulary, end_id), MANIFEST)


def _reader(out_dir: str):
    import zlib

    def read(batches):
        fs, base = _fs(out_dir)
        local = type(fs).__name__ == "LocalFileSystem"

        def array(name, dtype):
            if local:
                return np.memmap(f"{base}/{name}", dtype, "r")
            with fs.open_input_file(f"{base}/{name}") as f:
                return np.frombuffer(f.read_buffer(), dtype)

        for batch in batches:
            for row in batch.to_pylist():
                n = row["n_docs"]
                idx = array(f"{row['shard']}.idx", "<i8")
                ids = array(f"{row['shard']}.bin", row["dtype"])
                doc, at = idx[:n], idx[n:]
                for a in range(0, n, 10_000):
                    b = min(n, a + 10_000)
                    crc = [zlib.crc32(ids[at[k] : at[k + 1]].astype("<u4").tobytes()) for k in range(a, b)]
                    columns = [
                        pa.array([None if d == NO_ID else int(d) for d in doc[a:b]], pa.int64()),
                        pa.array(at[a:b] + row["base"], pa.int64()),
                        pa.array(np.diff(at[a : b + 1]), pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.array([row["shard"]] * (b - a), pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return read


def with_bases(manifest: DataFrame) -> DataFrame:
    """Add `base`: ids in all shards before this one. One row per shard, named in order, so one sort suffices."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, out_dir: str) -> DataFrame:
    """One row per document from the mapped files: doc_id, start, n_tokens, ids_crc32, shard."""
    based = with_bases(manifest)
    return based.repartition(based.sparkSession.sparkContext.defaultParallelism, "shard").mapInArrow(_reader(out_dir), INDEX)


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write docs to token files in the shared folder and return what the files hold."""
    scratch = Scratch(docs.sparkSession, "tokens")
    out_dir = f"{scratch.base}/files"
    manifest = scratch.save(write_tokens(docs, out_dir, vocabulary, end_id), "manifest")
    return read_tokens(manifest, out_dir)

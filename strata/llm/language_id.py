"""Language identification by nearest centroid over hashed character n-grams.

A text becomes counts of its letter bigrams and trigrams (lower-cased, words padded by a
blank) in `dims` hash buckets; counts are damped by a square root, weighted by inverse
document frequency and scaled to length 1. Each language has up to `per_lang` centroids
from spherical k-means. A text takes the language of the centroid with the largest cosine
and is rejected where that cosine lies below the centroid's radius.

The model is fitted on a bounded sample: at most about `sample_per_lang` labelled texts of
each language, chosen by a hash of the text, equal texts once. Prediction reads whole
texts of all rows and nothing but the text.

Defined cases: null text or text without letters gives `und`, score 0, rejected; so does
any text when nothing was learned. Rows with null lang are never learned from. Repeated
rows are predicted alike; ties between centroids go to the first in (lang, centroid)
order; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.scratch import bound_batches

UND = "und"
PIECE = 1 << 20  # characters of a text that are worked on at a time


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x3000)])


_LETTER: list[np.ndarray] = []


def ngram_counts(text: str, dims: int) -> np.ndarray | None:
    """Counts per bucket of the whole text, or None where it has no letter."""
    if not _LETTER:
        _LETTER.append(_letters())
    total, end = None, 0
    while end < len(text):
        at, end = end, min(len(text), end + PIECE)
        while end < len(text) and text[end].isalpha() and end < at + 2 * PIECE:  # a piece ends with a word
            end += 1
        piece = text[at:end].lower()
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = code < 0x3000
        letter = np.where(low, _LETTER[0][np.where(low, code, 0)], True)
        if not low.all():
            for k in np.flatnonzero(~low):
                letter[k] = chr(code[k]).isalpha()
        if not letter.any():
            continue
        c = np.concatenate(([0], np.where(letter, code, 0), [0])).astype(np.uint32)
        here = np.flatnonzero(c[1:-1]) + 1
        left, mid, right = c[here - 1], c[here], c[here + 1]
        two = (left * np.uint32(0x9E3779B1)) ^ (mid * np.uint32(0x85EBCA77))
        three = two ^ (right * np.uint32(0xC2B2AE3D)) ^ np.uint32(0x27D4EB2F)
        h = np.concatenate((two, three))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        got = np.bincount((h % np.uint32(dims)).astype(np.intp), minlength=dims)
        total = got if total is None else total + got
    return total


@dataclass
class Model:
    dims: int
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    radius: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out = []
        for text in texts:
            counts = ngram_counts(text, self.dims) if text and self.langs else None
            if counts is None:
                out.append((UND, 0.0, True))
                continue
            v = np.sqrt(counts, dtype=np.float32) * self.idf
            cos = self.centroids @ v / np.sqrt(v @ v)
            k = int(np.argmax(cos))
            out.append((self.langs[k], float(min(1.0, max(0.0, cos[k]))), bool(cos[k] < self.radius[k])))
        return out


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from rows that are far from those chosen before."""
    picked = [int(np.argmax(x @ x.mean(0)))]
    while len(picked) < min(k, len(x)):
        far = (x @ x[picked].T).max(1)
        if far.min() > 1 - 1e-6:
            break
        picked.append(int(np.argsort(far, kind="stable")[len(x) // 20]))
    c = x[picked]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        c = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c


def fit(docs: DataFrame, learn: Column, dims: int = 4096, per_lang: int = 3, sample_per_lang: int = 400, slack: float = 0.35) -> Model:
    """Learn from text and lang of the rows of docs where `learn` holds.

    A centroid's radius is `slack` times the cosine that 99 % of its own texts reach, so
    only texts far from anything learned are rejected.
    """
    bound_batches(docs.sparkSession)
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not sizes:
        return Model(dims, [], np.ones(dims, np.float32), np.zeros((0, dims), np.float32), np.zeros(0))
    rate = F.create_map(*[F.lit(v) for r in sizes for v in (r.lang, int(min(1.0, 1.25 * sample_per_lang / max(1, r.n)) * (1 << 30)))])
    chosen = known.filter(F.pmod(F.xxhash64("h", F.lit(7)), F.lit(1 << 30)) < F.try_element_at(rate, F.col("lang")))
    chosen = chosen.groupBy("lang", "h").agg(F.min("text").alias("text"))

    def features(batches):
        for batch in batches:
            langs, at, counts = [], [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                got = ngram_counts(text.as_py(), dims)
                if got is not None:
                    nz = np.flatnonzero(got)
                    langs.append(lang)
                    at.append(nz.astype(np.int32))
                    counts.append(got[nz].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["lang", "at", "n"])

    rows = sorted(((r.lang, tuple(r.at), tuple(r.n)) for r in chosen.mapInArrow(features, "lang string, at array<int>, n array<int>").collect()))
    x = np.zeros((len(rows), dims), np.float32)
    for k, (_, at, n) in enumerate(rows):
        x[k, list(at)] = np.sqrt(n)
    idf = (np.log((1 + len(rows)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    x *= idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = np.array([r[0] for r in rows])
    langs, centroids, radius = [], [], []
    for lang in sorted(set(own)):
        part = x[own == lang]
        c = _kmeans(part, per_lang)
        cos = part @ c.T
        near = np.argmax(cos, 1)
        for j in range(len(c)):
            mine = cos[near == j, j]
            langs.append(str(lang))
            centroids.append(c[j])
            radius.append(slack * float(np.quantile(mine, 0.01)) if len(mine) else 0.0)
    return Model(dims, langs, idf, np.array(centroids, np.float32), np.array(radius))


def held_out() -> Column:
    """The rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(df: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` of df, then lang_pred, score, rejected. Reads no column but text."""
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # dims x centroids floats, set by parameters

    def run(batches):
        m = shared.value
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            got = [m.predict([text[k].as_py()])[0] for k in range(len(text))]
            out = batch.select(range(len(keep)))
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())],
                [*names, "lang_pred", "score", "rejected"],
            )

    names = [f"c{k}" for k in range(len(keep))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep)])
    out = rows.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "lang_pred", "score", "rejected")


def recognised(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of df that the model does not reject, with all columns, whatever their names."""
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # dims x centroids floats, set by parameters
    at = df.columns.index(text)

    def run(batches):
        m = shared.value
        for whole in batches:
            for batch in (whole.slice(first, 1000) for first in range(0, whole.num_rows, 1000)):
                texts = batch.column(at)
                yield batch.filter(pa.array([not m.predict([texts[k].as_py()])[0][2] for k in range(len(texts))], pa.bool_()))

    rows = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return rows.mapInArrow(run, rows.schema).toDF(*df.columns)

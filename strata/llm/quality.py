"""Quality by ordinal regression: a cumulative-link model on hashed text.

P(grade >= k) = sigmoid(w.x - t_k) with one weight vector w for all grades and thresholds
t_1 < t_2 < ...; x holds, for the whole text, which hashed words occur and which hashed
byte trigrams, these scaled to length 1. Buckets whose share does not differ between
grades by `least_z` standard errors have no weight. Expected grade is the sum of the tail probabilities;
selection uses the tail probability of one grade.

An abusive word can only pull a text toward the grade of abusive texts, and where that lies
between two others, as in grades_of(), one or two such words in an otherwise sound text
hardly move it out of the best grade. So a second model of the same kind may veto: its
order, harm_grades(), has toxic texts at the bottom, and its first tail is the probability
of not being toxic (`safe_prob`).

Fitted on at most about `sample` graded texts, chosen by a hash of the text. Scores are
computed for every row from its whole text.

Defined cases: a null or empty text has x = 0, so the thresholds alone decide; a text
with two rows scores twice alike; documents without a rating are scored and not learned
from; of several ratings of one doc the lowest grade counts; an empty table gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.bytewords import word_hashes
from strata.llm.scratch import bound_batches

TRIGRAMS = 1 << 16  # buckets of byte trigrams
WORD_VALUE = 3.0  # of a word that occurs, beside trigrams scaled to length 1
#: Signs that end a word are blanked before words are hashed.
_STRIP = bytes(0x20 if chr(b) in ".,;:!?\"()" else b for b in range(256))


def buckets(text: str | None, word_bits: int) -> np.ndarray:
    """Sorted distinct buckets of a text: byte trigrams below TRIGRAMS, words from there on."""
    if not text:
        return np.zeros(0, np.int32)
    data = text.encode("utf-8", "surrogatepass")
    words = np.unique((word_hashes(data.translate(_STRIP)) >> np.uint64(64 - word_bits)).astype(np.int32))
    seen = np.zeros(TRIGRAMS, bool)
    for at in range(0, len(data), 1 << 21):
        b = np.frombuffer(data[at : at + (1 << 21) + 2], np.uint8).astype(np.uint32)
        if len(b) >= 3:
            h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            seen[(h >> np.uint32(16)).astype(np.intp)] = True
    return np.concatenate((np.flatnonzero(seen).astype(np.int32), words + np.int32(TRIGRAMS)))


@dataclass
class Model:
    word_bits: int
    used: np.ndarray  # buckets that have a weight
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str | None) -> np.ndarray:
        return self.tails_at(buckets(text, self.word_bits))

    def tails_at(self, at: np.ndarray) -> np.ndarray:
        at = at[self.used[at]]
        first = int(np.searchsorted(at, TRIGRAMS))
        w = self.weights[at]
        score = float(w[:first].sum()) / np.sqrt(max(1, first)) + WORD_VALUE * float(w[first:].sum())
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -50, 50)))


def screen(at: list[np.ndarray], grades: np.ndarray, n_grades: int, dims: int, least_z: float) -> np.ndarray:
    """Buckets whose share differs between the grades below and above some threshold by least_z standard errors."""
    n, lens = len(at), np.array([len(a) for a in at])
    flat = np.concatenate(at) if n else np.zeros(0, np.int32)
    df = np.bincount(flat, minlength=dims)
    keep, share = np.zeros(dims, bool), df / max(1, n)
    for k in range(1, n_grades):
        up = grades >= k
        n1 = int(up.sum())
        if 0 < n1 < n:
            above = np.bincount(flat[np.repeat(up, lens)], minlength=dims)
            error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / (n - n1)))
            keep |= (np.abs(above / n1 - (df - above) / (n - n1)) >= least_z * error) & (df >= 5)
    return keep


def fit_ordinal(at: list[np.ndarray], grades: np.ndarray, n_grades: int, word_bits: int, rounds: int = 200, rate: float = 0.1, ridge: float = 1e-3, least_z: float = 6.0) -> Model:
    """Weights and thresholds by Adam on the full sample's log likelihood of grades."""
    dims, n = TRIGRAMS + (1 << word_bits), len(at)
    thresholds = np.array([np.log((np.sum(grades < k) + 0.5) / (np.sum(grades >= k) + 0.5)) for k in range(1, n_grades)])
    used = screen(at, grades, n_grades, dims, least_z)
    weights, size = np.zeros(dims, np.float32), int(used.sum())
    if not size:
        return Model(word_bits, used, weights, thresholds)
    at = [a[used[a]] for a in at]
    lens = np.array([len(a) for a in at])
    flat, row = np.concatenate(at), np.repeat(np.arange(n), lens)
    trigram = flat < TRIGRAMS
    value = np.where(trigram, 1 / np.sqrt(np.maximum(1, np.bincount(row, trigram, n)))[row], WORD_VALUE)
    column, each = (np.cumsum(used) - 1)[flat], np.arange(n)
    theta = np.concatenate((np.zeros(size), [thresholds[0]], np.log(np.maximum(np.diff(thresholds), 1e-2))))
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def cuts() -> np.ndarray:
        return theta[size] + np.concatenate(([0.0], np.cumsum(np.exp(theta[size + 1 :]))))

    for step in range(1, rounds + 1):
        w = theta[:size]
        score = np.bincount(row, value * w[column], n)
        tail = 1 / (1 + np.exp(np.clip(cuts()[None, :] - score[:, None], -50, 50)))
        full = np.concatenate((np.ones((n, 1)), tail, np.zeros((n, 1))), 1)
        p = np.maximum(full[each, grades] - full[each, grades + 1], 1e-9)
        slope = np.concatenate((np.zeros((n, 1)), tail * (1 - tail), np.zeros((n, 1))), 1)
        up, down = slope[each, grades] / p, slope[each, grades + 1] / p
        g_score = -(up - down) / n
        g_cut = np.array([np.sum(np.where(grades == k, up, 0) - np.where(grades + 1 == k, down, 0)) / n for k in range(1, n_grades)])
        g_w = np.bincount(column, value * g_score[row], size) + ridge * w
        g_gap = np.array([np.exp(theta[size + 1 + j]) * g_cut[j + 1 :].sum() for j in range(n_grades - 2)])
        g = np.concatenate((g_w, [g_cut.sum()], g_gap))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights[used] = theta[:size]
    return Model(word_bits, used, weights, cuts())


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, word_bits: int = 20, sample: int = 8000) -> Model:
    """docs (doc_id, text), ratings (doc_id, grade in 0..n_grades-1)."""
    return fit_each(docs, [ratings], n_grades, word_bits, sample)[0]


def fit_each(docs: DataFrame, ratings: list[DataFrame], n_grades: int = 3, word_bits: int = 20, sample: int = 8000) -> list[Model]:
    """A model for each table of ratings, as fit() takes them, from one sample of the documents that any of them rates and one pass over the texts."""
    bound_batches(docs.sparkSession)
    names = [f"g{k}" for k in range(len(ratings))]
    rated = reduce(DataFrame.union, [r.filter(F.col("grade").between(0, n_grades - 1)).select("doc_id", "grade", F.lit(k).alias("k")) for k, r in enumerate(ratings)])
    least = rated.groupBy("doc_id").agg(*(F.min(F.when(F.col("k") == k, F.col("grade"))).cast("int").alias(g) for k, g in enumerate(names)))
    n = least.count()
    rate = int(min(1.0, 1.1 * sample / max(1, n)) * (1 << 30))
    few = least.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < rate)  # at most about `sample` rows: bounded by its parameter
    known = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("text", *names).agg(F.xxhash64("text").alias("key")).select("text", "key", *names)

    def features(batches):
        for batch in batches:
            text = batch.column("text")
            at = [buckets(text[k].as_py(), word_bits) for k in range(len(text))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", *names)), pa.array(at, pa.list_(pa.int32()))], ["key", *names, "at"])

    got = known.mapInArrow(features, f"key long, {', '.join(f'{g} int' for g in names)}, at array<int>").toArrow()
    at, key = [np.asarray(a.values.to_numpy(), np.int32) for a in got.column("at")], got.column("key").to_pylist()
    out = []
    for g in names:
        grade = got.column(g).to_pylist()
        once = {(key[k], grade[k]): k for k in range(len(at)) if grade[k] is not None}  # a text counts once for each of its grades
        order = sorted(once.values(), key=lambda k: (at[k].tobytes(), grade[k]))
        out.append(fit_ordinal([at[k] for k in order], np.array([grade[k] for k in order], np.intp), n_grades, word_bits))
    return out


def grades_of(labels: DataFrame) -> DataFrame:
    """Three grades from the two marks: 0 poor, 1 sound but toxic, 2 sound and clean. A null quality is no rating."""
    q, t = F.col("quality"), F.coalesce(F.col("toxic"), F.lit(0))
    grade = F.when(q.isNull(), F.lit(None)).when(q == 0, 0).when(t == 1, 1).otherwise(2)
    return labels.select("doc_id", grade.alias("grade")).filter(F.col("grade").isNotNull())


def harm_grades(labels: DataFrame) -> DataFrame:
    """Three grades in the order of harm: 0 toxic, whatever the quality, 1 poor, 2 sound and clean. A null quality is no rating unless toxic."""
    q, t = F.col("quality"), F.coalesce(F.col("toxic"), F.lit(0))
    grade = F.when(t == 1, 0).when(q.isNull(), F.lit(None)).when(q == 0, 1).otherwise(2)
    return labels.select("doc_id", grade.alias("grade")).filter(F.col("grade").isNotNull())


def score(docs: DataFrame, model: Model, select_grade: int = 2, keep_from: float = 0.4, harm: Model | None = None, safe_from: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_prob (of select_grade), safe_prob, kept: one row for each row of docs.

    With `harm`, a model of harm_grades() with as many word bits, a text below `safe_from` is not kept; without, safe_prob is null.
    """
    if harm is not None and harm.word_bits != model.word_bits:
        raise ValueError("both models need the same word bits")
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model, harm))  # twice 2^word_bits floats, set by a parameter

    def run(batches):
        m, veto = shared.value
        for batch in batches:
            text, tails, safe = batch.column(1), [], []
            for k in range(len(text)):
                at = buckets(text[k].as_py(), m.word_bits)
                tails.append(m.tails_at(at))
                safe.append(None if veto is None else float(veto.tails_at(at)[0]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.float64()) for x in ([float(t.sum()) for t in tails], [float(t[select_grade - 1]) for t in tails], safe))],
                ["doc_id", "expected_grade", "tail_prob", "safe_prob"],
            )

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, expected_grade double, tail_prob double, safe_prob double")
    return out.withColumn("kept", (F.col("tail_prob") >= keep_from) & F.coalesce(F.col("safe_prob") >= safe_from, F.lit(True)))

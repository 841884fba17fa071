"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2), through a sigmoid: the
sum-of-squares identity gives all pairwise interactions in time linear in a document's features.
Features of a whole text: its distinct words hashed to `BUCKETS` (log counts, unit length), and, one
bucket each, shares of character classes, of repeated words and windows, mean word length, and the
length as metadata. labels, lang, source and doc_id are never features.

Fitting uses at most `FIT_ROWS` labelled documents (those whose id hashes smallest), a bounded sample that
is collected; scoring maps over documents without a shuffle, with a model of about a megabyte.

Defined cases: null and empty texts are scored by the intercept and the empty structure; a doc_id
labelled more than once takes the mean of its labels (1 from a half on); null labels and ids do not
train; with no labels every score is 0.5, with one class the share of ones; repeated rows are scored
alike, and an id with several texts trains by the smallest of them; a null doc_id counts as not held out; an empty table gives
no rows; columns `score` and `predicted` of the input are replaced by `score` and others are passed through; `accepted`
returns all columns of the input as they were. doc_id is a bigint.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .store import named, numbered, table

BUCKETS = 1 << 14
LEVELS = 12
FACTORS = 8
FIT_ROWS = 6000
EPOCHS = 12
THRESHOLD = 0.3

#: Classes of bytes whose shares are statistics.
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&|<>", b"!", b"|", b"0123456789", b".,;:?", b"\n", b"=/\\{}[]()_@~^"]
N_STATS = len(_CLASSES) + 6


def _level(x: np.ndarray) -> np.ndarray:
    """A share in [0, 1] to a level: 0 for none, then by doublings from 1/512."""
    return np.where(x <= 0, 0, np.clip(np.floor(np.log2(np.maximum(x, 1e-9) * 512)) + 2, 1, LEVELS - 1)).astype(np.int64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ptr, index, value) of the features of each text."""
    w = W.split_words(texts, W.SPACED, lower=False)
    n, count = len(w.first) - 1, w.n_words
    size = np.maximum(np.diff(w.text_start), 1)
    raw = w.buf[: w.text_start[-1]] if n else w.buf[:0]
    stats = np.zeros((n, N_STATS), np.int64)
    for i, chars in enumerate(_CLASSES):
        member = np.zeros(256, bool)
        member[list(chars)] = True
        seen = np.concatenate(([0], np.cumsum(member[raw], dtype=np.int64)))
        stats[:, i] = _level((seen[w.text_start[1:]] - seen[w.text_start[:-1]]) / size)
    h = w.hash()
    of = w.text_of_word()
    some = np.maximum(count, 1)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(of[: len(flags)], weights=flags, minlength=n) / some

    at = len(_CLASSES)
    follows = np.zeros(len(h))
    follows[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    stats[:, at] = _level(share(follows))
    bucket = (h % W.U64(BUCKETS)).astype(np.int64)
    key, tf = np.unique(of * BUCKETS + bucket, return_counts=True)
    doc, index = key // BUCKETS, key % BUCKETS
    distinct = np.bincount(doc, minlength=n)
    stats[:, at + 1] = np.where(count > 0, np.clip(np.floor(-np.log2(np.maximum(distinct, 1) / some) * 3) + 1, 1, LEVELS - 1), 0)
    g = W.windows(h, 5)
    inside = W.within(w.first, 5, len(g))
    order = np.lexsort((g, of[: len(g)])) if len(g) else np.zeros(0, np.int64)
    again = np.zeros(len(g))
    again[order[1:]] = (g[order[1:]] == g[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    stats[:, at + 2] = _level(share(again * inside))
    stats[:, at + 3] = np.where(count > 0, np.clip(np.floor((np.bincount(of, weights=w.end - w.start, minlength=n) / some)), 1, LEVELS - 1), 0)
    stats[:, at + 4] = np.clip(np.floor(np.log2(np.maximum(np.diff(w.text_start), 1)) / 1.5), 0, LEVELS - 1)
    last = w.buf[w.end - 1] if len(w.end) else w.buf[:0]
    stats[:, at + 5] = _level(share((last == w.buf[np.maximum(w.end - 2, 0)]) & ~W.ALNUM[last] if len(w.end) else np.zeros(0)))
    value = np.log1p(tf)
    norm = np.sqrt(np.bincount(doc, weights=value**2, minlength=n))
    value = value / np.maximum(norm[doc], 1e-9)
    # Words first, then a document's statistics, in one row.
    ptr = np.concatenate(([0], np.cumsum(distinct + N_STATS)))
    idx, val = np.empty(ptr[-1], np.int64), np.empty(ptr[-1], np.float64)
    to = ptr[doc] + W.row_slices(np.concatenate(([0], np.cumsum(distinct))))
    idx[to], val[to] = index, value
    to = (ptr[1:, None] - N_STATS + np.arange(N_STATS)).reshape(-1)
    idx[to], val[to] = (BUCKETS + np.arange(N_STATS) * LEVELS + stats).reshape(-1), 1 / np.sqrt(N_STATS)
    return ptr, idx, val


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, ptr: np.ndarray, idx: np.ndarray, val: np.ndarray) -> np.ndarray:
        if len(ptr) < 2:
            return np.zeros(0)
        vx = self.factors[idx] * val[:, None]
        sums = np.add.reduceat(vx, ptr[:-1], axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), ptr[:-1])
        return self.bias + np.add.reduceat(self.linear[idx] * val, ptr[:-1]) + 0.5 * ((sums**2).sum(axis=1) - squares)

    def score(self, ptr, idx, val) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(ptr, idx, val), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], factors: int = FACTORS, epochs: int = EPOCHS, rate: float = 0.15, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad, small batches; rows: (index, value, label)."""
    rng, size = np.random.default_rng(seed), BUCKETS + N_STATS * LEVELS
    y = np.array([r[2] for r in rows], np.float64)
    share = y.mean() if len(y) else 0.5
    empty = Machine(float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(size), np.zeros((size, factors)))
    if not len(y) or share in (0.0, 1.0):
        return empty
    m = Machine(empty.bias, empty.linear, rng.normal(0, 0.05, (size, factors)))
    seen = [np.full(1, 1e-6), np.full(size, 1e-6), np.full((size, factors), 1e-6)]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), 64):
            batch = order[a : a + 64]
            ptr = np.concatenate(([0], np.cumsum([len(rows[i][0]) for i in batch])))
            idx, val = np.concatenate([rows[i][0] for i in batch]), np.concatenate([rows[i][1] for i in batch])
            error = m.score(ptr, idx, val) - y[batch]
            each = np.repeat(error, np.diff(ptr)) * val / len(batch)
            vx = m.factors[idx] * val[:, None]
            sums = np.repeat(np.add.reduceat(vx, ptr[:-1], axis=0), np.diff(ptr), axis=0)
            used, at = np.unique(idx, return_inverse=True)
            dl = np.bincount(at, weights=each, minlength=len(used)) + decay * m.linear[used]
            dv = np.stack([np.bincount(at, weights=each * (sums[:, f] - vx[:, f]), minlength=len(used)) for f in range(factors)], axis=1) + decay * m.factors[used]
            db = error.mean()
            seen[0] += db**2
            seen[1][used] += dl**2
            seen[2][used] += dv**2
            m.bias -= float(rate * db / np.sqrt(seen[0][0]))
            m.linear[used] -= rate * dl / np.sqrt(seen[1][used])
            m.factors[used] -= rate * dv / np.sqrt(seen[2][used])
    return m


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine:
    """A machine for labels.quality from at most fit_rows rows that are not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "text"):
                ptr, idx, val = features(part.column(1))
                lists = [pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(x)) for x in (idx.astype(np.int32), val.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *lists], ["doc_id", "y", "idx", "val"])

    known = labels.filter("quality is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # A bounded sample: fit_rows ids at most, and a text for each.
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    found = joined.mapInArrow(run, "doc_id bigint, y int, idx array<int>, val array<float>").toArrow()
    cols = [found.column(i).combine_chunks() for i in range(4)]
    rows = [(cols[0][i].as_py(), np.asarray(cols[2][i].values).astype(np.int64), np.asarray(cols[3][i].values).astype(np.float64), cols[1][i].as_py()) for i in range(found.num_rows)]
    rows.sort(key=lambda r: r[0])
    return fit([r[1:] for r in rows])


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with score and predicted."""
    docs = docs.drop("score", "predicted")
    model, column = docs.sparkSession.sparkContext.broadcast(machine), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, batch.schema.names[column]):
                s = model.value.score(*features(part.column(column)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the machine does not reject; columns of docs, whatever they are called."""
    rows, names = numbered(docs)
    return named(score(rows, machine, threshold, names["text"]).filter("predicted = 1"), names)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")

"""Benchmark decontamination with an FM-index per training shard.

A phrase is 13 consecutive words of a benchmark item (the whole item if it has fewer). A shard is a
few megabytes of documents. Its words become symbols (0 for words in no phrase), runs of words too
short to hold any phrase are left out, and an FM-index is built over the rest: suffix array,
Burrows-Wheeler transform, wavelet tree over the symbols, and every `SAMPLE`-th suffix position.
Phrases are searched backwards through wavelet-tree ranks, all at once; occurrences are located by
walking to the nearest sampled position; their spans are merged into removal spans per document.
What is located is confirmed on the words' hashes in the text.

The phrases are a stated query set: they go to tasks in blocks of at most `BLOCK_WORDS` words of
items, each a bounded broadcast, and a further block is a further pass over the documents, with a written table
between, so that no task holds more than one block. Documents never move: there is no shuffle at all.

Defined cases: a null or empty text has no words and no hits; items without words have no phrases;
repeated items and rows count each for themselves (an item_id counts once a document); an empty
benchmark or table works; null item_ids are left out. Columns of the input are carried, and those named as the findings
(`n_words`, `spans`, `items`, `n_hit`, `contaminated`) give way to them; `decontaminate` returns all columns of the input as they were, but for
the text, and n_chars where it is an integer. item_id is a bigint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .store import cut, named, numbered, table

WINDOW = 13
SAMPLE = 8
BLOCK_WORDS = 1_000_000


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector a level, highest bit of the symbol first."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.n, self.bits, self.ones, self.zeros = len(seq), bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(int(self.n - self.ones[-1][-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of each symbol stand before each position."""
        low = np.zeros(len(at), np.int64)
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((symbol >> (self.bits - 1 - i)) & 1).astype(bool)
            low = np.where(bit, zeros + ones[low], low - ones[low])
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By doubling; the end of the text sorts before every symbol. Only ties are sorted again."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    head = np.flatnonzero(np.diff(rank[order], prepend=-1))
    group = np.repeat(head, np.diff(np.append(head, n)))
    place = np.empty(n, np.int64)
    place[order] = group
    width = 1
    while True:
        size = np.diff(np.append(head, n))
        tied = np.repeat(size > 1, size)
        if not tied.any():
            return order
        where = np.flatnonzero(tied)
        pos = order[where]
        after = pos + width
        second = np.where(after < n, place[np.minimum(after, n - 1)], -1)
        by = np.lexsort((second, group[where]))
        order[where] = pos[by]
        g, s = group[where][by], second[by]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (s[1:] != s[:-1])))
        starts = where[new]
        head = np.union1d(head, starts)
        group = np.repeat(head, np.diff(np.append(head, n)))
        place[order] = group
        width *= 2


class FMIndex:
    def __init__(self, seq: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        """seq: symbols from 1; an end mark 0 is added."""
        text = np.append(seq, 0)
        sa = suffix_array(text)
        self.n = len(text)
        self.bwt = WaveletTree(text[sa - 1], max(1, int(n_symbols).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))))
        self.marked = sa % sample == 0
        self.mark_rank = np.concatenate(([0], np.cumsum(self.marked)))
        self.samples = sa[self.marked]

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """phrases: a row each, filled up on the right; the rows [from, to) of the suffix array that begin with each."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for j in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((j < length) & (low < high))
            if len(live):
                c = phrases[live, j]
                low[live] = self.before[c] + self.bwt.rank(c, low[live])
                high[live] = self.before[c] + self.bwt.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, step, left = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(left):
            at = rows[left]
            there = self.marked[at]
            out[left[there]] = self.samples[self.mark_rank[at[there]]] + step
            left, at = left[~there], at[~there]
            c = self.bwt.access(at)
            rows[left] = self.before[c] + self.bwt.rank(c, at)
            step += 1
        return out


@dataclass
class Phrases:
    """Distinct phrases of a block of items: word symbols, lengths, and the items that hold each."""

    vocabulary: np.ndarray  #: sorted word hashes; symbol i + 2 stands for vocabulary[i], 1 for any other word
    rows: np.ndarray
    length: np.ndarray
    item_ptr: np.ndarray
    items: np.ndarray


def phrases(items: list[tuple[int, str]], window: int = WINDOW) -> Phrases:
    w = W.split_words(pa.array([t or "" for _, t in items], pa.large_string()), W.ALNUM, lower=True)
    vocabulary, symbol = np.unique(w.hash(), return_inverse=True)
    count = w.n_words
    per_item = np.where(count >= window, count - window + 1, count > 0)
    of = np.repeat(np.arange(len(items)), per_item)
    if not len(of):
        return Phrases(vocabulary, np.zeros((0, window), np.int32), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64))
    start = w.first[of] + W.row_slices(np.concatenate(([0], np.cumsum(per_item))))
    rows = np.full((len(of), window), -1, np.int32)
    for j in range(window):
        more = count[of] > j
        rows[more, j] = symbol[start[more] + j]
    rows, which = np.unique(rows, axis=0, return_inverse=True)
    held = np.unique(np.stack((which.reshape(-1), np.array([i for i, _ in items], np.int64)[of]), axis=1), axis=0)
    length = (rows >= 0).sum(axis=1)
    return Phrases(vocabulary, np.where(rows >= 0, rows + 2, 1).astype(np.int32), length, np.searchsorted(held[:, 0], np.arange(len(rows) + 1)), held[:, 1])


def shard_hits(w: W.Words, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of every occurrence in a shard; words are counted over the whole shard."""
    none = np.zeros(0, np.int64)
    if not len(p.rows) or not len(w.start):
        return none, none
    h = w.hash()
    at = np.minimum(np.searchsorted(p.vocabulary, h), len(p.vocabulary) - 1)
    known = p.vocabulary[at] == h
    # Runs of known words within one text, of the shortest phrase's length at least.
    edge = np.zeros(len(h) + 1, bool)
    edge[w.first] = True
    edge[1:-1] |= known[1:] != known[:-1]
    edge[[0, -1]] = True
    cuts = np.flatnonzero(edge)
    begin, size = cuts[:-1], np.diff(cuts)
    use = known[begin] & (size >= p.length.min())
    begin, size = begin[use], size[use]
    if not len(begin):
        return none, none
    # The runs one after the other, each followed by symbol 1, which is in no phrase.
    to = np.cumsum(size + 1) - (size + 1)
    inner = W.row_slices(np.concatenate(([0], np.cumsum(size))))
    source, target = np.repeat(begin, size) + inner, np.repeat(to, size) + inner
    seq, origin = np.ones(int((size + 1).sum()), np.int64), np.full(int((size + 1).sum()), -1)
    seq[target], origin[target] = at[source] + 2, source
    index = FMIndex(seq, len(p.vocabulary) + 1)
    low, high = index.search(p.rows, p.length)
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    found = origin[index.locate(np.repeat(low, n) + W.row_slices(np.concatenate(([0], np.cumsum(n)))))]
    ok = np.ones(len(found), bool)
    for j in range(p.rows.shape[1]):
        there = np.flatnonzero(p.length[which] > j)
        ok[there] &= p.vocabulary[p.rows[which[there], j] - 2] == h[found[there] + j]
    if not ok.all():
        raise AssertionError("the index located a phrase where it does not stand")
    return found, which


_ADDED = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("items", T.ArrayType(T.LongType()))]
_OUT = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.int64()))])


def merged(spans: np.ndarray) -> list[list[int]]:
    """[from, to) rows with those that touch or overlap made one, in order."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > top[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)
    return np.stack((spans[new, 0], top[last]), axis=1).tolist()


def _scan(block, text: int, further: bool):
    """Adds n_words, spans ([from, to) words, merged) and items to the rows of a shard; further: to those of the blocks before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Phrases = block.value
        for batch in batches:
            for part in W.chunks(batch, batch.schema.names[text]):
                own = part.columns[: -len(_ADDED)] if further else part.columns
                spans, items = (part.column(len(own) + i).to_pylist() if further else [None] * part.num_rows for i in (1, 2))
                w = W.split_words(part.column(text), W.ALNUM, lower=True)
                first, which = shard_hits(w, p)
                order = np.argsort(first, kind="stable")
                of = np.searchsorted(w.first, first[order], side="right") - 1
                ends = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    i, occ = int(of[a]), order[a:b]
                    found = np.stack((first[occ], first[occ] + p.length[which[occ]]), axis=1) - w.first[i]
                    spans[i] = merged(np.concatenate((found, np.array(spans[i] or np.zeros((0, 2)), np.int64))))
                    held = [p.items[p.item_ptr[x] : p.item_ptr[x + 1]] for x in set(which[occ].tolist())]
                    items[i] = np.unique(np.concatenate([*held, np.array(items[i] or [], np.int64)])).tolist()
                more = [pa.array(w.n_words.astype(np.int64)), pa.array(spans, _OUT.field(1).type), pa.array(items, _OUT.field(2).type)]
                yield pa.RecordBatch.from_arrays([*own, *more], [*part.schema.names[: len(own)], *_OUT.names])

    return run


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of a bounded size, read one partition at a time."""
    held, size = [], 0
    for r in benchmark.filter("item_id is not null").select("item_id", "text").toLocalIterator():
        n = len(r.text or "") // 2 + 1
        if held and size + n > block_words:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += n
    yield held


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text: str = "text") -> DataFrame:
    """docs with n_words, spans (removal spans in words, merged; null if none) and items (ids found; null if none)."""
    docs = docs.drop(*_OUT.names, "n_hit", "contaminated")
    schema, column, out = T.StructType([*docs.schema.fields, *_ADDED]), docs.columns.index(text), None
    for items in _blocks(benchmark, block_words):
        block = docs.sparkSession.sparkContext.broadcast(phrases(items, window))
        out = docs.mapInArrow(_scan(block, column, False), schema) if out is None else cut(out, "block").mapInArrow(_scan(block, column, True), schema)
    return out


N_HIT = "aggregate(coalesce(spans, array()), 0L, (a, s) -> a + s[1] - s[0])"


def contaminated(found: DataFrame) -> DataFrame:
    """found with n_hit and contaminated: a twentieth of the words or more are hit."""
    return found.withColumn("n_hit", F.expr(N_HIT)).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def cut_spans(found: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The texts of found without their removal spans; n_chars, if it is there as an integer, counted again; n_words, spans and items go."""
    names = found.columns
    column, spans = names.index(text), names.index("spans")
    counted = names.index(n_chars) if n_chars in names and isinstance(found.schema[n_chars].dataType, T.IntegralType) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i in range(batch.num_columns) if batch.schema.names[i] not in _OUT.names]
            for part in W.chunks(batch, names[column]):
                cols, texts = list(part.columns), part.column(column).to_pylist()
                counts = part.column(counted).to_pylist() if counted is not None else None
                for i, held in enumerate(part.column(spans).to_pylist()):
                    if held:
                        raw = texts[i].encode()
                        w = W.split_words(pa.array([raw], pa.binary()), W.ALNUM, lower=True)
                        cuts = [0, *(int(x) for a, b in held for x in (w.start[a], w.end[b - 1])), len(raw)]
                        texts[i] = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)).decode()
                        if counts is not None:
                            counts[i] = len(texts[i])
                cols[column] = pa.array(texts, part.schema.field(column).type)
                if counts is not None:
                    cols[counted] = pa.array(counts, part.schema.field(counted).type)
                yield pa.RecordBatch.from_arrays([cols[i] for i in keep], [part.schema.names[i] for i in keep])

    return found.mapInArrow(run, T.StructType([f for f in found.schema.fields if f.name not in _OUT.names]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without contaminated documents, and the others without passages of the benchmark; columns of docs, whatever they are called."""
    rows, names = numbered(docs)
    found = contaminated(contamination(rows, benchmark, text=names["text"], **options)).filter(~F.col("contaminated"))
    return named(cut_spans(found.drop("n_hit", "contaminated"), names["text"], names.get("n_chars", "")), names)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))
    ids = F.array_sort(F.transform(F.coalesce("items", F.array().cast("array<bigint>")), lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(13, len(w)) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM p),
placed AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
occ AS (SELECT doc_id, i, n, item_id FROM placed JOIN p USING (g)),
hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS i FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

"""Substring dedup by super-k-mer partitioning.

A window is `k` consecutive words of one document. Its minimiser is the m-word gram in it with the
smallest hash. Consecutive windows that share a minimiser form a super-k-mer: it travels as one
packed string of words to the bucket of its minimiser, together with the document and the word it
starts at. Equal windows have equal minimisers and so meet in one bucket, where windows are sorted,
counted, and confirmed word by word. Words under a window counted twice or more go.

Two things keep a passage or text that a third of all documents share from landing in one task:
within a task's shard, a window met twice is known to repeat and only one representative of it
travels on; and grams frequent in the corpus (found first, by counts that each shard reports for
its most frequent grams) come last in the order of minimisers, so that a window
with anything rare in it goes by that. Buckets are as many as the words demand, of `BUCKET_WORDS` on average.
A gram that is not frequent but would fill a bucket alone (more than `BUCKET_WORDS` / 64 occurrences, and `HEAVY` of all)
is split: its windows go by it and by their minimiser in a second order, so that equal windows still meet. Lists of
such grams are broadcast; at most 1 / `HEAVY` exist, 2 MB.

Defined cases: a null or empty text has no words; texts under k words have no windows; repeated
rows and repeated doc_ids are documents of their own, and their windows repeat; an empty table gives
no rows; other columns are ignored. doc_id is a bigint. Rows are numbered by their place in the input, so that must be
something that reads the same twice, as a stored table does.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .store import cut, table

K = 35  #: words in a window
M = 4  #: words in a minimiser
FREQUENT = 1 / 4096  #: share of all grams from which a gram is frequent
HEAVY = 1 / 262_144  #: and from which its bucket may be split
BUCKET_WORDS = 1_000_000  #: words of the corpus to a bucket
_FAR = np.uint64(1) << np.uint64(63)


def _frequent(shards: DataFrame, m: int, share: float, heavy: float, bucket_words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of frequent and of heavy grams (at most 1 / heavy of them, a bounded set), and the number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "text", 8 << 20):
                w = W.split_words(part.column(0), W.SPACED)
                g = W.windows(w.hash(), m)
                g = g[W.within(w.first, m, len(g))]
                value, n = np.unique(g, return_counts=True)
                often = n >= max(4 if share < 1 / 1000 else 2, len(g) * heavy)
                value, n = np.append(value[often], W.U64(0)), np.append(n[often], 0)
                total = np.zeros(len(n), np.int64)
                total[-1] = len(w.start)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(total)], ["gram", "n", "words"])

    counted = shards.select("text").mapInArrow(count, "gram bigint, n bigint, words bigint").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    counted = cut(counted, "grams")
    total = counted.agg(F.sum("words").alias("t")).first().t or 0
    often, many = max(50, total * share), max(50, bucket_words / 64, total * heavy)
    found = counted.filter(F.col("n") > min(often, many)).select("gram", "n").toArrow()
    gram, n = (np.asarray(found.column(i).combine_chunks(), dtype=np.int64) for i in (0, 1))
    gram = gram.view(np.uint64)
    return np.sort(gram[n > often]), np.sort(gram[(n > many) & (n <= often)]), total


def _order(grams: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """What minimisers are smallest by: frequent grams after all others."""
    out = grams >> np.uint64(1)
    out[_among(grams, frequent)] |= _FAR
    return out


def _among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which values are among those held (sorted)."""
    if not len(held):
        return np.zeros(len(values), bool)
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values


def _minimisers(order: np.ndarray, span: int) -> np.ndarray:
    """Position of the first smallest of each `span` consecutive values (by doubling)."""
    n = len(order) - span + 1
    best, width = np.arange(len(order)), 1
    while width * 2 <= span:
        a, b = best[:-width], best[width:]
        best = np.where(order[b] < order[a], b, a)
        width *= 2
    a, b = best[:n], best[span - width : span - width + n]
    return np.where(order[b] < order[a], b, a)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs again, and whether it is its key's first."""
    by = np.argsort(keys, kind="stable")
    same = keys[by][1:] == keys[by][:-1]
    again, first = np.zeros(len(keys), bool), np.ones(len(keys), bool)
    again[by[1:]] |= same
    again[by[:-1]] |= same
    first[by[1:]] = ~same
    return again, first


def _confirmed(w: W.Words, h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows that start at words `at`: (repeats, first of its kind); by hash, then word by word."""
    key = W.windows(h, k, 1)[at]
    by = np.argsort(key, kind="stable")
    tied = np.flatnonzero(key[by][1:] == key[by][:-1])
    bad = np.zeros(len(tied), bool)
    for j in range(k):
        bad |= ~w.same(at[by[tied]] + j, at[by[tied + 1]] + j)
    if not bad.any():
        return _groups(key)
    exact: dict = {}  # two windows have one hash: tell those apart by their words
    ids = key.copy()
    for i in np.flatnonzero(np.isin(key, key[by[tied[bad]]])):
        text = tuple(w.buf[s:e].tobytes() for s, e in zip(w.start[at[i] : at[i] + k], w.end[at[i] : at[i] + k], strict=True))
        ids[i] = exact.setdefault(text, W.mix(np.array([len(exact)], np.uint64) + key[i])[0])
    return _groups(ids)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _pack(data: bytes, begin: np.ndarray, end: np.ndarray) -> bytes:
    """The bytes of each super-k-mer as they stand, one line feed between them: n_words says where the next begins."""
    return b"\n".join([data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)])


def _blob(w: W.Words, data: bytes, start: np.ndarray, n_words: np.ndarray, row: np.ndarray, word: np.ndarray, ask: np.ndarray) -> bytes:
    """Super-k-mers of one bucket: counts, then rows, first words, whether an answer is wanted, and the packed words."""
    head = struct.pack("<q", len(start))
    return zstandard.compress(head + n_words.astype("<i4").tobytes() + np.diff(row, prepend=0).astype("<i8").tobytes() + word.astype("<i4").tobytes() + ask.astype("<i1").tobytes() + _pack(data, w.start[start], w.end[start + n_words - 1]), 3)


def _super_kmers(k: int, m: int, frequent: np.ndarray, heavy: np.ndarray, n_buckets: int):
    """Shard -> (bucket, blob) rows; `known` has the ranges found to repeat within the shard, to be passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "text", 8 << 20):
                yield from shard(np.asarray(part.column(0), dtype=np.int64), part.column(1))

    def shard(rows: np.ndarray, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        w = W.split_words(texts, W.SPACED)
        h = w.hash()
        if len(h) < k:
            return
        ok = W.within(w.first, k, len(h) - k + 1)
        at = np.flatnonzero(ok)
        if not len(at):
            return
        text = w.text_of_word()
        again_at, first_at = _confirmed(w, h, at, k)
        again, first = np.zeros(len(ok), bool), np.zeros(len(ok), bool)
        again[at], first[at] = again_at, first_at
        grams = W.windows(h, m)
        place = _minimisers(_order(grams, frequent), k - m + 1)
        # What windows are dealt by: their minimiser, and for heavy ones that of a second order too.
        second = np.zeros(len(place), np.int64)
        split = _among(grams[place], heavy)
        if split.any():
            other = W.mix(grams ^ W.U64(0xA0761D6478BD642F))
            second[split] = _minimisers(np.where(_among(grams, frequent), other | _FAR, other >> W.U64(1)), k - m + 1)[split] + 1
        # A super-k-mer: consecutive windows of one text that are first of their kind, agree on the minimiser, and agree on whether an answer is wanted.
        breaks = np.ones(len(ok) + 1, bool)
        breaks[1:-1] = (place[1:] != place[:-1]) | (second[1:] != second[:-1]) | (first[1:] != first[:-1]) | (again[1:] != again[:-1]) | (text[1 : len(ok)] != text[: len(ok) - 1])
        edges = np.flatnonzero(breaks)
        begin, end = edges[:-1], edges[1:]
        use = first[begin]
        begin, end = begin[use], end[use]
        dealt = grams[place[begin]] ^ W.U64(0x5851F42D4C957F2D)
        dealt = np.where(second[begin] > 0, dealt ^ W.mix(grams[np.maximum(second[begin] - 1, 0)]), dealt)
        bucket = (W.mix(dealt) % W.U64(n_buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1))
        ids, blobs, data = [], [], w.buf.tobytes()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            i = by[a:b]
            s, t = begin[i], text[begin[i]]
            ids.append(int(bucket[i[0]]))
            blobs.append(_blob(w, data, s, end[i] - s + k - 1, rows[t], s - w.first[t], ~again[s]))
        known_from, known_to = _runs(again)
        t = text[known_from]
        # Runs of windows may touch across texts: cut them there.
        inside = text[known_to - 1] == t
        parts = [(known_from[inside], known_to[inside])]
        for a, b in zip(known_from[~inside], known_to[~inside], strict=True):
            own = w.first[(w.first > a) & (w.first < b)]
            parts.append((np.concatenate(([a], own)), np.concatenate((own, [b]))))
        kf, kt = (np.concatenate(x) for x in zip(*parts, strict=True))
        t = text[kf]
        if len(kf):
            ids.append(int(rows[0] % n_buckets))
            blobs.append(None)
        if ids:
            known = [None] * (len(ids) - bool(len(kf))) + [zstandard.compress(np.stack([rows[t], kf - w.first[t], kt - w.first[t] + k - 1]).astype("<i8").tobytes())] * bool(len(kf))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary()), pa.array(known, pa.binary())], ["bucket", "blob", "known"])

    return run


_RANGES = pa.schema([("row", pa.int64()), ("from_word", pa.int32()), ("to_word", pa.int32())])


def _count_bucket(k: int):
    """One bucket: windows sorted and counted exactly; ranges of words under repeated ones, for those that ask."""

    def run(bucket: pa.Table) -> pa.Table:
        heads, bodies = [], []
        passed = [np.frombuffer(zstandard.decompress(x), "<i8").reshape(3, -1) for x in bucket.column("known").to_pylist() if x is not None]
        known = np.concatenate(passed, axis=1) if passed else np.zeros((3, 0), np.int64)
        counted = count([x for x in bucket.column("blob").to_pylist() if x is not None], heads, bodies)
        both = [np.concatenate(x) for x in zip(known, counted, strict=True)]
        return pa.Table.from_arrays([pa.array(x.astype(t)) for x, t in zip(both, (np.int64, np.int32, np.int32), strict=True)], schema=_RANGES)

    def count(blobs: list, heads: list, bodies: list) -> tuple:
        if not blobs:
            return (np.zeros(0, np.int64),) * 3
        for blob in blobs:
            raw = zstandard.decompress(blob)
            (n,) = struct.unpack_from("<q", raw)
            cut_at = np.cumsum([8, 4 * n, 8 * n, 4 * n, n])
            heads.append([np.frombuffer(raw[a:b], d) for a, b, d in zip(cut_at[:-1], cut_at[1:], ("<i4", "<i8", "<i4", "<i1"), strict=True)])
            heads[-1][1] = np.cumsum(heads[-1][1])
            bodies.append(raw[cut_at[-1] :])
        n_words, row, word, ask = (np.concatenate(x) for x in zip(*heads, strict=True))
        w = W.split_words(pa.array([b"\n".join(bodies)], pa.large_binary()), W.SPACED)
        assert len(w.start) == n_words.sum()
        first = np.concatenate(([0], np.cumsum(n_words)))[:-1]
        n_windows = n_words - k + 1
        of = np.repeat(np.arange(len(n_words)), n_windows)
        inner = W.row_slices(np.concatenate(([0], np.cumsum(n_windows))))
        again, _ = _confirmed(w, w.hash(), first[of] + inner, k)
        again &= ask[of].astype(bool)
        breaks = np.ones(len(of) + 1, bool)
        breaks[1:-1] = (of[1:] != of[:-1]) | (again[1:] != again[:-1])
        edges = np.flatnonzero(breaks)
        a, b = edges[:-1], edges[1:]
        a, b = a[again[a]], b[again[a]]
        start = word[of[a]] + inner[a]
        return row[of[a]], start, start + (b - a) + k - 1

    return run


def repeated_ranges(docs: DataFrame, k: int = K, m: int = M, share: float = FREQUENT, heavy: float = HEAVY, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(row, from_word, to_word) of word ranges under windows that occur elsewhere; docs: row, text."""
    frequent, split, total = _frequent(docs, m, share, heavy, bucket_words)
    n_buckets = max(16, -(-total // bucket_words))
    shipped = docs.select("row", "text").mapInArrow(_super_kmers(k, m, frequent, split, n_buckets), "bucket bigint, blob binary, known binary")
    return shipped.groupBy("bucket").applyInArrow(_count_bucket(k), "row bigint, from_word int, to_word int")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.chunks(batch, "text"):
            w = W.split_words(part.column(1), W.SPACED)
            data = w.buf.tobytes()
            removed, shas, kept_texts = [], [], []
            for i, ranges in enumerate(part.column(2).to_pylist()):
                a, b = int(w.first[i]), int(w.first[i + 1])
                keep = np.ones(b - a, bool)
                for r in ranges or ():
                    keep[r["from_word"] : r["to_word"]] = False
                at = a + np.flatnonzero(keep)
                text = b" ".join([data[s:e] for s, e in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)])
                removed.append(b - a - len(at))
                shas.append(hashlib.sha256(text).hexdigest())
                kept_texts.append(text.decode())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w.n_words.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(kept_texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def dedup_substrings(docs: DataFrame, k: int = K, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept text of every document."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    ranges = repeated_ranges(rows.select("row", "text"), k, **options).groupBy("row").agg(F.collect_list(F.struct("from_word", "to_word")).alias("ranges"))
    joined = rows.join(ranges, "row", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_digest, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, list_slice(w, i, i + 34) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM again)),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, count(*) AS k, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN covered USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

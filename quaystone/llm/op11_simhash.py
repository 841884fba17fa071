"""SimHash near-dedup by segment popcounts.

A fingerprint is cut into 32 segments of two bits; the embedding maps it to the 32 counts of bits set
(0 to 2 each). A differing bit changes one count by at most one, so the Manhattan distance of two
embeddings is a lower bound of the differing bits. Fingerprints with at most `DISTANCE` = 4 differing
bits therefore have counts at a distance of at most two in the first 18 segments, or of at most one in
the other 14. That is a range join on two grids whose cells are vectors of counts:

* first grid: a fingerprint stands in its own cell and in those at distance one (28 on average). Two
  fingerprints at a distance of at most two have such a cell in common, halfway between them;
* second grid: its own cell and those with one count raised (12 on average). Of two fingerprints at
  distance one, one reaches the other's cell.

Fingerprints that meet in a cell are compared bit by bit. A task reads cells one after another and
tells a spanning forest of a cell's links, so that a cell of copies gives as many links as it has members and
not all its pairs. Cells of more than `MOST` members are never compared in pairs: their members are
joined exactly through points between them. Two fingerprints are linked if and only if some
64-bit value differs from both in at most two bits, so each member lists the 2081 values near
it, and those that share one form a star. `MOST` is where such lists cost less than pairs; both ways give
the same components.

Only distinct fingerprints travel. Those of more than a thousandth of all documents (fewer than 1,000)
are joined back by a broadcast, so that a fingerprint of a third of the documents is no hot key.

Defined cases: a null, empty or wordless text has fingerprint zero and is linked like any other; a text of
fewer than four words is one shingle; very long texts are hashed in blocks; repeated rows are rows of their own with one
fingerprint; a null doc_id takes the smallest doc_id of its component (null if there is none); an empty table
gives no rows; other columns are ignored. doc_id may be of any ordered type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .graph import components, dealt
from .store import FEW, bounded, counted, cut, growing, table

SHINGLE = 4
SEED = 42
DISTANCE = 4
FIRST = 18  #: two-bit segments of the first grid; the other 14 make the second
MOST = 2 * 2081  #: from so many members on, lists of near values (2081 each) cost less than a cell's pairs
HOT = 1000
BLOCK = 1 << 17
U64 = np.uint64


def _shingles(w: W.Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word, text) of every shingle, in order; texts of fewer words are one shingle."""
    count = w.n_words
    total = len(w.start) - n + 1
    full = np.flatnonzero(W.within(w.first, n, total)) if total > 0 else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    first = np.concatenate((full, w.first[short]))
    last = np.concatenate((full + n - 1, w.first[short] + count[short] - 1))
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    return first, last, np.searchsorted(w.first, first, side="right") - 1


def _hashes(w: W.Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """XXH64 of each shingle's words joined by one space."""
    lo, hi = int(first[0]), int(last.max()) + 1
    size = w.end[lo:hi] - w.start[lo:hi] + 1
    to = np.cumsum(size)
    joined = w.buf[np.repeat(w.start[lo:hi] - (to - size), size) + np.arange(to[-1])]
    joined[to - 1] = 0x20
    view, hashed = memoryview(joined), xxhash.xxh64_intdigest
    spans = zip((to - size)[first - lo].tolist(), (to - 1)[last - lo].tolist(), strict=True)
    return np.fromiter((hashed(view[a:b], SEED) for a, b in spans), U64, len(first))


def fingerprints(texts: pa.Array, n: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text; a bit is set if over half of the shingles' hashes have it."""
    w = W.split_words(texts, W.SPACED, lower=True)
    first, last, text = _shingles(w, n)
    ones, total = np.zeros((len(texts), 64), np.int64), np.bincount(text, minlength=len(texts))
    for at in range(0, len(first), BLOCK):
        part = slice(at, at + BLOCK)
        bits = np.unpackbits(_hashes(w, first[part], last[part]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        of = text[part]
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        ones[of[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").reshape(-1).astype(U64)


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.chunks(batch, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints(part.column(1)).view(np.int64))], ["doc_id", "fp"])


def embedded(fp: np.ndarray) -> np.ndarray:
    """The counts of bits set in each segment of two bits, two bits a count."""
    return fp - ((fp >> U64(1)) & U64(0x5555555555555555))


def cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index of its fingerprint) for every cell of both grids that a fingerprint stands in."""
    counts = embedded(fp)
    low, high = counts & U64((1 << 2 * FIRST) - 1), counts >> U64(2 * FIRST)
    every = np.arange(len(fp))
    out, of = [low, high | U64(1 << 62)], [every, every]
    for grid, segments, steps in ((low, FIRST, (1, -1)), (high, 32 - FIRST, (1,))):
        for i in range(segments):
            one, value = U64(1 << 2 * i), grid >> U64(2 * i) & U64(3)
            for step in steps:
                at = np.flatnonzero(value < 2 if step > 0 else value > 0)
                moved = grid[at] + one if step > 0 else grid[at] - one
                out.append(moved if grid is low else moved | U64(1 << 62))
                of.append(at)
    return np.concatenate(out), np.concatenate(of)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.asarray(batch.column(0)).view(U64)
        cell, of = cells(fp)
        yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fp[of].view(np.int64))], ["cell", "fp"])


def forest(cell: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Links within cells (sorted), as many as it takes to connect what is linked in a cell: rows (a, b)."""
    label, out = np.arange(len(fp)), [np.zeros((0, 2), U64)]
    at, step = np.arange(max(0, len(fp) - 1)), 0
    while len(at):
        step += 1
        at = at[at + step < len(fp)]
        at = at[cell[at] == cell[at + step]]
        apart = at[label[at] != label[at + step]]  # equal labels: connected by links already told
        near = apart[np.bitwise_count(fp[apart] ^ fp[apart + step]) <= DISTANCE]
        if len(near):
            out.append(np.stack((fp[near], fp[near + step]), axis=1))
            label[near + step] = label[near]
            while len(moving := near[label[label[near + step]] != label[near + step]]):
                label[moving + step] = label[label[moving + step]]
    return np.unique(np.concatenate(out), axis=0)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (cell, fp) -> links; the last cell of what has been read waits for its other members."""
    held: list[np.ndarray] = []

    def told(rows: np.ndarray) -> pa.RecordBatch:
        links = forest(rows[0], rows[1].view(U64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    size = 0
    for batch in batches:
        held.append(np.stack((np.asarray(batch.column(0)), np.asarray(batch.column(1)))))
        size += batch.num_rows
        if size >= BLOCK:
            rows = np.concatenate(held, axis=1)
            whole = int(np.searchsorted(rows[0], rows[0, -1]))
            if whole:
                yield told(rows[:, :whole])
            held, size = [rows[:, whole:]], rows.shape[1] - whole
    if held:
        yield told(np.concatenate(held, axis=1))


def _near_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp -> (value, fp) for the values that differ in at most half of DISTANCE bits."""
    one = U64(1) << np.arange(64, dtype=U64)
    i, j = np.triu_indices(64, 1)
    masks = np.concatenate((np.zeros(1, U64), one, one[i] | one[j]))
    for batch in batches:
        fp = np.asarray(batch.column(0)).view(U64)
        for at in range(0, len(fp), 64):
            some = fp[at : at + 64]
            yield pa.RecordBatch.from_arrays([pa.array((some[:, None] ^ masks).reshape(-1).view(np.int64)), pa.array(np.repeat(some, len(masks)).view(np.int64))], ["value", "fp"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (value, fp) -> each fp with the first of its value."""
    value = first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        v, fp = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        starts = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        firsts = fp[starts].copy()
        if v[0] == value:
            firsts[0] = first
        value, first = v[-1], firsts[-1]
        hub = np.repeat(firsts, np.diff(np.append(starts, len(v))))
        links = np.unique(np.stack((hub, fp), axis=1)[hub != fp], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])


def links(prints: DataFrame, most: int = MOST) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) with at most DISTANCE differing bits."""
    placed = prints.select("fp").mapInArrow(_cells, "cell bigint, fp bigint")
    full = cut(placed.groupBy("cell").count().filter(F.col("count") > most).select("cell"), "full-cells")
    if full.isEmpty():
        return placed.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_forests, "a bigint, b bigint")
    full = bounded(full, F.lit(16))
    paired = placed.join(full, "cell", "left_anti").repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_forests, "a bigint, b bigint")
    crowded = cut(placed.join(full, "cell", "left_semi").select("fp").distinct(), "crowded")
    between = crowded.mapInArrow(_near_values, "value bigint, fp bigint").repartition("value").sortWithinPartitions("value", "fp")
    return paired.union(between.mapInArrow(_stars, "a bigint, b bigint").distinct())


def near_copies(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, fp (64 bits as a long), component_id of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = cut(docs.select("doc_id", "text").mapInArrow(_fingerprinted, f"doc_id {kind}, fp bigint"), "fingerprints")
    prints = cut(found.groupBy("fp").agg(F.min("doc_id").alias("d"), F.count("*").alias("n")), "prints")
    found_links = components(links(prints, most))
    linked = cut(found_links.union(found_links.select("component", "component").distinct()), "components")  # roots too
    few = linked.count() <= FEW
    ids = prints.select(F.col("fp").alias("node"), "d")
    least = (ids.join(F.broadcast(linked), "node") if few else linked.join(growing(ids), "node")).groupBy("component").agg(F.min("d").alias("least"))
    named = (linked.join(F.broadcast(least), "component") if few else dealt(linked, least, "component", "node")).select(F.col("node").alias("fp"), "least")
    classes = cut(prints.join((F.broadcast if few else growing)(named), "fp", "left").select("fp", "n", F.coalesce("least", "d").alias("component_id")), "classes")
    often = F.col("n") > max(HOT, found.count() // HOT)  # fewer than 1,000 fingerprints, whatever the input
    hot, cold = (F.broadcast(classes.filter(often)).drop("n"), classes.filter(~often).drop("n"))
    marked = found.join(hot.withColumnRenamed("component_id", "hot_id").withColumn("is_hot", F.lit(True)), "fp", "left")
    return (
        marked.filter("is_hot").select("doc_id", "fp", F.col("hot_id").alias("component_id"))
        .unionByName(marked.filter("is_hot is null").select("doc_id", "fp").join(counted(cold), "fp").select("doc_id", "fp", "component_id"))
    )


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Merkle manifest of a dataset, with a witness for every document.

A document's leaf is the digest of its fields. Leaves of a source ascend by doc_id; every 16 consecutive
nodes of a level (the last run may be shorter) give their digest to the level above, until one node remains, the
source's root (`subroot`). The sources' roots, in their order, give the manifest's root in the same way. A
witness lists, level by level, the other nodes of the runs on the way up and the place between them.

Witnesses grow by appends. Leaves are sorted once, by range (a source of a third of all rows is split), and
numbered by their place in the sorted partitions. Aligned blocks of 16^3 leaves are streams: a `Subtree` takes
leaf after leaf; an open run holds what has come so far, and when its last sibling completes it, the witnesses of all
leaves below get that run, and its digest is appended one level up. The roots of a source's blocks are then the appends
of a further tree of blocks, and so on, until each source has one root; these are appended to a last tree.
A block's own witness comes back as the first row of its stream and extends the witness of each of its leaves.
So a task holds one block at a time, and what travels is digests, not texts and not witnesses.

`witnesses` returns the siblings themselves; `folded` recomputes a root from a leaf and a witness, by SQL functions.

Defined cases: null fields are written `-` and an empty one `0:`; null doc_ids come first in a source, a null source
first among sources; equal doc_ids are ordered by their leaves, and equal leaves are interchangeable; a lone
leaf is its source's root, with no siblings; an empty table gives no rows; other columns are ignored; very long texts are
digested where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bounded, cut, table

FAN = 16
LEVELS = 3  #: of a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS = 2048  #: rows of a batch of witnesses (about 5 kB each)
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WITNESS = "siblings array<array<string>>, places array<int>"


def leaf(**fields: Column) -> Column:
    """The digest of the given fields, in their order: each with its length in bytes, so that no two records give one text."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields.values()]
    return F.sha2(F.concat(*told), 256)


def height(n: int) -> int:
    """Levels above n leaves until one node remains."""
    levels = 0
    while FAN**levels < n:
        levels += 1
    return levels


class Subtree:
    """An aligned block of a tree that grows by appends; `levels` levels above its leaves."""

    def __init__(self, levels: int):
        self.levels = levels
        self.open: list[list[tuple[str, int, int]]] = [[] for _ in range(levels)]  # per level: (digest, first leaf, end of its leaves)
        self.runs: list[list[str]] = []
        self.given: list[tuple[int, int, int, int, int]] = []  # (first leaf, end, level, run, place): what completions added to witnesses
        self.size = 0
        self.root: str | None = None

    def append(self, digest: str) -> None:
        self._append(0, digest, self.size, self.size + 1)
        self.size += 1

    def _append(self, level: int, digest: str, first: int, end: int) -> None:
        if level == self.levels:
            self.root = digest
            return
        self.open[level].append((digest, first, end))
        if len(self.open[level]) == FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        names = [digest for digest, _, _ in run]
        self.given += [(first, end, level, len(self.runs), place) for place, (_, first, end) in enumerate(run)]
        self.runs.append(names)
        self._append(level + 1, hashlib.sha256("".join(names).encode()).hexdigest(), run[0][1], run[-1][2])

    def close(self) -> Subtree:
        """No more leaves: runs that are still open are complete as they are."""
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        return self

    def witnesses(self, siblings: list[list[str]], places: list[int]) -> tuple[pa.Array, pa.Array]:
        """(siblings, places) of every leaf, extended by the witness of the block itself."""
        up, width = len(siblings), self.levels + len(siblings)
        run, place = np.zeros((self.size, width), np.int64), np.zeros((self.size, width), np.int32)
        for first, end, level, r, p in self.given:
            run[first:end, level], place[first:end, level] = r, p
        if up:
            run[:, self.levels :] = np.arange(len(self.runs), len(self.runs) + up)
            place[:, self.levels :] = places
        lists = [*self.runs, *siblings]
        length = np.array([len(x) for x in lists], np.int64)
        begin = np.concatenate(([0], np.cumsum(length)))[:-1]
        at = np.arange(FAN)
        if not lists:
            return pa.array([[]] * self.size, pa.list_(pa.list_(pa.string()))), pa.array([[]] * self.size, pa.list_(pa.int32()))
        other = at < length[run][:, :, None]
        other[:, : self.levels] &= at != place[:, : self.levels, None]
        names = pa.array([x for y in lists for x in y], pa.string()).take(pa.array((begin[run][:, :, None] + at)[other]))
        inner = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(other.sum(axis=2).reshape(-1)))).astype(np.int32)), names)
        outer = pa.array((np.arange(self.size + 1) * width).astype(np.int32))
        return pa.ListArray.from_arrays(outer, inner), pa.ListArray.from_arrays(outer, pa.array(place.reshape(-1)))


def _spans(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows of one (grp, block), the batch's first two columns."""
    keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    at = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[at]:
            yield keys[at], batch.slice(at, i - at)
            at = i


def _block_roots(levels: int):
    """Sorted (grp, block, total, digest) -> a row for each block: the appends of the tree above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, total, out = None, None, 0, []

        def told(least: int) -> Iterator[pa.RecordBatch]:
            if len(out) > least:
                rows = list(zip(*out, strict=True))
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], kind), *(pa.array(x, t) for x, t in zip(rows[1:], (pa.int64(), pa.int64(), pa.string()), strict=True))], ["grp", "block", "total", "digest"])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for found, rows in _spans(batch):
                if tree is None or found != key:
                    if tree is not None:
                        out.append((*key, -(-total // FAN**levels), tree.close().root))
                    key, total = found, rows.column(2)[0].as_py()
                    tree = Subtree(min(levels, height(total)))
                for digest in rows.column(3).to_pylist():
                    tree.append(digest)
            yield from told(ROWS)
        if tree is not None:
            out.append((*key, -(-total // FAN**levels), tree.close().root))
        yield from told(0)

    return run


def _attached(levels: int):
    """Sorted (grp, block, total, digest, up, carried), each block led by the row with its own witness (up) -> carried, siblings, places, subroot, root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, up, held, done, size = None, None, None, [], [], 0

        def finish() -> None:
            nonlocal size
            if tree is not None and tree.size:
                n = tree.close().size
                done.append([pa.concat_arrays(held), *tree.witnesses(up["siblings"], up["places"]), *(pa.repeat(pa.scalar(up[x], pa.string()), n) for x in ("subroot", "root"))])
                size += n

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if done:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*done, strict=True)], ["carried", "siblings", "places", "subroot", "root"])
                done.clear()
                size = 0

        for batch in batches:
            for found, rows in _spans(batch):
                if tree is None or found != key:
                    finish()
                    if size >= ROWS:
                        yield from told()
                    key, held, up = found, [], rows.column(4)[0].as_py()
                    tree = Subtree(min(levels, height(rows.column(2)[0].as_py())))
                    rows = rows.slice(1)
                held.append(rows.column(5))
                for digest in rows.column(3).to_pylist():
                    tree.append(digest)
        finish()
        yield from told()

    return run


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with rank (from 0 within their group, by order) and total (rows of the group), without a group in one task.

    Rows are sorted by range; a row's number is its place in its partition and what earlier partitions hold of its group.
    """
    by = [group, *order]
    placed = rows.repartitionByRange(*by, F.monotonically_increasing_id()).sortWithinPartitions(*by)
    placed = cut(placed.withColumn("_at", F.monotonically_increasing_id()), "sorted").withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    every = "sum(_n) OVER (PARTITION BY _g ORDER BY _p ROWS UNBOUNDED PRECEDING)"
    starts = cut(parts.selectExpr("_g", "_p", f"{every} - _n - _first AS _shift", "sum(_n) OVER (PARTITION BY _g) AS total"), "starts")  # at most partitions + groups rows
    joined = placed.join(bounded(starts, F.lit(64) + F.coalesce(F.octet_length(F.col("_g").cast("string")), F.lit(0))), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_g", "_p", "_shift")


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """(grp, block, total, digest) of the aligned blocks of nodes (grp, rank, total, digest); total: blocks of the group."""
    kind = nodes.schema["grp"].dataType.simpleString()
    rows = nodes.select("grp", F.floor(F.col("rank") / FAN**levels).alias("block"), "total", "digest", "rank").repartition("grp", "block").sortWithinPartitions("grp", "block", "rank").drop("rank")
    return cut(rows.mapInArrow(_block_roots(levels), f"grp {kind}, block bigint, total bigint, digest string"), "blocks")


def _witnessed(nodes: DataFrame, heads: DataFrame, levels: int) -> DataFrame:
    """carried, siblings, places, subroot, root of nodes (grp, rank, total, digest, carried); heads: their blocks' own witnesses."""
    up = F.struct("siblings", "places", "subroot", "root").alias("up")
    carried = nodes.schema["carried"].dataType.simpleString()
    block = F.floor(F.col("rank") / FAN**levels).alias("block")
    first = heads.select("grp", "block", F.col("leaves").alias("total"), F.lit(None).cast("string").alias("digest"), up, F.lit(None).cast(carried).alias("carried"), F.lit(-1).cast("bigint").alias("rank"))
    rows = nodes.select("grp", block, "total", "digest", F.lit(None).cast(first.schema["up"].dataType).alias("up"), "carried", "rank")
    stream = first.unionByName(rows).repartition("grp", "block").sortWithinPartitions("grp", "block", "rank").drop("rank")
    return stream.mapInArrow(_attached(levels), f"carried {carried}, {WITNESS}, subroot string, root string")


def _heads(nodes: DataFrame, levels: int) -> DataFrame:
    """grp, block, leaves, siblings, places, root of the blocks of nodes: each block's way to its group's root."""
    blocks = _blocks(nodes, levels)
    leaves = nodes.groupBy("grp").agg(F.max("total").alias("leaves")).withColumnRenamed("grp", "_g")
    none = [F.array().cast("array<array<string>>").alias("siblings"), F.array().cast("array<int>").alias("places")]
    alone = blocks.filter("total = 1").select("grp", "block", *none, F.col("digest").alias("root"))
    many = blocks.filter("total > 1").select("grp", F.col("block").alias("rank"), "total", "digest", F.struct("grp", "block").alias("carried"))
    if not many.isEmpty():
        above = _heads(many, levels).withColumn("subroot", F.col("root"))
        alone = alone.unionByName(_witnessed(many, above, levels).select("carried.grp", "carried.block", "siblings", "places", "root"))
    return cut(alone.join(leaves, F.col("grp").eqNullSafe(F.col("_g"))).drop("_g"), "heads")


def witnesses(docs: DataFrame, *more: tuple[str, Column], fields: tuple[str, ...] = FIELDS, by: str = "doc_id", group: str = "source", levels: int = LEVELS) -> DataFrame:
    """A row for each document: by and group (under these names), leaf, what `more` names, siblings, places, subroot, root."""
    kept = docs.select(F.col(by).alias("k"), F.col(group).alias("grp"), leaf(**{c: F.col(c) for c in fields}).alias("digest"), *[c.alias(f"m{i}") for i, (_, c) in enumerate(more)])
    nodes = ranked(cut(kept, "leaves"), "grp", ["k", "digest"])
    nodes = cut(nodes.select("grp", "rank", "total", "digest", F.struct("k", "grp", "digest", *[f"m{i}" for i in range(len(more))]).alias("carried")), "nodes")
    heads = _heads(nodes, levels)
    # The sources' roots are the leaves of the last tree.
    roots = ranked(heads.filter("block = 0").select(F.lit(0).alias("all"), "grp", F.col("root").alias("digest")), "all", ["grp"])
    roots = cut(roots.select(F.col("all").alias("grp"), "rank", "total", "digest", F.struct("grp").alias("carried")), "roots")
    last = _witnessed(roots, _heads(roots, levels).withColumn("subroot", F.col("root")), levels)
    last = cut(last.select(F.col("carried.grp").alias("_g"), F.col("siblings").alias("_s"), F.col("places").alias("_p"), F.col("root").alias("_root")), "last")
    whole = heads.withColumnRenamed("root", "subroot").join(last, F.col("grp").eqNullSafe(F.col("_g")))
    whole = cut(whole.select("grp", "block", "leaves", F.concat("siblings", "_s").alias("siblings"), F.concat("places", "_p").alias("places"), "subroot", F.col("_root").alias("root")), "heads")
    told = [F.col("carried.k").alias(by), F.col("carried.grp").alias(group), F.col("carried.digest").alias("leaf"), *[F.col(f"carried.m{i}").alias(c) for i, (c, _) in enumerate(more)]]
    return _witnessed(nodes, whole, levels).select(*told, "siblings", "places", "subroot", "root")


def folded(start: Column, siblings: Column, places: Column) -> Column:
    """The root that a leaf and a witness give."""
    step = F.zip_with(siblings, places, lambda s, p: F.struct(F.array_join(F.slice(s, F.lit(1), p), "").alias("before"), F.array_join(F.slice(s, p + 1, F.lit(FAN)), "").alias("after")))
    return F.aggregate(step, start, lambda node, run: F.sha2(F.concat(run["before"], node, run["after"]), 256))


def op12_manifest(spark: SparkSession, sf_dir: str, levels: int = LEVELS) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = leaf(**{c: F.translate("text", *LOWER) if c == "text" else F.col(c) for c in FIELDS})
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, changed)
    found = witnesses(docs, ("tampered", tampered), levels=levels)
    proof = F.sha2(F.array_join(F.flatten("siblings"), ""), 256)
    found = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("siblings"), F.col("places")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


_TOLD = "||".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in FIELDS)
_CHANGED = _TOLD.replace("(text AS", "(lowered AS").replace("|| text", "|| lowered")
ORACLE = f"""
WITH RECURSIVE step AS (
  SELECT i, 0 AS k, i AS c FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
d AS (
  SELECT *, translate(text, '{LOWER[0]}', '{LOWER[1]}') AS lowered,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 5 = 0 AS tampered FROM documents, crc),
l AS (
  SELECT doc_id, source, leaf, start, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, sha256({_TOLD}) AS leaf, CASE WHEN tampered THEN sha256({_CHANGED}) ELSE sha256({_TOLD}) END AS start FROM d)),
tree AS (
  SELECT source, 0 AS level, i, n, leaf AS h FROM l
  UNION ALL SELECT source, level + 1, i // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY source, level, i // {FAN}, n),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, i, n, subroot AS h FROM s
  UNION ALL SELECT level + 1, i // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // {FAN}, n),
runs AS (
  SELECT source, level, i // {FAN} AS run, list(h ORDER BY i) AS hs FROM tree WHERE n > 1 GROUP BY ALL
  ),
tops AS (SELECT level, i // {FAN} AS run, list(h ORDER BY i) AS hs FROM top WHERE n > 1 GROUP BY ALL),
way AS (
  SELECT l.source, l.i, r.level, r.hs, CAST(l.i // CAST({FAN} ** r.level AS BIGINT) % {FAN} AS BIGINT) AS p FROM l
  JOIN runs r ON r.source IS NOT DISTINCT FROM l.source AND r.run = l.i // CAST({FAN} ** (r.level + 1) AS BIGINT)
  UNION ALL
  SELECT l.source, l.i, 100 + r.level, r.hs, CAST(s.i // CAST({FAN} ** r.level AS BIGINT) % {FAN} AS BIGINT) FROM l
  JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN tops r ON r.run = s.i // CAST({FAN} ** (r.level + 1) AS BIGINT)),
ways AS (
  SELECT source, i, list({{'b': array_to_string(hs[:p], ''), 'a': array_to_string(hs[p + 2:], '')}} ORDER BY level) AS path FROM way GROUP BY ALL),
f AS (
  SELECT l.*, coalesce(path, []) AS path FROM l LEFT JOIN ways w ON w.source IS NOT DISTINCT FROM l.source AND w.i = l.i)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.b || x.a), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM (SELECT f.*, s.subroot, (SELECT h FROM top WHERE n = 1) AS root,
  list_reduce(list_prepend({{'b': start, 'a': ''}}, path), lambda x, y: {{'b': sha256(y.b || x.b || y.a), 'a': ''}}).b AS folded_root
  FROM f JOIN s ON s.source IS NOT DISTINCT FROM f.source)
"""

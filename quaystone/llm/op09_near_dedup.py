"""MinHash near-dedup with min-max hashing.

A document's set is its distinct five-word shingles. Under each of `PERMUTATIONS` permutations both
the smallest and the largest value are kept, so that a signature costs half the hash evaluations;
bands of `ROWS` smallest (or largest) values are the candidates' keys. At a similarity of 0.75 a
pair shares none of the 36 bands with a chance of about one in a million.

Equal sets are one class from the start, and only class representatives go on. Then, in a bucket:
1. every member is paired with its bucket's smallest member only (at first with the smallest over
   all its buckets, then, where components still differ, with each), and pairs are confirmed on their
   full sets; components of the confirmed links settle nearly all buckets, however large;
2. in a bucket that still holds several components, members of different components are paired
   if it has at most `SMALL` members;
3. members of larger such buckets meet by prefixes of their sets instead (frequent shingles last):
   the first shingle that sets with a similarity of 0.75 share stands so early in both that 3/7 of
   their sizes' sum can follow. That is exact, needs no cap, and does not pair documents that merely
   share a passage.

Pairs are confirmed in every step: first the signatures are compared, a byte of each smallest and
largest value; a pair in which fewer than `AGREE` of them agree is not near (at 0.75 that happens with a
chance of less than one in ten million), and texts move for the others alone, to be compared on
their full sets. Texts of candidates are written once.

Bands travel once, but those of keys that more than `HOT` of the documents hold (counted over all of them) do not:
such a key's hub and size are put together from partial minima and counts and broadcast, at most 2 * 36 / `HOT` of them.
All other joins are between written tables, so that adaptive execution can split what is skewed.

Defined cases: a text without words has an empty set and stays alone; fewer than five words are one
shingle; repeated rows are equal sets; rows that repeat a doc_id with another text are documents of
their own under one name, each kept or not by its own set; a null doc_id takes its class's component
(null if the class has no other id) and is not kept beside another; an empty table gives no rows;
other columns are ignored. doc_id may be of any ordered type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .graph import components
from .store import FEW, bounded, counted, cut, growing, settings, table

SHINGLE = 5
PERMUTATIONS = 72
ROWS = 4
SMALL = 24
AGREE = 0.55  #: of a signature's values
HOT, HOT_LEAST = 1 / 4096, 1000
OFTEN = 1000
NAMES = 2147483647  #: a class is named by its smallest doc_id and its set's hash modulo this
#: Spark's own filter ahead of a join by sort and merge, of 1 MB whatever the input: texts of most documents without a candidate stay where they are.
BLOOM = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",  # what is broadcast is measured
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1pb",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "1000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": str(1 << 23),
}
FREQUENT = 1 / 256  #: share of a shard's documents from which a shingle counts as frequent


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(ptr, hashes): the sorted distinct shingle hashes of text i are hashes[ptr[i]:ptr[i + 1]]."""
    w = W.split_words(texts, W.SPACED, lower=True)
    h, count = w.hash(), w.n_words
    full = W.windows(h, n)
    at = np.flatnonzero(W.within(w.first, n, len(full)))
    text = (np.searchsorted(w.first, at, side="right") - 1).astype(np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    value = np.zeros(len(short), np.uint64)
    for j, c in enumerate(W.constants(n, 104729)):
        more = count[short] > j
        value[more] += h[w.first[short[more]] + j] * c
    value = W.mix(value + count[short].astype(np.uint64))
    hashes, text = np.concatenate((full[at], value)), np.concatenate((text, short))
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(text[order].astype(np.uint16 if len(count) < 1 << 16 else np.int64), kind="stable")]
    hashes, text = hashes[order], text[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[keep], text[keep]
    return np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(count))))), hashes


def set_hashes(ptr: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each set; 0 for an empty one."""
    size = np.diff(ptr)
    some = np.flatnonzero(size)
    out = [np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)]
    if len(some):
        for ids, c in zip(out, W.constants(2, 5), strict=True):
            ids[some] = np.add.reduceat(W.mix(hashes ^ c), ptr[some])
    return out


def min_max(starts: np.ndarray, hashes: np.ndarray, permutations: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The smallest and the largest value of each set (none empty) under each permutation."""
    for factor, offset in zip(W.constants(permutations, 1), W.constants(permutations, 2), strict=True):
        v = hashes * factor + offset
        yield np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)


def _signatures(permutations: int, rows: int):
    mixers, n_bands = W.constants(rows, 3), 2 * (permutations // rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "text", 2 << 20):
                ptr, hashes = shingle_sets(part.column(1))
                size = np.diff(ptr)
                some = np.flatnonzero(size)
                bands = np.zeros((len(some), n_bands), np.uint64)
                if len(some):
                    for p, (low, high) in enumerate(min_max(ptr[some], hashes, n_bands // 2 * rows)):
                        bands[:, p // rows] += low * mixers[p % rows]
                        bands[:, p // rows + n_bands // 2] += high * mixers[p % rows]
                    bands = W.mix(bands + W.constants(n_bands, 4))
                offsets = np.concatenate(([0], np.cumsum((size > 0) * n_bands))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), *(pa.array(x.view(np.int64)) for x in set_hashes(ptr, hashes)), lists], ["doc_id", "n", "set_a", "set_b", "bands"])

    return run


def _node(kind: str) -> str:
    return f"struct<d:{kind},s:int>"


def _hash() -> F.Column:
    """With it a class's name tells classes apart whose smallest doc_id is the same."""
    return F.pmod("set_b", F.lit(NAMES)).cast("int").alias("s")


def _often_keys(share: float):
    """Keys that a shard's documents hold often, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, n = np.unique(np.asarray(batch.column(0).flatten()), return_counts=True)
            often = n >= max(2, batch.num_rows * share / 2)
            yield pa.RecordBatch.from_arrays([pa.array(value[often]), pa.array(n[often].astype(np.int64))], ["key", "n"])

    return run


def buckets(sig: DataFrame, share: float = HOT, least: int = HOT_LEAST) -> DataFrame:
    """key, id, n, size, hub, hub_n of every class in a bucket of two or more; the hub is a bucket's smallest member."""
    total = sig.count()
    counted = sig.select("bands").mapInArrow(_often_keys(share), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    hot = cut(counted.filter(F.col("n") > max(least, total * share)).select("key"), "hot")  # 2 * bands / share rows at most
    filled = sig.filter("n > 0 and doc_id is not null")
    classes = filled.groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("d"), F.first("bands").alias("bands"))
    rowed = classes.select("d", _hash(), "n", F.explode("bands").alias("key"))
    first, node = F.min(F.struct("d", "s", "n")), F.struct("d", "s")
    # One exchange for both uses. Plain columns, not structs: this is the longest table there is.
    cold = rowed.join(F.broadcast(hot), "key", "left_anti").repartition("key")
    sizes = cold.groupBy("key").agg(first.alias("hub"), F.count("*").alias("size")).filter("size > 1")
    members = cold.join(growing(sizes), "key")
    if not hot.isEmpty():
        # Hubs and sizes of hot keys come from partial minima and counts, and their members stay where they are.
        listed = filled.select(F.col("doc_id").alias("d"), _hash(), "n", F.explode("bands").alias("key")).join(F.broadcast(hot), "key")
        whole = cut(listed.groupBy("key").agg(first.alias("hub"), F.count("*").alias("size")), "hot")
        members = members.unionByName(rowed.join(F.broadcast(whole), "key"))
    return cut(members.select("key", node.alias("id"), "n", "size", F.struct("hub.d", "hub.s").alias("hub"), F.col("hub.n").alias("hub_n")), "buckets")


def _sketches(permutations: int, node: pa.DataType):
    """Rows (d, text), sorted by d -> (id, n, sketch, text), one row for each d and set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, set()
        for batch in batches:
            for part in W.chunks(batch, "text", 2 << 20):
                ptr, hashes = shingle_sets(part.column(1))
                s = np.mod(set_hashes(ptr, hashes)[1].view(np.int64), NAMES)
                keep = np.zeros(len(s), bool)
                for i, row in enumerate(zip(part.column(0).to_pylist(), s.tolist(), np.diff(ptr).tolist(), strict=True)):
                    if row[0] != last:
                        last, seen = row[0], set()
                    keep[i] = row[2] and row[1] not in seen
                    seen.add(row[1])
                sketch = np.zeros((len(s), 2 * permutations), np.uint8)
                some = np.flatnonzero(np.diff(ptr))
                if len(some):
                    for p, both in enumerate(min_max(ptr[some], hashes, permutations)):
                        for i, v in enumerate(both):
                            sketch[some, 2 * p + i] = W.mix(v) & W.U64(255)
                ids = pa.StructArray.from_arrays([part.column(0).cast(node.field(0).type), pa.array(s.astype(np.int32))], fields=[node.field(0), node.field(1)])
                rows = pa.RecordBatch.from_arrays([ids, pa.array(np.diff(ptr)), pa.array([x.tobytes() for x in sketch], pa.binary()), part.column(1)], ["id", "n", "sketch", "text"])
                yield rows.filter(pa.array(keep))

    return run


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sketches -> in how many values they agree."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x == y).sum(axis=1).astype(np.int32))], ["a", "b", "agree"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of texts -> pairs whose sets are linked."""
    for batch in batches:
        for half in W.chunks(batch, "text_a", 2 << 20):
            for part in W.chunks(half, "text_b", 2 << 20):
                (pa_, ha), (pb, hb) = shingle_sets(part.column(2)), shingle_sets(part.column(3))
                na, nb = np.diff(pa_), np.diff(pb)
                pair = np.concatenate((np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)))
                both = np.concatenate((ha, hb))
                order = np.lexsort((both, pair))
                p, h = pair[order], both[order]
                twice = (p[1:] == p[:-1]) & (h[1:] == h[:-1])
                inter = np.bincount(p[1:][twice], minlength=len(na))
                linked = (100 * inter >= 75 * (na + nb - inter)) & (inter > 0)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(linked)), part.column(1).filter(pa.array(linked))], ["a", "b"])


def _confirm(pairs: DataFrame, texts: DataFrame, node: str, least: int) -> DataFrame:
    """The pairs (a, b) that are linked, as a written table."""
    hint = counted if texts.count() <= FEW else growing
    a, b = (hint(texts.select(F.col("id").alias(x), F.col("sketch").alias(f"sketch_{x}"))) for x in "ab")
    rated = cut(pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(_agreement, f"a {node}, b {node}, agree int"), "rated")
    a, b = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    near = rated.filter(F.col("agree") >= least).select("a", "b")
    near = F.broadcast(near) if near.count() <= FEW else near
    with settings(pairs.sparkSession, BLOOM):
        joined = near.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
        return cut(joined.mapInArrow(_overlaps, f"a {node}, b {node}"), "links")


def _prefixes(frequent: np.ndarray):
    """(id, text, comp) -> a row for each shingle of a set's prefix, with its place in the common order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "text", 2 << 20):
                ptr, h = shingle_sets(part.column(1))
                size = np.diff(ptr)
                of = np.repeat(np.arange(len(size)), size)
                at = np.minimum(np.searchsorted(frequent, h), max(0, len(frequent) - 1))
                late = frequent[at] == h if len(frequent) else np.zeros(len(h), bool)
                order = np.lexsort((h, late, of))
                place = W.row_slices(ptr)
                long = size - -(-3 * size // 4) + 1
                keep = place < long[of]
                of, h, place = of[keep], h[order][keep], place[keep]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), part.column(2).take(pa.array(of)), pa.array(size[of]), pa.array(h.view(np.int64)), pa.array(place)], ["id", "comp", "n", "shingle", "place"])

    return run


def _often(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "text"):
                _, h = shingle_sets(part.column(1))
                value, n = np.unique(h, return_counts=True)
                often = n >= max(3, part.num_rows * share)
                yield pa.RecordBatch.from_arrays([pa.array(value[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["shingle", "n"])

    return run


def _by_prefix(found: DataFrame, texts: DataFrame, node: str) -> DataFrame:
    """Candidate pairs among (id, comp) by prefixes of their sets."""
    held = cut(found.join(growing(texts), "id").select("id", "text", "comp"), "prefixed")
    total = held.count()
    counted = held.select("id", "text").mapInArrow(_often(FREQUENT), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    # Any order of shingles is right; at most some tens of thousands, the most frequent, are put last.
    often = counted.filter(F.col("n") > max(20, total * FREQUENT)).orderBy(F.desc("n"), "shingle").limit(50_000).select("shingle").collect()
    frequent = np.sort(np.array([r.shingle for r in often], dtype=np.int64).view(np.uint64))
    rows = cut(held.mapInArrow(_prefixes(frequent), f"id {node}, comp {node}, n bigint, shingle bigint, place bigint"), "prefixes")
    # Sizes of linked sets differ by a third at most: they fall in one power of 4/3 or in neighbouring ones.
    step = F.floor(F.log("n") / float(np.log(4 / 3)) + 1e-9).cast("int")
    side = lambda x: rows.select("shingle", step.alias("step"), F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("comp", "n", "place")])
    larger = side("b").withColumn("step", F.explode(F.array(F.col("step"), F.col("step") - 1)))
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    # Linked sets have 3/7 of their sizes' sum in common; the first shingle that they share leaves room for so many in both.
    common = -F.floor(-3 * (F.col("n_a") + F.col("n_b")) / 7)
    room = (F.col("place_a") <= F.col("n_a") - common) & (F.col("place_b") <= F.col("n_b") - common)
    return side("a").join(larger, ["shingle", "step"]).filter(ordered & room & (F.col("comp_a") != F.col("comp_b"))).select("a", "b").distinct()


def links(docs: DataFrame, permutations: int = PERMUTATIONS, rows: int = ROWS, small: int = SMALL, agree: float = AGREE, **hot) -> tuple[DataFrame, DataFrame]:
    """(signatures of documents, (node, component) of class representatives that have links)."""
    kind = docs.schema["doc_id"].dataType
    node = _node(kind.simpleString())
    sig = cut(docs.select("doc_id", "text").mapInArrow(_signatures(permutations, rows), f"doc_id {kind.simpleString()}, n bigint, set_a bigint, set_b bigint, bands array<bigint>"), "signatures")
    members = buckets(sig, **hot)
    wanted = cut(members.select("id").distinct().select("id.d", F.lit(1).alias("one")), "wanted")
    with settings(docs.sparkSession, BLOOM):
        # Rows of one d and text are one; the exchange of the join serves for that too.
        texts = docs.select(F.col("doc_id").alias("d"), "text").join(bounded(wanted.filter("one > 0").select("d"), F.lit(48)), "d", "left_semi").dropDuplicates(["d", "text"]).sortWithinPartitions("d")
        shape = pa.struct([("d", _arrow(kind)), ("s", pa.int32())])
        texts = cut(texts.mapInArrow(_sketches(permutations, shape), f"id {node}, n bigint, sketch binary, text string"), "candidates")
    confirm = lambda pairs: _confirm(pairs, texts, node, int(agree * 2 * permutations))
    fits = lambda x, y: (4 * F.least(x, y) >= 3 * F.greatest(x, y))
    pair = lambda rows: rows.select(F.col("hub").alias("a"), F.col("id").alias("b"))
    stars = members.filter((F.col("id") != F.col("hub")) & fits(F.col("n"), F.col("hub_n")))
    found = confirm(pair(stars.groupBy("id").agg(F.min("hub").alias("hub"))))
    comps = components(found)

    def mixed(rows: DataFrame, comps: DataFrame) -> DataFrame:
        """Rows of buckets with more than one component left."""
        c = comps.withColumnRenamed("node", "id")
        placed = cut(rows.select(*members.columns).join(counted(c), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component"), "placed")
        several = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("id") == F.col("hub"), F.col("comp"))).alias("hub_comp")).filter("lo <> hi")
        return cut(placed.join(counted(cut(several.select("key", "hub_comp"), "several")), "key"), "open")

    open_ = mixed(members, comps)
    apart = open_.filter((F.col("comp") != F.col("hub_comp")) & fits(F.col("n"), F.col("hub_n")))
    more = confirm(pair(apart).distinct())
    if not more.isEmpty():
        found = found.union(more)
        comps = components(found)
    open_ = mixed(open_, comps)  # a bucket of one component stays one
    few = open_.filter(F.col("size") <= small)
    x, y = (few.select("key", "hub", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "comp")]) for s in "xy")
    tried = (F.col("id_x") == x["hub"]) | (F.col("id_y") == x["hub"])
    near = x.join(y.drop("hub"), "key").filter((F.col("id_x") < F.col("id_y")) & (F.col("comp_x") != F.col("comp_y")) & ~tried & fits(F.col("n_x"), F.col("n_y"))).select(F.col("id_x").alias("a"), F.col("id_y").alias("b")).distinct()
    many = cut(open_.filter(F.col("size") > small).select("id", "comp").distinct(), "crowded")
    pairs = near if many.isEmpty() else near.union(_by_prefix(many, texts, node)).distinct()
    more = confirm(pairs)
    if not more.isEmpty():
        comps = components(found.union(more))
    return sig, comps


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _judged(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n, set_a, set_b, component of every row."""
    sig, comps = links(docs, **options)
    classes = sig.filter("n > 0 and doc_id is not null").groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("d"), F.count("*").alias("rows")).withColumn("s", _hash()).withColumn("id", F.struct("d", "s"))
    placed = classes.join(counted(comps.withColumnRenamed("node", "id")), "id", "left").select(F.col("set_a").alias("sa"), F.col("set_b").alias("sb"), F.col("n").alias("m"), "rows", F.coalesce("component", "id")["d"].alias("component"))
    placed = cut(placed, "classes")
    same = (F.col("set_a") == F.col("sa")) & (F.col("set_b") == F.col("sb")) & (F.col("n") == F.col("m"))
    rows, shown = sig.select("doc_id", "n", "set_a", "set_b"), ["doc_id", "n", "set_a", "set_b"]
    # Fewer than OFTEN classes hold more than an OFTEN-th of the rows each: they are no hot keys of an exchange.
    often = F.col("rows") > max(OFTEN, sig.count() // OFTEN)
    first = rows.join(F.broadcast(placed.filter(often).select("sa", "sb", "m", F.col("component").alias("often"))), same, "left").withColumn("found", F.col("sa").isNotNull()).drop("sa", "sb", "m")
    rest = first.filter("not found").select(*shown).join((F.broadcast if placed.count() <= FEW else growing)(placed.filter(~often).drop("rows")), same, "left")
    return first.filter("found").select(*shown, F.col("often").alias("component")).unionByName(rest.select(*shown, F.coalesce("component", "doc_id").alias("component")))


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    kept = F.col("doc_id").eqNullSafe(F.col("component"))
    return _judged(docs, **options).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def _with_sets(columns: list[str]):
    text = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(text)
            ptr, hashes = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ptr)), *(pa.array(x.view(np.int64)) for x in set_hashes(ptr, hashes))], ["row", "n", "set_a", "set_b"])

    return run


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group: the rows that `near_dedup` keeps; of those with one doc_id and one set, one.

    A doc_id none of whose rows is kept goes as a whole. Rows of an id that is null or repeats are told apart by
    their sets. Texts stay where they are, unless the ids that are looked at outgrow a broadcast.
    """
    found = cut(_judged(docs, **options).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component"))), "judged")
    by_id = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if("kept").alias("stay"))
    touched = cut(by_id.filter("stay = 0 or rows > 1").select(F.col("doc_id").alias("_id"), (F.col("stay") > 0).alias("_again")), "touched")
    row = docs.select(F.struct(*docs.columns).alias("row"))
    marked = row.join(bounded(touched, F.lit(96)), F.col("row.doc_id").eqNullSafe(F.col("_id")), "left")
    out = marked.filter(F.col("_again").isNull()).select("row.*")
    if touched.filter("_again").isEmpty():
        return out
    again = marked.filter("_again").select("row").mapInArrow(_with_sets(docs.columns), T.StructType([T.StructField("row", row.schema["row"].dataType), *(T.StructField(c, T.LongType()) for c in ("n", "set_a", "set_b"))]))
    staying = found.filter("kept").select(F.col("doc_id").alias("_id"), F.col("n").alias("_n"), F.col("set_a").alias("_a"), F.col("set_b").alias("_b")).distinct()
    same = F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("n") == F.col("_n")) & (F.col("set_a") == F.col("_a")) & (F.col("set_b") == F.col("_b"))
    once = again.join(growing(staying), same, "left_semi").groupBy(F.col("row.doc_id"), "n", "set_a", "set_b").agg(F.min_by("row", F.struct("row.text")).alias("row"))
    return out.unionByName(once.select("row.*"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

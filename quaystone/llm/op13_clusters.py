"""Centroid clustering with Orchard's search.

Vectors are integers (floor(64 * x)), so that distances, sums and floors are exact and no order of
additions shows. Centroids start as the vectors with the smallest digests; each round assigns all vectors and
moves every centroid to the floor of its vectors' mean; a centroid without vectors stays.

Search: each centroid has a list of the others by distance. A vector walks the list of its nearest
centroid so far; when it meets a closer one (or an equally close one of a smaller number), it goes on in
that one's list from the start and passes over those it has seen. It stops at a centroid strictly
beyond twice its distance: by the triangle inequality no later one can be as close. All vectors of
a batch walk at once, each in its own list.

Vectors stay where they are: a task sums its vectors by cluster and sends one row a cluster, so that a
cluster of a third of all vectors is no hot key; the driver sees centroids only (`k` x 64 figures).

Defined cases: vectors with other than 64 components, or a null, NaN or infinite one, are left out; null vectors
likewise; components beyond +-2^26 after scaling count as that bound, so that distances are exact longs; sums of
distances beyond a long are null; a null vec_id is assigned, and starts a centroid only after all
others; repeated rows are vectors of their own; fewer than `k` vectors give as many centroids; an empty table gives no rows;
other columns are ignored. vec_id may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import cut, table

SIZE = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
BOUND = 1 << 26  #: of a component, so that four times a squared distance is a long


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fits = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), SIZE), False)
        ids, lists = batch.column(0).filter(fits), batch.column(1).filter(fits)
        x = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, SIZE)
        finite = np.isfinite(x).all(axis=1)
        with np.errstate(over="ignore"):
            v = np.clip(np.floor(SCALE * x[finite]), -BOUND, BOUND).astype(np.int32)
        offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * SIZE)
        yield pa.RecordBatch.from_arrays([ids.filter(pa.array(finite)), pa.ListArray.from_arrays(offsets, pa.array(v.reshape(-1)))], ["vec_id", "v"])


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the centroid nearest to each vector; of equal ones the smallest number."""
    k = len(centroids)
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    between = ((centroids[:, None] - centroids[None]) ** 2).sum(axis=2)
    between[np.arange(k), np.arange(k)] = -1  # itself first
    lists = np.argsort(between, axis=1, kind="stable")[:, 1:]
    far = np.take_along_axis(between, lists, axis=1)
    now, place = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    distance = ((x - centroids[0]) ** 2).sum(axis=1)
    seen = np.zeros((len(x), k), bool)
    seen[:, 0] = True
    walking = np.arange(len(x))
    while len(walking := walking[place[walking] < k - 1]):
        walking = walking[far[now[walking], place[walking]] <= 4 * distance[walking]]
        met = lists[now[walking], place[walking]]
        place[walking] += 1
        new = ~seen[walking, met]
        at, met = walking[new], met[new]
        seen[at, met] = True
        d = ((x[at] - centroids[met]) ** 2).sum(axis=1)
        closer = (d < distance[at]) | ((d == distance[at]) & (met < now[at]))
        at, met, d = at[closer], met[closer], d[closer]
        now[at], distance[at], place[at] = met, d, 0
    return now, distance


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column(1).flatten()).reshape(-1, SIZE).astype(np.int64)


def _sums(centroids: np.ndarray):
    """Vectors -> a task's count and sums for each cluster that it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            x = _vectors(batch)
            of, _ = nearest(x, centroids)
            count += np.bincount(of, minlength=len(count))
            order = np.argsort(of, kind="stable")
            some, starts = np.unique(of[order], return_index=True)
            if len(some):
                total[some] += np.add.reduceat(x[order], starts, axis=0)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(count[met]), pa.array(list(total[met]), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, distance = nearest(_vectors(batch), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of means, as the tasks' sums say."""
    sums = vectors.mapInArrow(_sums(centroids), "cluster int, n bigint, s array<bigint>")
    wide = sums.select("cluster", "n", F.posexplode("s").alias("at", "part"))
    out = centroids.copy()
    for r in wide.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect():  # at most k x 64 rows
        out[r.cluster, r["at"]] = int(r.s) // r.n
    return out


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (its components) of every vector kept."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    kept = cut(vectors.select("vec_id", "embedding").mapInArrow(_quantised, f"vec_id {kind}, v array<int>"), "vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = [r.v for r in kept.orderBy(digest.asc_nulls_last(), "v").limit(k).collect()]
    centroids = np.array(starts, np.int64).reshape(-1, SIZE)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(kept, centroids)
    found = cut(kept.mapInArrow(_assigned(centroids), f"vec_id {kind}, cluster int, distance bigint"), "assigned")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part")).collect()  # at most k rows
    fits = lambda n: n if n < 1 << 63 else None
    rows = [(r.cluster, fits(int(r.part)), fits(sum(int(x.part) for x in sums)), centroids[r.cluster].tolist()) for r in sums]
    named = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(table(spark, sf_dir, "embeddings"))
    return found.withColumn("centroid_sha256", F.sha2(F.array_join("centroid", ","), 256)).drop("centroid")


def _round_sql(i: int) -> str:
    """SQL of one round: a{i} assigns all vectors to the centroids c{i}, c{i + 1} are the floors of their means."""
    assign = f"""
d{i} AS (SELECT p.rid, c.cluster, sum((p.x - c.x) * (p.x - c.x)) AS distance FROM part p JOIN c{i} c USING (pos) GROUP BY ALL),
a{i} AS (SELECT rid, min(distance) AS distance, arg_min(cluster, (distance, cluster)) AS cluster FROM d{i} GROUP BY rid),"""
    move = f"""
c{i + 1} AS (
  SELECT c.cluster, c.pos, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT cluster, pos, (s - ((s % n) + n) % n) // n AS x FROM (
      SELECT a.cluster, p.pos, CAST(sum(p.x) AS HUGEINT) AS s, count(*) AS n FROM part p JOIN a{i} a USING (rid) GROUP BY ALL)) m USING (cluster, pos)),"""
    return assign + move * (i < ROUNDS)


ORACLE = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), embedding) AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT rid, pos, CAST(floor({SCALE} * CAST(embedding[pos] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT rid, embedding, unnest(range(1, {SIZE + 1})) AS pos FROM kept)),
c0 AS (SELECT CAST(rid - 1 AS INTEGER) AS cluster, pos, x FROM part WHERE rid <= {CLUSTERS}),{"".join(map(_round_sql, range(ROUNDS + 1)))}
named AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
SELECT vec_id, a.cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} a JOIN kept USING (rid) JOIN named ON named.cluster = a.cluster
"""

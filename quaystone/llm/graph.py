"""Connected components of an edge table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import FEW, cut, growing

SALTS = 32  #: parts in which a node's neighbours are dealt


def dealt(rows: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined with the one row that few has for their key: rows of a key are dealt over `SALTS` parts by another column, and the row of few is copied to each."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(growing(copies), [key, "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable; edges: (a, b), a and b of one ordered type.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each keeps connectivity and
    at most as many edges, and few rounds suffice. Every round is a written table. Neighbourhoods
    are reduced to minima and joined back in parts, so that a hub with many neighbours is never one row or one task.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    # No round has more edges than the one before: few of them are joined by a broadcast, many in parts.
    few = now.count() <= FEW
    with_least = (lambda rows, least: rows.join(F.broadcast(least), "a")) if few else (lambda rows, least: dealt(rows, least, "a", "b"))
    mark = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = with_least(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = with_least(large, low).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a > b").distinct()
        now = cut(small, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("b")).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))

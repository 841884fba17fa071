"""What the operators share: written tables, bounded broadcasts, columns of any name, settings."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.plans.tables import cut, new_path, shared_dir  # noqa: F401

BROADCAST_BYTES = 16 << 20


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns called c0, c1, ..., so that no name of its own meets one of an operator's; and what each is called now."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def named(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of before, under their own names."""
    return docs.select(*[F.col(now).alias(c) for c, now in names.items()])


def growing(df: DataFrame) -> DataFrame:
    """A table that grows with the data, for a join by sort and merge, which adaptive execution can split.

    Left to itself Spark takes a written table for as small as its compressed file, and broadcasts eight times that.
    """
    return df.hint("merge")


FEW = 50_000  #: rows of some hundred bytes at most


def counted(df: DataFrame) -> DataFrame:
    """A written table of short rows, to be broadcast if it is counted as few (a count reads no column); else as one that grows."""
    return F.broadcast(df) if df.count() <= FEW else growing(df)


def bounded(df: DataFrame, bytes_a_row: Column) -> DataFrame:
    """A written table, to be broadcast if its measured size allows it."""
    return F.broadcast(df) if (df.agg(F.sum(bytes_a_row.cast("long")).alias("n")).first().n or 0) <= BROADCAST_BYTES else growing(df)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the queries that run inside; what was set before comes back."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

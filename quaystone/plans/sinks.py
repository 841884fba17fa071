"""Feed files: JSON, tables, a provenance line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.plans import versions

SCHEMA_VERSION = 2


class EmptyFeed(ValueError):
    """A feed without rows never replaces one that has some."""


def write_tables(tables: dict[str, DataFrame], path: str, build: str = "") -> int:
    """Write all tables, then the manifest that names them; its number. Readers and other writers go on meanwhile.

    build: what made the feed, to be asked for by readers; of two feeds the later manifest counts.
    """
    if tables["trades"].isEmpty():
        raise EmptyFeed("no trades: the last feed stays")
    spark = tables["trades"].sparkSession
    folders = {name: [versions.write(df, path, name)] for name, df in tables.items()}
    return versions.commit(spark, path, folders, {"schema_version": SCHEMA_VERSION, "build": build}).number


def read_tables(spark: SparkSession, path: str, name: str, build: str | None = None) -> DataFrame:
    """A table of the last feed of this schema version, and of a build if one is asked for: a feed of another build is as good as none."""
    found = versions.latest(spark, path)
    if found is None or found.facts.get("schema_version") != SCHEMA_VERSION or (build is not None and found.facts.get("build") != build):
        raise EmptyFeed("no feed of this schema version and build")
    return spark.read.parquet(*found.tables[name])


def feed_json(trades: DataFrame) -> DataFrame:
    """value: one JSON object a trade, keys in order, ISO dates."""
    return trades.select(F.to_json(F.struct(*sorted(trades.columns))).alias("value"))


def provenance(trades: DataFrame, members: DataFrame) -> DataFrame:
    """One row: the chambers that the feed covers, and its years."""
    m = members.select(F.col("id").alias("_m"), F.col("chamber").alias("branch"))
    return trades.join(m, trades.member_id == F.col("_m"), "left").agg(F.array_join(F.sort_array(F.collect_set("branch")), ", ").alias("chambers"), F.array_join(F.sort_array(F.collect_set(F.year("tx_date"))), ", ").alias("years"))

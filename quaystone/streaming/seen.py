"""Seen state of many readers, over time.

Feed rows carry the number of the batch that they arrived in. A reader's state is the batch up to which all is seen, and the ids
seen since: so the first watch, which counts all that is there as seen, costs one row and not one for each trade, and so does
a change of the scheme of ids, after which the ids of before mean nothing. A step shows each reader the unseen rows of
what they watch, newest first and at most `LIMIT`; shown rows are seen, the rest come next time.

States are versions (`plans.versions`): a step that runs twice after a failure is passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.plans import versions
from quaystone.plans.tables import cut

LIMIT = 50
READERS = T.StructType([T.StructField("reader", T.StringType()), T.StructField("upto", T.LongType())])
SEEN = T.StructType([T.StructField("reader", T.StringType()), T.StructField("row_id", T.StringType())])
SECTION = T.StructType([*SEEN.fields, T.StructField("rank", T.LongType()), T.StructField("step", T.LongType())])


def matches(rows: DataFrame, tickers: DataFrame, follows: DataFrame) -> DataFrame:
    """reader, row_id, arrived, disclosed_date of what each reader watches. tickers: reader, ticker; follows: reader, member_id."""
    by_ticker = rows.withColumn("_t", F.upper("ticker")).join(tickers.select("reader", F.upper(F.trim("ticker")).alias("_t")).distinct(), "_t")
    by_member = rows.join(follows.select("reader", "member_id").distinct(), "member_id")
    shown = ["reader", F.col("id").alias("row_id"), "arrived", "disclosed_date"]
    return by_ticker.select(*shown).union(by_member.select(*shown)).distinct()


def step(rows: DataFrame, arrived: int, path: str, tickers: DataFrame, follows: DataFrame, scheme: str, limit: int = LIMIT) -> versions.Version:
    """The state after batch `arrived`; rows (id, ticker, member_id, disclosed_date, arrived): the feed up to and with that batch.

    Readers without a state watch for the first time: all of the feed is seen. Under another scheme than before that is so for all.
    Readers who watch nothing any more lose their state, and begin anew when they watch again.
    """
    spark = rows.sparkSession
    last = versions.latest(spark, path)
    if last is not None and last.facts["arrived"] >= arrived:
        return last
    kept = last if last is not None and last.facts["scheme"] == scheme else None
    before, seen = versions.table(spark, kept, "readers", READERS), versions.table(spark, kept, "seen", SEEN)
    watching = tickers.select("reader").union(follows.select("reader")).distinct()
    readers = cut(watching.join(before, "reader", "left").select("reader", F.coalesce("upto", F.lit(arrived).cast("long")).alias("upto")), "readers")
    found = matches(rows.filter(F.col("arrived") <= arrived), tickers, follows).join(readers, "reader").filter("arrived > upto").join(seen, ["reader", "row_id"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("reader").orderBy(F.desc("disclosed_date"), F.desc("row_id")))
    section = versions.write(found.withColumn("rank", nth.cast("long")).filter(F.col("rank") <= limit).select("reader", "row_id", "rank", F.lit(arrived).cast("long").alias("step")), path, "section")
    now = spark.read.schema(SECTION).parquet(section).select("reader", "row_id")
    tables = {
        "readers": [versions.write(readers, path, "readers")], "seen": [versions.write(seen.join(readers.select("reader"), "reader", "left_semi").union(now), path, "seen")],
        "section": [*(last.tables["section"] if last else []), section],
    }
    return versions.commit(spark, path, tables, {"arrived": arrived, "scheme": scheme}, after=last.number if last else -1)


def sections(spark: SparkSession, path: str) -> DataFrame:
    """reader, row_id, rank, step of all that was ever shown."""
    return versions.table(spark, versions.latest(spark, path), "section", SECTION)


def states(spark: SparkSession, path: str) -> DataFrame:
    """reader, upto, n_seen (ids beyond upto that are seen)."""
    last = versions.latest(spark, path)
    n = versions.table(spark, last, "seen", SEEN).groupBy("reader").agg(F.count("*").alias("n_seen"))
    return versions.table(spark, last, "readers", READERS).join(n, "reader", "left").select("reader", "upto", F.coalesce("n_seen", F.lit(0)).alias("n_seen"))

"""When a source was last reached, kept apart from how old its data is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STALE_DAYS = 7


def as_of(refreshes: DataFrame, contacts: DataFrame, days: int = STALE_DAYS) -> DataFrame:
    """refreshes (source, at, and more) with last_contact, the latest time at or before `at` that the source was reached, and stale.

    contacts: source, at, reached. A contact that failed counts for nothing, however new its data; a source never reached is stale.
    One sort of both tables by source and time; no pairs of them are made.
    """
    more = [c for c in refreshes.columns if c not in ("source", "at")]
    asked = refreshes.select("source", "at", F.lit(None).cast(contacts.schema["at"].dataType).alias("_c"), F.struct(F.lit(1).alias("one"), *more).alias("_r"))
    told = contacts.filter("reached").select("source", "at", F.col("at").alias("_c"), F.lit(None).cast(asked.schema["_r"].dataType).alias("_r"))
    upto = Window.partitionBy("source").orderBy("at", F.col("_r").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = asked.unionByName(told).withColumn("last_contact", F.last("_c", True).over(upto)).filter("_r is not null")
    age = F.col("at").cast("timestamp").cast("double") - F.col("last_contact").cast("timestamp").cast("double")
    return found.select(*[F.col(f"_r.{c}").alias(c) for c in more], "source", "at", "last_contact", F.coalesce(age > days * 86400, F.lit(True)).alias("stale"))

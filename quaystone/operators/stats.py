"""Counts, profiles and lag statistics of the feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaystone.functions import columns as C

LAG_BUCKETS = [("0-7", None, 7), ("8-30", 8, 30), ("31-45", 31, 45), ("46-90", 46, 90), ("over 90", 91, None)]


def widely_held(trades: DataFrame, least: int = 3) -> DataFrame:
    return trades.filter("ticker is not null").groupBy(F.upper("ticker").alias("ticker")).agg(F.count_distinct("member_id").alias("member_count"), F.count("*").alias("trade_count")).filter(F.col("member_count") >= least)


def by_tx_type(trades: DataFrame) -> DataFrame:
    return trades.groupBy("tx_type").agg(F.count("*").alias("n"))


def by_asset_type(trades: DataFrame) -> DataFrame:
    return trades.filter("asset_type is not null").groupBy("asset_type").agg(F.count("*").alias("n")).withColumn("name", C.named(F.col("asset_type"), C.ASSET_NAMES))


def lag_stats(trades: DataFrame) -> DataFrame:
    """One row; zeros for an empty feed. The median is exact."""
    lag = F.when(~C.impossible(), C.lag_days())
    found = trades.agg(F.count(lag).alias("n"), F.percentile(lag, 0.5).alias("median"), F.avg(lag).alias("mean"), F.count_if(lag > C.LATE_DAYS).alias("over_45"))
    return found.select("n", F.coalesce(F.round("median"), F.lit(0)).cast("long").alias("median_days"), F.coalesce(F.round("mean"), F.lit(0)).cast("long").alias("mean_days"), "over_45", C.percent(F.col("over_45"), F.col("n")).alias("percent_over_45"))


def lag_buckets(trades: DataFrame) -> DataFrame:
    """All five buckets, with zeros, from one pass."""
    lag = C.lag_days()
    inside = lambda lo, hi: F.count_if((F.lit(True) if lo is None else lag >= lo) & (F.lit(True) if hi is None else lag <= hi))
    row = trades.filter(~C.impossible()).agg(*[inside(lo, hi).alias(name) for name, lo, hi in LAG_BUCKETS])
    return row.select(F.posexplode(F.array(*[F.struct(F.lit(name).alias("bucket"), F.col(f"`{name}`").alias("n")) for name, _, _ in LAG_BUCKETS])).alias("position", "b")).select(F.col("position").cast("long"), "b.bucket", "b.n")


def known_tickers(trades: DataFrame) -> DataFrame:
    return trades.filter("ticker is not null").groupBy(F.upper("ticker").alias("ticker")).agg(F.count("*").alias("n"))


def ticker_suggestions(trades: DataFrame, prefix: str, limit: int = 8) -> DataFrame:
    return known_tickers(trades).filter(F.col("ticker").startswith(prefix.strip().upper())).orderBy(F.desc("n"), "ticker").limit(limit)


def members_by_activity(members: DataFrame, trades: DataFrame) -> DataFrame:
    counts = trades.groupBy("member_id").agg(F.count("*").alias("n"))
    return members.join(counts, members.id == counts.member_id, "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"))


def member_profile(trades: DataFrame) -> DataFrame:
    """Trades, buys, and everything else as sells."""
    return trades.groupBy("member_id").agg(F.count("*").alias("trades"), F.count_if(F.col("tx_type") == "buy").alias("buys"), F.count_if(F.col("tx_type") != "buy").alias("sells"))


def member_top_tickers(trades: DataFrame, limit: int = 8) -> DataFrame:
    counts = trades.filter("ticker is not null").groupBy("member_id", "ticker").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("member_id").orderBy(F.desc("n"), "ticker")).cast("long")).filter(F.col("rank") <= limit)


def ticker_profile(trades: DataFrame) -> DataFrame:
    buy = F.col("tx_type") == "buy"
    return trades.filter("ticker is not null").groupBy(F.upper("ticker").alias("ticker")).agg(F.count("*").alias("trades"), F.count_if(buy).alias("buys"), F.count_if(~buy).alias("others"), F.count_distinct("member_id").alias("members"))


def counts_by_year(trades: DataFrame) -> DataFrame:
    return trades.groupBy(F.year("tx_date").cast("long").alias("year")).agg(F.count("*").alias("n"))


def data_quality(trades: DataFrame, members: DataFrame) -> DataFrame:
    t = trades.agg(F.count("*").alias("rows"), F.count_if(F.col("warning").isNotNull()).alias("recovered"), F.count_if(C.impossible()).alias("impossible"), F.count_if("is_amendment").alias("amended"), F.count_distinct("filing_id").alias("filings"), F.count_distinct("member_id").alias("trading_members"), F.min("tx_date").alias("first_tx"), F.max("tx_date").alias("last_tx"))
    return t.crossJoin(members.agg(F.count_if(F.size("committees") > 0).alias("with_committees"), F.count_distinct("state").alias("states")))


def warning_histogram(trades: DataFrame) -> DataFrame:
    return trades.filter("warning is not null").select(F.explode(F.split("warning", "; ")).alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


def warning_counts(rows: DataFrame) -> DataFrame:
    """warning, n of rows with an array of warnings: a row with several counts for each."""
    return rows.select(F.explode("warnings").alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


def party_tally(members: DataFrame) -> DataFrame:
    return members.groupBy("party").agg(F.count("*").alias("n"))


def chamber_rows(trades: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of each branch, by the member's record."""
    m = members.select(F.col("id").alias("_m"), F.col("chamber").alias("branch"))
    return trades.join(m, trades.member_id == F.col("_m")).groupBy("branch").agg(F.count("*").alias("n"))


def roster_counts(members: DataFrame) -> DataFrame:
    size = F.size("committees")
    named = members.select(F.explode("committees").alias("c")).agg(F.count_distinct("c").alias("committees"))
    return members.agg(F.count_if(size > 0).alias("members_mapped"), F.sum(size).cast("long").alias("assignments")).crossJoin(named)


def filing_counts(trades: DataFrame) -> DataFrame:
    return trades.groupBy("filing_id").agg(F.count("*").alias("n"))


def coverage_report(trades: DataFrame, members: DataFrame) -> DataFrame:
    """(metric, value) rows."""
    q = data_quality(trades, members)
    names = ["rows", "filings", "recovered", "impossible", "amended", "trading_members", "with_committees", "states"]
    return q.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("long").alias("value")) for n in names])).alias("r")).select("r.*")


def source_line(sources: list[str]) -> str:
    """A list of sources in words, with the serial comma."""
    if len(sources) < 3:
        return " and ".join(sources)
    return f"{', '.join(sources[:-1])}, and {sources[-1]}"


def status_counts(status: DataFrame) -> DataFrame:
    """Filings by status, from a filing_status table; accumulating sources is a union."""
    return status.groupBy("source", "status").agg(F.count("*").alias("n"))


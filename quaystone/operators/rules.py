"""Rules that pick out trades worth a look; each returns structured facts, not prose.

Ties are total: "latest" rows follow disclosed date, then the feed's order (sort date, id), all
descending. Clusters are RANGE windows over day numbers, so peers of one day share a frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaystone.functions import columns as C

TOP_FLOOR = 500_000_000
LARGE_FLOOR = 25_000_000
WINDOW_DAYS = 30
CLUSTER_DAYS = 7
FAMILY = ("spouse", "dependent")


def _first(trades: DataFrame, keys: list, order: list) -> DataFrame:
    return trades.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def _size_order() -> list:
    return [F.desc("low_cents"), F.desc(F.col("amount_kind") == "atLeast"), F.desc("disclosed_date"), F.asc("id")]


def _recency() -> list:
    return [F.desc("disclosed_date"), F.asc("id")]


def _feed_latest() -> list:
    return [F.desc("disclosed_date"), F.desc(C.sort_date()), F.desc("id")]


def _anchored(trades: DataFrame) -> DataFrame:
    """trades with the newest disclosure: one row, broadcast."""
    return trades.crossJoin(F.broadcast(trades.agg(F.max("disclosed_date").alias("anchor"))))


def top_bracket(trades: DataFrame) -> DataFrame:
    return trades.filter(F.col("low_cents") >= TOP_FLOOR)


def filed_late(trades: DataFrame) -> DataFrame:
    late = trades.withColumn("lag_days", C.lag_days()).filter(~C.impossible() & (F.col("lag_days") > C.LATE_DAYS) & (F.col("lag_days") <= C.CAP_DAYS))
    return _first(late, ["member_id"], [F.desc("lag_days"), F.desc("disclosed_date"), F.asc("id")])


def new_position(trades: DataFrame) -> DataFrame:
    counted = trades.withColumn("_all", F.count("*").over(Window.partitionBy("member_id")))
    firsts = _first(counted.filter("ticker is not null"), ["member_id", F.upper("ticker")], [F.asc("tx_date"), F.asc("disclosed_date"), F.asc("id")])
    anchor = trades.agg(F.max("disclosed_date").alias("anchor"))
    days = F.datediff("anchor", "disclosed_date")
    fresh = firsts.crossJoin(F.broadcast(anchor)).filter((days >= 0) & (days <= WINDOW_DAYS) & (F.col("_all") >= 2)).drop("_all", "anchor")
    return _first(fresh, ["member_id"], _recency())


def off_pattern(trades: DataFrame) -> DataFrame:
    """Stocks and options of members who otherwise hold funds; a row without a ticker counts as a fund."""
    own = Window.partitionBy("member_id")
    fund = F.coalesce(F.col("asset_type").isin("MF", "EF"), F.lit(False)) | F.col("ticker").isNull()
    told = trades.withColumns({"_all": F.count("*").over(own), "_funds": F.avg(fund.cast("double")).over(own)})
    odd = told.filter((F.col("_all") >= 5) & (F.col("_funds") >= 0.8) & F.col("ticker").isNotNull() & F.col("asset_type").isin("ST", "OP"))
    return _first(odd, ["member_id"], _recency()).drop("_all", "_funds")


def rare_trader(trades: DataFrame, most: int = 3) -> DataFrame:
    return trades.withColumn("member_rows", F.count("*").over(Window.partitionBy("member_id"))).filter(F.col("member_rows") <= most)


def member_largest(trades: DataFrame) -> DataFrame:
    return _first(trades, ["member_id"], _size_order()).filter(F.col("low_cents") >= LARGE_FLOOR)


def member_volume_trend(trades: DataFrame) -> DataFrame:
    """Members whose last 30 days run at three times their own pace or more. The multiple is rounded as a binary number, not by its shortest decimals."""
    told = _anchored(trades).withColumn("_recent", F.datediff("anchor", "disclosed_date") <= WINDOW_DAYS)
    rates = told.groupBy("member_id").agg(
        F.count_if("_recent").alias("recent"), F.count_if(~F.col("_recent")).alias("baseline"), F.min(F.when(~F.col("_recent"), F.col("disclosed_date"))).alias("earliest"), F.max("anchor").alias("anchor")
    )
    days = F.greatest(F.datediff("anchor", "earliest") - WINDOW_DAYS, F.lit(WINDOW_DAYS))
    fast = rates.filter((F.col("recent") >= 4) & (F.col("baseline") > 0)).withColumn("multiple", F.col("recent") / (F.col("baseline") / days * WINDOW_DAYS)).filter("multiple >= 3.0")
    latest = _first(told.filter("_recent"), ["member_id"], _feed_latest())
    return latest.drop("anchor", "_recent").join(fast.select("member_id", "recent", (F.round(F.col("multiple") * 10) / 10).alias("multiple")), "member_id")


def _clusters(rows: DataFrame, keys: list[str], least: int, also=None) -> DataFrame:
    """The densest 7-day window of each key over its members' latest rows: most members, then shortest, then earliest; the row is the window's last (greatest id on that day)."""
    latest = _first(rows, [*keys, "member_id"], _feed_latest()).withColumn("_day", F.unix_date("disclosed_date"))
    frame = Window.partitionBy(*keys).orderBy("_day").rangeBetween(-CLUSTER_DAYS, 0)
    told = latest.withColumns({"members": F.count("*").over(frame), "span_days": (F.col("_day") - F.min("_day").over(frame)).cast("long")})
    if also is not None:
        told = told.withColumn("_ok", also(frame)).filter("_ok").drop("_ok")
    return _first(told.filter(F.col("members") >= least), keys, [F.desc("members"), F.asc("span_days"), F.asc("_day"), F.desc("id")]).drop("_day")


def ticker_cluster(trades: DataFrame) -> DataFrame:
    return _clusters(trades.filter("ticker is not null").withColumn("symbol", F.upper("ticker")), ["symbol"], 3)


def cross_branch(trades: DataFrame, members: DataFrame) -> DataFrame:
    """Clusters with someone of the executive and someone of the house or senate."""
    m = members.select(F.col("id").alias("_m"), F.col("chamber").alias("branch"))
    known = trades.filter("ticker is not null").join(m, trades.member_id == F.col("_m")).drop("_m").withColumn("symbol", F.upper("ticker"))
    executive = F.col("branch") == "executive"
    return _clusters(known, ["symbol"], 2, lambda frame: F.bool_or(executive).over(frame) & F.bool_or(~executive).over(frame))


def committee_cluster(trades: DataFrame, members: DataFrame) -> DataFrame:
    """Clusters among members of one committee; the key of a result is (symbol, committee)."""
    m = members.select(F.col("id").alias("_m"), F.explode("committees").alias("committee"))
    rows = trades.filter("ticker is not null").join(m, trades.member_id == F.col("_m")).drop("_m").withColumn("symbol", F.upper("ticker"))
    return _clusters(rows, ["symbol", "committee"], 2)


def owner_pattern(trades: DataFrame) -> DataFrame:
    """Members whose rows are a spouse's or dependent's in four of five cases or more."""
    family = F.col("owner").isin(*FAMILY)
    share = trades.groupBy("member_id").agg(F.count("*").alias("rows"), F.count_if(family).alias("family")).filter((F.col("rows") >= 5) & (F.col("family") / F.col("rows") >= 0.8))
    latest = _first(trades.filter(family), ["member_id"], _feed_latest())
    return latest.join(share.select("member_id", "rows", C.percent(F.col("family"), F.col("rows")).alias("percent")), "member_id")


def headline(trades: DataFrame) -> DataFrame:
    """One row: the lead fact and, if there is one, a second; none for an empty feed. A fact is (kind, count, label)."""
    lag, ok = C.lag_days(), ~C.impossible()
    facts = trades.agg(
        F.count("*").alias("rows"), F.count_distinct("member_id").alias("traders"), F.count_if(ok & (lag > 365) & (lag <= C.CAP_DAYS)).alias("year_late"), F.count_if(F.col("low_cents") >= TOP_FLOOR).alias("big"),
        F.max(F.when(F.col("low_cents") >= TOP_FLOOR, F.col("low_cents"))).alias("largest"), F.min(F.year("tx_date")).alias("y0"), F.max(F.year("tx_date")).alias("y1"),
    )
    tickers = trades.filter("ticker is not null").groupBy(F.upper("ticker").alias("t")).agg(F.count_distinct("member_id").alias("m")).filter("m >= 3")
    widest = tickers.agg(F.min(F.struct((-F.col("m")).alias("m"), "t")).alias("w")).select((-F.col("w.m")).alias("w_m"), F.col("w.t").alias("w_t"))
    fact = lambda kind, n, label: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n"), label.cast("string").alias("label"))
    none = F.lit(None)
    one = F.when(F.col("year_late") >= 3, fact("year_late", F.col("year_late"), none))
    two = F.when(F.col("big") >= 3, fact("top_brackets", F.col("big"), none)).when(F.col("big") > 0, fact("largest_bracket", F.col("largest"), none))
    three = F.when(F.col("w_m").isNotNull(), fact("widely_held", F.col("w_m"), F.col("w_t")))
    first = F.filter(F.array(one, two), lambda x: x.isNotNull())
    with_third = F.when(F.size(first) < 2, F.filter(F.concat(first, F.array(three)), lambda x: x.isNotNull())).otherwise(first)
    fallback = F.array(fact("snapshot", F.col("rows"), F.concat_ws("-", "y0", "y1")))
    told = facts.crossJoin(F.broadcast(widest)).filter("rows > 0").withColumn("f", with_third).withColumn("f", F.when(F.size("f") == 0, fallback).otherwise(F.col("f")))
    lead, more = F.get("f", F.lit(0)), F.get("f", F.lit(1))
    return told.select(lead["kind"].alias("lead"), lead["n"].alias("lead_n"), lead["label"].alias("lead_label"), more["kind"].alias("supporting"), more["n"].alias("supporting_n"), more["label"].alias("supporting_label"))

"""What a reader watches: seen rows, and what to tell about unseen ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.functions import columns as C


def admissible_ticker(raw: Column) -> Column:
    """The ticker in capitals; null unless it has 1 to 12 characters."""
    t = F.upper(F.trim(raw))
    return F.when(F.length(t).between(1, 12), t)


def first_watch(matches: DataFrame, seen: DataFrame, watched_before: bool) -> DataFrame:
    """Seen ids after watching something: the first time everything there is counts as seen."""
    return seen if watched_before else seen.union(matches.select(F.col("id").alias("row_id"))).distinct()


def mark_seen(seen: DataFrame, rows: DataFrame) -> DataFrame:
    return seen.union(rows.select(F.col("id").alias("row_id"))).distinct()


def alert(rows: DataFrame, most: int = 4) -> DataFrame:
    """One row, or none without rows: n, names (tickers, or members where no row has a ticker; the first four in order), more (how many are not named), and of a single row its facts.

    Names are the first of a sorted, distinct column; only those are gathered.
    """
    told = rows.agg(
        F.count("*").alias("n"), F.count_distinct("ticker").alias("n_tickers"), F.count_distinct("member_name").alias("n_members"),
        F.min(F.struct("id", "member_name", "tx_type", C.symbol().alias("symbol"), C.amount_label().alias("amount"), C.lag_days().alias("lag_days"))).alias("one"),
    ).filter("n > 0")
    first = lambda c: rows.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c).limit(most).agg(F.sort_array(F.collect_list(c)).alias(f"first_{c}"))
    named = told.join(first("ticker"), F.lit(True)).join(first("member_name"), F.lit(True))  # each has one row
    by_ticker = F.col("n_tickers") > 0
    single = lambda c: F.when(F.col("n") == 1, F.col(f"one.{c}")).alias(c)
    return named.select(
        "n", F.array_join(F.when(by_ticker, F.col("first_ticker")).otherwise(F.col("first_member_name")), ", ").alias("names"), F.greatest(F.when(by_ticker, F.col("n_tickers")).otherwise(F.col("n_members")) - most, F.lit(0)).cast("long").alias("more"),
        *[single(c) for c in ("member_name", "tx_type", "symbol", "amount", "lag_days")],
    )


def followed(follows: DataFrame, members: DataFrame) -> DataFrame:
    """Followed members that have a record, in order of name."""
    return follows.distinct().join(members.select(F.col("id").alias("member_id"), "name", "chamber"), "member_id").orderBy("name", "member_id")


def missing(follows: DataFrame, members: DataFrame) -> DataFrame:
    """One row: how many followed ids have no record."""
    return follows.distinct().join(members.select(F.col("id").alias("member_id")), "member_id", "left_anti").agg(F.count("*").alias("missing"))


def new_section(matches: DataFrame, seen: DataFrame, limit: int = 50) -> DataFrame:
    """Matches not seen before, newest first, as many as are shown; `mark_seen` takes these, and the rest come next time."""
    from quaystone.operators import feed

    return feed.just_disclosed(matches.join(seen.select(F.col("row_id").alias("id")), "id", "left_anti"), limit)


def widget(trades: DataFrame, mode: str, tickers: DataFrame, follows: DataFrame, ticker: str | None = None, limit: int = 5) -> DataFrame:
    """Rows for a small display: latest, watchlist or one ticker; latest if nothing is set."""
    from quaystone.operators import feed

    rows = trades
    if mode == "watchlist" and not (tickers.isEmpty() and follows.isEmpty()):
        rows = feed.relevant(trades, tickers, follows)
    elif mode == "ticker" and ticker:
        rows = trades.filter(F.upper("ticker") == ticker.strip().upper())
    return feed.just_disclosed(rows, limit)

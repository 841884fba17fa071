"""The feed: order, filters, de-duplication, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystone.functions import columns as C
from quaystone.functions import ids

BRACKETS = {"1M": 100_000_100, "5M": 500_000_100, "50M": 5_000_000_100}


def with_dates(trades: DataFrame) -> DataFrame:
    return trades.withColumns({"lag_days": C.lag_days(), "impossible": C.impossible(), "sort_date": C.sort_date()})


def ranked(trades: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows of a total order, with their rank: a top-k, then a window over those k rows alone."""
    return trades.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def recent(trades: DataFrame, limit: int = 400) -> DataFrame:
    return ranked(with_dates(trades), [F.desc("sort_date"), F.desc("id")], limit)


def just_disclosed(trades: DataFrame, limit: int = 60) -> DataFrame:
    return ranked(with_dates(trades), [F.desc("disclosed_date"), F.desc("id")], limit)


def select(
    trades: DataFrame, members: DataFrame | None = None, *, types: set[str] = frozenset(), owners: set[str] = frozenset(), states: set[str] = frozenset(), chambers: set[str] = frozenset(),
    options_only: bool = False, late_only: bool = False, min_bracket: str | None = None, ids_in: DataFrame | None = None, search: str = "",
) -> DataFrame:
    """Faceted filter. An empty set does not filter; unknown members fail the state and chamber facets."""
    out = trades
    if types:
        out = out.filter(F.col("tx_type").isin(*sorted(types)))
    if owners:
        out = out.filter(F.col("owner").isin(*sorted(owners)))
    if (states or chambers) and members is not None:
        wanted = members.select(F.col("id").alias("_m"), F.col("state").alias("_s"), F.col("chamber").alias("_c"))
        if states:
            wanted = wanted.filter(F.col("_s").isin(*sorted(states)))
        if chambers:
            wanted = wanted.filter(F.col("_c").isin(*sorted(chambers)))
        out = out.join(wanted, out.member_id == F.col("_m"), "left_semi")
    if options_only:
        out = out.filter(C.is_option())
    if late_only:
        out = out.filter(C.late())
    if min_bracket:
        out = out.filter((F.col("amount_kind") == "atLeast") | (F.col("low_cents") >= BRACKETS[min_bracket]))
    if ids_in is not None:
        out = out.join(ids_in.select("id"), "id", "left_semi")
    if needle := search.strip().lower():
        out = out.filter(F.lower(F.concat_ws(" ", "member_name", F.coalesce("ticker", F.lit("")), "asset")).contains(needle))
    return out


def by_member(trades: DataFrame, member_id: str) -> DataFrame:
    return trades.filter(F.col("member_id") == member_id)


def member_feed(trades: DataFrame, member_id: str, limit: int = 300) -> DataFrame:
    """A member's rows in the feed's order, with their rank."""
    return ranked(with_dates(by_member(trades, member_id)), [F.desc("sort_date"), F.desc("id")], limit)


def members_in_order(members: DataFrame, limit: int = 300) -> DataFrame:
    """Members by name, with their rank; as many as are shown."""
    return ranked(members, [F.col("name"), F.col("id")], limit)


def by_filing(trades: DataFrame, filing_id: str) -> DataFrame:
    return trades.filter(F.col("filing_id") == filing_id)


def by_ticker(trades: DataFrame, ticker: str) -> DataFrame:
    """Rows of a ticker, in letters of any case; none for an empty one."""
    return trades.filter((F.upper("ticker") == ticker.strip().upper()) & F.lit(bool(ticker.strip())))


def member_search(members: DataFrame, asked: str) -> DataFrame:
    """Members whose name has what is asked for in it, or whose state it is, in letters of any case; all members for nothing."""
    q = asked.strip().lower()
    return members.filter(F.lower("name").contains(q) | (F.lower("state") == q)) if q else members


def active_facets(**facets) -> int:
    return sum(bool(v) for v in facets.values())


def relevant(trades: DataFrame, tickers: DataFrame, follows: DataFrame) -> DataFrame:
    """Rows of a watched ticker or a followed member; none if nothing is watched."""
    w = tickers.select(F.upper("ticker").alias("_t")).distinct().withColumn("_w", F.lit(True))
    f = follows.select(F.col("member_id").alias("_f")).distinct().withColumn("_m", F.lit(True))
    joined = trades.join(w, F.upper("ticker") == F.col("_t"), "left").join(f, trades.member_id == F.col("_f"), "left")
    return joined.filter(F.col("_w") | F.col("_m")).drop("_t", "_w", "_f", "_m")


def unseen(trades: DataFrame, tickers: DataFrame, follows: DataFrame, seen: DataFrame) -> DataFrame:
    return relevant(trades, tickers, follows).join(seen.select(F.col("row_id").alias("id")), "id", "left_anti")


def trim_seen(seen: DataFrame, above: int = 20_000, keep: int = 10_000) -> DataFrame:
    """Beyond `above` ids only the `keep` highest stay."""
    return seen if seen.count() <= above else seen.orderBy(F.desc("row_id")).limit(keep)


def deduplicate(trades: DataFrame, order: list[Column]) -> DataFrame:
    """Of rows with one member and fingerprint, the first in order stays."""
    first = Window.partitionBy("member_id", "_f").orderBy(*order)
    return trades.withColumn("_f", ids.fingerprint()).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_f", "_n")


def merge(seed: DataFrame, new: DataFrame) -> DataFrame:
    """Seed rows win over new ones with the same member and fingerprint; `origin` says where a row is from."""
    both = seed.withColumn("origin", F.lit("seed")).unionByName(new.withColumn("origin", F.lit("new")))
    return deduplicate(both, [F.desc("origin"), F.col("id")])


def upsert_members(seed: DataFrame, new: DataFrame) -> DataFrame:
    """Insert only: a known id keeps its record."""
    return seed.unionByName(new.join(seed.select("id"), "id", "left_anti").dropDuplicates(["id"]))


def changed(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """rows with the values that changes give for their key (one row each); null, or no row, leaves a value as it is."""
    given = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in given])
    return rows.join(new, F.col(key) == F.col("_key"), "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in given else F.col(c) for c in rows.columns])


def possible_duplicate_amendments(trades: DataFrame) -> DataFrame:
    """Rows that share all but the amount, if one of them amends."""
    same = Window.partitionBy("member_id", F.upper(F.coalesce("ticker", "asset")), F.coalesce("asset_type", F.lit("")), "tx_type", "owner", "tx_date")
    return trades.withColumns({"_n": F.count("*").over(same), "_a": F.max(F.col("is_amendment").cast("int")).over(same)}).filter("_n > 1 and _a = 1").drop("_n", "_a")


def new_filings(index: DataFrame, known: DataFrame, limit: int = 60) -> DataFrame:
    """Filings not yet known, newest first, undated last; `more_remaining` says whether the cap left some."""
    fresh = index.join(known.select("filing_id"), "filing_id", "left_anti")
    total = fresh.count()
    return ranked(fresh, [F.desc_nulls_last("filed_on"), F.desc("filing_id")], limit).withColumn("more_remaining", F.lit(total > limit))


def name_match(members: DataFrame, query: str) -> DataFrame:
    """Exact, else prefix, else substring; a tier with two people answers nobody and ends the search."""
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    q, name = F.lit(" ".join(query.lower().split())), fold(F.col("name"))
    tier = F.when(name == q, 1).when(name.startswith(q), 2).when(name.contains(q), 3)
    hits = members.select("id", "name", tier.alias("tier")).filter("tier is not null")
    best = hits.groupBy("tier").agg(F.count_distinct("id").alias("people"), F.min(F.struct("id", "name")).alias("m")).orderBy("tier").limit(1)
    return best.filter("people = 1").select("m.id", "m.name", "tier")


def csv_projection(trades: DataFrame, members: DataFrame) -> DataFrame:
    """The 19 columns of the export."""
    m = members.select(F.col("id").alias("_m"), F.col("chamber").alias("m_chamber"), "party")
    return trades.drop("chamber").join(m, trades.member_id == F.col("_m"), "left").select(
        "member_name", F.coalesce("m_chamber", F.lit("")).alias("chamber"), F.coalesce("party", F.lit("")).alias("party"), "owner", F.col("tx_type").alias("transaction_type"), "asset", F.coalesce("ticker", F.lit("")).alias("ticker"), F.coalesce("asset_type", F.lit("")).alias("asset_type"),
        F.date_format("tx_date", "yyyy-MM-dd").alias("transaction_date"), F.date_format("disclosed_date", "yyyy-MM-dd").alias("disclosed_date"), C.lag_days().cast("long").alias("disclosure_lag_days"), C.impossible().alias("has_impossible_date"),
        C.amount_label().alias("amount_label"), F.col("low_cents").alias("amount_low_cents"), F.col("high_cents").alias("amount_high_cents"), "is_amendment", F.coalesce("warning", F.lit("")).alias("warnings"), "filing_id", F.coalesce(C.document_url(F.col("filing_id"), "https://filings.example/"), F.lit("")).alias("source_url"),
    )


def write_csv(projection: DataFrame, path: str) -> None:
    projection.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\n").option("emptyValue", "").csv(path)

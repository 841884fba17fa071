"""The catalogue of named queries and their SQL counterparts.

Capped queries carry their rank as a column, so that comparing rows without order checks the order too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.functions import amounts, ids, names
from quaystone.functions import columns as C
from quaystone.operators import feed, identity, rules, stats, watch
from quaystone.plans import sinks
from quaystone.sources import indexes, reports, testdata
from quaystone.sources.testdata import CTE
from quaystone.streaming import refresh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, cte: bool = True):
    """Register a function (spark, sf_dir) -> DataFrame under a name, with its SQL."""

    def register(f):
        QUERIES[name] = f
        if sql:
            text = sql.strip()
            if cte:
                text = f"WITH {CTE.strip()}, {text[5:]}" if text.upper().startswith("WITH ") else f"WITH {CTE.strip()} {text}"
            ORACLES[name] = text
        return f

    return register


def on_trades(name: str, sql: str | None = None):
    """Register a function of the trades alone."""
    return lambda f: query(name, sql)(lambda spark, d: f(testdata.trades(spark, d))) and f


def on_both(name: str, sql: str | None = None):
    """Register a function of trades and members."""
    return lambda f: query(name, sql)(lambda spark, d: f(testdata.trades(spark, d), testdata.members(spark, d))) and f


# Statistics -------------------------------------------------------------------------------------

on_trades("widely_held_tickers", "SELECT symbol AS ticker, count(DISTINCT member_id) AS member_count, count(*) AS trade_count FROM feed WHERE symbol IS NOT NULL GROUP BY symbol HAVING count(DISTINCT member_id) >= 3")(stats.widely_held)
on_trades("composition_tx_type", "SELECT tx_type, count(*) AS n FROM feed GROUP BY tx_type")(stats.by_tx_type)
on_trades("composition_asset_type", "SELECT asset_type, count(*) AS n FROM feed WHERE asset_type IS NOT NULL GROUP BY asset_type")(lambda t: stats.by_asset_type(t).drop("name"))
on_trades(
    "lag_stats",
    """WITH lags AS (SELECT lag FROM feed WHERE NOT impossible)
    SELECT count(*) AS n, CAST(coalesce(round(median(lag)), 0) AS BIGINT) AS median_days, CAST(coalesce(round(avg(lag)), 0) AS BIGINT) AS mean_days, count(*) FILTER (WHERE lag > 45) AS over_45,
      CAST(CASE WHEN count(*) > 0 THEN round(100.0 * count(*) FILTER (WHERE lag > 45) / count(*)) ELSE 0 END AS BIGINT) AS percent_over_45 FROM lags""",
)(stats.lag_stats)
on_trades(
    "lag_buckets",
    """WITH b(position, bucket, lo, hi) AS (VALUES (0, '0-7', -1000000, 7), (1, '8-30', 8, 30), (2, '31-45', 31, 45), (3, '46-90', 46, 90), (4, 'over 90', 91, 1000000))
    SELECT CAST(position AS BIGINT) AS position, bucket, count(lag) AS n FROM b LEFT JOIN (SELECT lag FROM feed WHERE NOT impossible) ON lag BETWEEN lo AND hi GROUP BY ALL""",
)(stats.lag_buckets)
on_trades("known_tickers", "SELECT symbol AS ticker, count(*) AS n FROM feed WHERE symbol IS NOT NULL GROUP BY symbol")(stats.known_tickers)
on_trades("ticker_suggestions", "SELECT symbol AS ticker, count(*) AS n FROM feed WHERE symbol LIKE 'BR1%' GROUP BY symbol ORDER BY n DESC, symbol LIMIT 8")(lambda t: stats.ticker_suggestions(t, "br1"))
query("members_by_activity", "SELECT id, any_value(name) AS name, count(member_id) AS n FROM member LEFT JOIN feed ON member_id = id GROUP BY id".replace("SELECT id", "SELECT member.id").replace("= id GROUP BY id", "= member.id GROUP BY member.id"))(
    lambda spark, d: stats.members_by_activity(testdata.members(spark, d), testdata.trades(spark, d))
)
on_trades("member_profile", "SELECT member_id, count(*) AS trades, count(*) FILTER (WHERE tx_type = 'buy') AS buys, count(*) FILTER (WHERE tx_type <> 'buy') AS sells FROM feed GROUP BY member_id")(stats.member_profile)
on_trades(
    "member_top_tickers",
    """WITH c AS (SELECT member_id, ticker, count(*) AS n FROM feed WHERE ticker IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY n DESC, ticker) AS rank FROM c) SELECT member_id, ticker, n, rank FROM r WHERE rank <= 8""",
)(stats.member_top_tickers)
on_trades("ticker_profile", "SELECT symbol AS ticker, count(*) AS trades, count(*) FILTER (WHERE tx_type = 'buy') AS buys, count(*) FILTER (WHERE tx_type <> 'buy') AS others, count(DISTINCT member_id) AS members FROM feed WHERE symbol IS NOT NULL GROUP BY symbol")(stats.ticker_profile)
on_trades("counts_by_year", "SELECT CAST(year(tx_date) AS BIGINT) AS year, count(*) AS n FROM feed GROUP BY ALL")(stats.counts_by_year)
on_both(
    "data_quality",
    """SELECT count(*) AS rows, count(warning) AS recovered, count(*) FILTER (WHERE impossible) AS impossible, count(*) FILTER (WHERE is_amendment) AS amended, count(DISTINCT filing_id) AS filings,
      count(DISTINCT member_id) AS trading_members, min(tx_date) AS first_tx, max(tx_date) AS last_tx, (SELECT count(DISTINCT member_id) FROM committee) AS with_committees, (SELECT count(DISTINCT state) FROM member) AS states FROM feed""",
)(stats.data_quality)
on_both(
    "coverage_report",
    """SELECT 'rows' AS metric, count(*) AS value FROM feed UNION ALL SELECT 'filings', count(DISTINCT filing_id) FROM feed UNION ALL SELECT 'recovered', count(warning) FROM feed UNION ALL SELECT 'impossible', count(*) FROM feed WHERE impossible
    UNION ALL SELECT 'amended', count(*) FROM feed WHERE is_amendment UNION ALL SELECT 'trading_members', count(DISTINCT member_id) FROM feed UNION ALL SELECT 'with_committees', count(DISTINCT member_id) FROM committee UNION ALL SELECT 'states', count(DISTINCT state) FROM member""",
)(stats.coverage_report)
on_trades("warning_histogram", "SELECT warning, count(*) AS n FROM feed WHERE warning IS NOT NULL GROUP BY warning")(stats.warning_histogram)
query("party_tally", "SELECT party, count(*) AS n FROM member GROUP BY party")(lambda spark, d: stats.party_tally(testdata.members(spark, d)))
on_both("chamber_rows", "SELECT m.chamber AS branch, count(*) AS n FROM feed f JOIN member m ON m.id = f.member_id GROUP BY m.chamber")(stats.chamber_rows)
query("roster_counts", "SELECT count(DISTINCT member_id) AS members_mapped, count(*) AS assignments, count(DISTINCT committee) AS committees FROM committee")(lambda spark, d: stats.roster_counts(testdata.members(spark, d)))
on_trades("filing_counts", "SELECT filing_id, count(*) AS n FROM feed GROUP BY filing_id")(stats.filing_counts)

# Feed -------------------------------------------------------------------------------------------

on_trades("feed_recent", "SELECT id, sort_date, row_number() OVER (ORDER BY sort_date DESC, id DESC) AS rank FROM feed QUALIFY rank <= 400")(lambda t: feed.recent(t).select("id", "sort_date", "rank"))
on_trades("feed_just_disclosed", "SELECT id, disclosed_date, row_number() OVER (ORDER BY disclosed_date DESC, id DESC) AS rank FROM feed QUALIFY rank <= 60")(lambda t: feed.just_disclosed(t).select("id", "disclosed_date", "rank"))
on_trades("filter_types_owners", "SELECT id FROM feed WHERE tx_type IN ('buy', 'exchange') AND owner IN ('spouse', 'joint')")(lambda t: feed.select(t, types={"buy", "exchange"}, owners={"spouse", "joint"}).select("id"))
on_both("filter_state_chamber", "SELECT f.id FROM feed f JOIN member m ON m.id = f.member_id WHERE m.state IN ('NATION_1', 'NATION_6', 'NATION_17') AND m.chamber IN ('senate', 'executive')")(lambda t, m: feed.select(t, m, states={"NATION_1", "NATION_6", "NATION_17"}, chambers={"senate", "executive"}).select("id"))
on_trades("filter_options", "SELECT id FROM feed WHERE asset_type = 'OP'")(lambda t: feed.select(t, options_only=True).select("id"))
on_trades("filter_late", "SELECT id, lag AS lag_days FROM feed WHERE NOT impossible AND lag > 45")(lambda t: feed.with_dates(feed.select(t, late_only=True)).select("id", F.col("lag_days").cast("long")))
on_trades("filter_min_bracket", "SELECT id FROM feed WHERE amount_kind = 'atLeast' OR low_cents >= 500000100")(lambda t: feed.select(t, min_bracket="5M").select("id"))
on_trades("filter_search", "SELECT id FROM feed WHERE contains(lower(member_name || ' ' || coalesce(ticker, '') || ' ' || asset), 'br1')")(lambda t: feed.select(t, search="  BR1 ").select("id"))
on_trades("by_member", "SELECT id FROM feed WHERE member_id = 'C1'")(lambda t: feed.by_member(t, "C1").select("id"))
on_trades("by_filing", "SELECT id FROM feed WHERE filing_id = '32'")(lambda t: feed.by_filing(t, "32").select("id"))
on_trades("by_ticker", "SELECT id FROM feed WHERE symbol = 'BR11ST'")(lambda t: feed.by_ticker(t, " br11st").select("id"))

on_trades("member_feed", "SELECT id, sort_date, row_number() OVER (ORDER BY sort_date DESC, id DESC) AS rank FROM feed WHERE member_id = 'C5' QUALIFY rank <= 300")(lambda t: feed.member_feed(t, "C5").select("id", "sort_date", "rank"))
query("members_in_order", "SELECT id, name, row_number() OVER (ORDER BY name, id) AS rank FROM member QUALIFY rank <= 300")(lambda spark, d: feed.members_in_order(testdata.members(spark, d)).select("id", "name", "rank"))

_WATCH = "tickers(ticker) AS (VALUES ('br11ST'), ('BR23PR')), follows(member_id) AS (VALUES ('C1'), ('C5'))"


def _watched(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([("br11ST",), ("BR23PR",)], "ticker string"), spark.createDataFrame([("C1",), ("C5",)], "member_id string")


@query("watchlist_matches", f"WITH {_WATCH} SELECT id FROM feed WHERE symbol IN (SELECT upper(ticker) FROM tickers) OR member_id IN (SELECT member_id FROM follows)")
def _watchlist(spark, d):
    return feed.relevant(testdata.trades(spark, d), *_watched(spark)).select("id")


@query("unseen_matches", f"WITH {_WATCH} SELECT id FROM feed WHERE (symbol IN (SELECT upper(ticker) FROM tickers) OR member_id IN (SELECT member_id FROM follows)) AND NOT is_amendment")
def _unseen(spark, d):
    t = testdata.trades(spark, d)
    seen = t.filter("is_amendment").select(F.col("id").alias("row_id"))
    return feed.unseen(t, *_watched(spark), seen).select("id")


@query(
    "new_filings",
    """WITH f AS (SELECT filing_id, max(disclosed_date) AS filed_on FROM feed GROUP BY filing_id), known AS (SELECT DISTINCT filing_id FROM feed WHERE is_amendment),
    fresh AS (SELECT * FROM f WHERE filing_id NOT IN (SELECT filing_id FROM known))
    SELECT filing_id, filed_on, row_number() OVER (ORDER BY filed_on DESC NULLS LAST, filing_id DESC) AS rank, (SELECT count(*) FROM fresh) > 60 AS more_remaining FROM fresh QUALIFY rank <= 60""",
)
def _new_filings(spark, d):
    t = testdata.trades(spark, d)
    return feed.new_filings(t.groupBy("filing_id").agg(F.max("disclosed_date").alias("filed_on")), t.filter("is_amendment").select("filing_id").distinct())


_ASKED = " customer#000000007 "
query(
    "member_name_match",
    f"""WITH q AS (SELECT lower(trim('{_ASKED}')) AS q), hits AS (SELECT id, name, CASE WHEN lower(name) = q THEN 1 WHEN starts_with(lower(name), q) THEN 2 WHEN contains(lower(name), q) THEN 3 END AS tier FROM member, q),
    best AS (SELECT tier, count(DISTINCT id) AS people, min(id) AS id FROM hits WHERE tier = (SELECT min(tier) FROM hits) GROUP BY tier)
    SELECT h.id, h.name, h.tier FROM best b JOIN hits h ON h.tier = b.tier AND h.id = b.id WHERE people = 1""",
)(lambda spark, d: feed.name_match(testdata.members(spark, d), _ASKED))
on_both("member_search", "SELECT id, name FROM member WHERE contains(lower(name), '00001') OR lower(state) = '00001'")(lambda t, m: feed.member_search(m, " 00001").select("id", "name"))

_FP = "coalesce(ticker, asset) || '|' || coalesce(asset_type, '') || '|' || tx_type || '|' || CAST(tx_date AS VARCHAR) || '|' || low_cents || '|' || high_cents || '|' || owner"
on_trades("dedupe", f"SELECT id FROM feed QUALIFY row_number() OVER (PARTITION BY member_id, {_FP} ORDER BY id) = 1")(lambda t: feed.deduplicate(t, [F.col("id")]).select("id"))
on_trades("fingerprints", f"SELECT id, {_FP} AS fingerprint FROM feed")(lambda t: t.select("id", ids.fingerprint().alias("fingerprint")))
on_trades(
    "merge_feed",
    f"WITH o AS (SELECT *, CASE WHEN hash_part = 0 THEN 'new' ELSE 'seed' END AS origin FROM (SELECT *, CAST(filing_id AS BIGINT) % 4 AS hash_part FROM feed)) SELECT id, origin FROM o QUALIFY row_number() OVER (PARTITION BY member_id, {_FP} ORDER BY origin DESC, id) = 1",
)(lambda t: feed.merge(t.filter("cast(filing_id as bigint) % 4 <> 0"), t.filter("cast(filing_id as bigint) % 4 = 0")).select("id", "origin"))
query("members_upsert", "SELECT id, CASE WHEN c_custkey % 3 = 0 THEN name ELSE name || ' (new)' END AS name FROM member")(
    lambda spark, d: feed.upsert_members(
        (m := testdata.members(spark, d).select("id", "name")).filter("cast(substring(id, 2) as bigint) % 3 = 0"), m.withColumn("name", F.concat("name", F.lit(" (new)")))
    )
)
on_trades(
    "possible_duplicate_amendments",
    """SELECT id FROM feed QUALIFY count(*) OVER w > 1 AND bool_or(is_amendment) OVER w WINDOW w AS (PARTITION BY member_id, upper(coalesce(ticker, asset)), coalesce(asset_type, ''), tx_type, owner, tx_date)""".replace(
        "SELECT id FROM feed QUALIFY count(*) OVER w > 1 AND bool_or(is_amendment) OVER w WINDOW w AS (", "SELECT id FROM (SELECT id, count(*) OVER w AS n, max(CAST(is_amendment AS INTEGER)) OVER w AS a FROM feed WINDOW w AS ("
    )
    + ") WHERE n > 1 AND a = 1",
)(lambda t: feed.possible_duplicate_amendments(t).select("id"))

_DOLLARS = "'$' || format('{{:,}}', CAST({0} / 100 AS BIGINT))"
_LABEL = f"CASE amount_kind WHEN 'range' THEN {_DOLLARS.format('low_cents')} || ' – ' || {_DOLLARS.format('high_cents')} WHEN 'atLeast' THEN {_DOLLARS.format('low_cents')} || '+' ELSE 'Amount not readable' END"
on_both(
    "csv_projection",
    f"""SELECT f.member_name, coalesce(m.chamber, '') AS chamber, coalesce(m.party, '') AS party, f.owner, f.tx_type AS transaction_type, f.asset, coalesce(f.ticker, '') AS ticker, coalesce(f.asset_type, '') AS asset_type,
      CAST(f.tx_date AS VARCHAR) AS transaction_date, CAST(f.disclosed_date AS VARCHAR) AS disclosed_date, f.lag AS disclosure_lag_days, f.impossible AS has_impossible_date, {_LABEL} AS amount_label, f.low_cents AS amount_low_cents, f.high_cents AS amount_high_cents,
      f.is_amendment, coalesce(f.warning, '') AS warnings, f.filing_id, 'https://filings.example/' || f.filing_id || '.pdf' AS source_url FROM feed f LEFT JOIN member m ON m.id = f.member_id""",
)(feed.csv_projection)
_GAP = "CASE WHEN impossible THEN 'dates contradict' ELSE 'lag ' || lag || ' d' END"
_CLEAN = "CASE WHEN asset_type IS NULL THEN asset ELSE substr(asset, 1, length(asset) - length(coalesce(' (' || ticker || ')', '') || ' [' || asset_type || ']')) END"
on_trades(
    "derived_columns",
    f"""SELECT id, lag AS lag_days, impossible, NOT impossible AND lag > 45 AS late, coalesce(asset_type = 'OP', false) AS is_option, sort_date,
      {_CLEAN} AS clean_asset, coalesce(ticker, substr({_CLEAN}, 1, 18)) AS symbol,
      {_GAP} AS gap FROM feed""",
)(lambda t: t.select("id", C.lag_days().cast("long").alias("lag_days"), C.impossible().alias("impossible"), C.late().alias("late"), C.is_option().alias("is_option"), C.sort_date().alias("sort_date"), C.clean_asset().alias("clean_asset"), C.symbol().alias("symbol"), C.gap_phrase().alias("gap")))
_FNV = "list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), list_transform(string_split(fp, ''), lambda x: CAST(ascii(x) AS UHUGEINT))), lambda a, b: (xor(a, b) * CAST(1099511628211 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT))"
on_trades(
    "stable_ids",
    f"""WITH p AS (SELECT id AS row_id, filing_id, {_FP} AS fp FROM feed), h AS (SELECT row_id, filing_id, lpad(lower(hex(CAST({_FNV} AS UBIGINT))), 16, '0') AS h FROM p),
    n AS (SELECT *, row_number() OVER (PARTITION BY filing_id, h ORDER BY row_id) AS n FROM h) SELECT row_id, filing_id || '-' || h || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS id FROM n""",
)(lambda t: ids.stable_ids(t.withColumnRenamed("id", "row_id"), "row_id").select("row_id", "id"))

# Rules ------------------------------------------------------------------------------------------

on_trades("top_bracket", "SELECT id, low_cents FROM feed WHERE low_cents >= 500000000")(lambda t: rules.top_bracket(t).select("id", "low_cents"))
on_trades("filed_late", "SELECT id, lag AS lag_days FROM feed WHERE NOT impossible AND lag > 45 AND lag <= 1200 QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY lag DESC, disclosed_date DESC, id) = 1")(lambda t: rules.filed_late(t).select("id", F.col("lag_days").cast("long")))
on_trades(
    "new_position",
    """WITH a AS (SELECT max(disclosed_date) AS anchor FROM feed), c AS (SELECT *, count(*) OVER (PARTITION BY member_id) AS n FROM feed),
    f AS (SELECT * FROM c WHERE symbol IS NOT NULL QUALIFY row_number() OVER (PARTITION BY member_id, symbol ORDER BY tx_date, disclosed_date, id) = 1)
    SELECT id FROM f, a WHERE date_diff('day', disclosed_date, anchor) BETWEEN 0 AND 30 AND n >= 2 QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY disclosed_date DESC, id) = 1""",
)(lambda t: rules.new_position(t).select("id"))
_OFF = """WITH c AS (SELECT *, count(*) OVER w AS n, avg(CASE WHEN asset_type IN ('MF', 'EF') OR ticker IS NULL THEN 1.0 ELSE 0.0 END) OVER w AS funds FROM feed WINDOW w AS (PARTITION BY member_id))
    SELECT id FROM c WHERE n >= 5 AND funds >= 0.8 AND ticker IS NOT NULL AND asset_type IN ('ST', 'OP') QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY disclosed_date DESC, id) = 1"""
on_trades("off_pattern", _OFF)(lambda t: rules.off_pattern(t).select("id"))
on_trades("filter_off_pattern", _OFF)(lambda t: feed.select(t, ids_in=rules.off_pattern(t)).select("id"))
on_trades("rare_trader", "SELECT id, count(*) OVER (PARTITION BY member_id) AS member_rows FROM feed QUALIFY member_rows <= 3")(lambda t: rules.rare_trader(t).select("id", "member_rows"))
on_trades("member_largest", "WITH b AS (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY low_cents DESC, amount_kind = 'atLeast' DESC, disclosed_date DESC, id) = 1) SELECT id, low_cents FROM b WHERE low_cents >= 25000000")(lambda t: rules.member_largest(t).select("id", "low_cents"))
on_trades(
    "member_volume_trend",
    """WITH a AS (SELECT max(disclosed_date) AS anchor FROM feed), t AS (SELECT *, date_diff('day', disclosed_date, anchor) <= 30 AS recent_row FROM feed, a),
    g AS (SELECT member_id, count(*) FILTER (WHERE recent_row) AS recent, count(*) FILTER (WHERE NOT recent_row) AS baseline, date_diff('day', min(disclosed_date) FILTER (WHERE NOT recent_row), max(anchor)) - 30 AS days FROM t GROUP BY member_id),
    m AS (SELECT *, recent / (baseline / greatest(days, 30) * 30) AS multiple FROM g WHERE recent >= 4 AND baseline > 0),
    l AS (SELECT * FROM t WHERE recent_row QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY disclosed_date DESC, sort_date DESC, id DESC) = 1)
    SELECT l.id, m.recent, round(m.multiple, 1) AS multiple FROM m JOIN l USING (member_id) WHERE multiple >= 3.0""",
)(lambda t: rules.member_volume_trend(t).select("id", "recent", "multiple"))

_CLUSTER = """l AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY {keys}, member_id ORDER BY disclosed_date DESC, sort_date DESC, id DESC) = 1),
    w AS (SELECT *, count(*) OVER f AS members, date_diff('day', min(disclosed_date) OVER f, disclosed_date) AS span_days{more} FROM l WINDOW f AS (PARTITION BY {keys} ORDER BY disclosed_date RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW))
    SELECT {keys}, id, members, span_days FROM w WHERE members >= {least}{also} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY members DESC, span_days, disclosed_date, id DESC) = 1"""
on_trades("ticker_cluster", "WITH src AS (SELECT * FROM feed WHERE symbol IS NOT NULL), " + _CLUSTER.format(keys="symbol", least=3, more="", also=""))(lambda t: rules.ticker_cluster(t).select("symbol", "id", "members", "span_days"))
on_both(
    "cross_branch_ticker",
    "WITH src AS (SELECT f.*, m.chamber = 'executive' AS ex FROM feed f JOIN member m ON m.id = f.member_id WHERE symbol IS NOT NULL), "
    + _CLUSTER.format(keys="symbol", least=2, more=", max(CAST(ex AS INTEGER)) OVER f AS some_ex, min(CAST(ex AS INTEGER)) OVER f AS all_ex", also=" AND some_ex = 1 AND all_ex = 0"),
)(lambda t, m: rules.cross_branch(t, m).select("symbol", "id", "members", "span_days"))
on_both("committee_cluster", "WITH src AS (SELECT f.*, c.committee FROM feed f JOIN committee c ON c.member_id = f.member_id WHERE symbol IS NOT NULL), " + _CLUSTER.format(keys="symbol, committee", least=2, more="", also=""))(
    lambda t, m: rules.committee_cluster(t, m).select("symbol", "committee", "id", "members", "span_days")
)
on_trades(
    "owner_pattern",
    """WITH g AS (SELECT member_id, count(*) AS rows, count(*) FILTER (WHERE owner IN ('spouse', 'dependent')) AS family FROM feed GROUP BY member_id),
    l AS (SELECT * FROM feed WHERE owner IN ('spouse', 'dependent') QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY disclosed_date DESC, sort_date DESC, id DESC) = 1)
    SELECT l.id, g.rows, CAST(round(100.0 * family / rows) AS BIGINT) AS percent FROM g JOIN l USING (member_id) WHERE rows >= 5 AND family / rows >= 0.8""",
)(lambda t: rules.owner_pattern(t).select("id", "rows", "percent"))
on_trades(
    "headline",
    """WITH x AS (SELECT count(*) FILTER (WHERE NOT impossible AND lag > 365 AND lag <= 1200) AS late, count(*) FILTER (WHERE low_cents >= 500000000) AS big, max(low_cents) AS largest FROM feed),
    t AS (SELECT symbol, count(DISTINCT member_id) AS m FROM feed WHERE symbol IS NOT NULL GROUP BY symbol HAVING m >= 3 ORDER BY m DESC, symbol LIMIT 1),
    facts AS (SELECT 1 AS k, 'year_late' AS kind, late AS n, NULL AS label FROM x WHERE late >= 3 UNION ALL SELECT 2, CASE WHEN big >= 3 THEN 'top_brackets' ELSE 'largest_bracket' END, CASE WHEN big >= 3 THEN big ELSE largest END, NULL FROM x WHERE big > 0
      UNION ALL SELECT 3, 'widely_held', m, symbol FROM t UNION ALL SELECT 4, 'snapshot', (SELECT count(*) FROM feed), (SELECT min(year(tx_date)) || '-' || max(year(tx_date)) FROM feed)),
    r AS (SELECT *, row_number() OVER (ORDER BY k) AS i FROM facts)
    SELECT a.kind AS lead, CAST(a.n AS BIGINT) AS lead_n, a.label AS lead_label, b.kind AS supporting, CAST(b.n AS BIGINT) AS supporting_n, b.label AS supporting_label FROM (SELECT * FROM r WHERE i = 1) a LEFT JOIN (SELECT * FROM r WHERE i = 2 AND k < 4) b ON true""",
)(rules.headline)

# Text and other tables --------------------------------------------------------------------------


@query(
    "parse_amount",
    """SELECT event_id, kind, low_cents, high_cents FROM (SELECT event_id, event_id % 6 AS k, event_id * 100 + 100100 AS v FROM events), LATERAL (SELECT
      CASE k WHEN 0 THEN 'range' WHEN 1 THEN 'atLeast' WHEN 2 THEN 'exact' WHEN 3 THEN 'none' WHEN 4 THEN 'unknown' ELSE 'atLeast' END AS kind,
      CAST(CASE WHEN k IN (3, 4) THEN 0 ELSE v END AS BIGINT) AS low_cents, CAST(CASE WHEN k IN (3, 4) THEN 0 WHEN k = 0 THEN v + 500000 ELSE v END AS BIGINT) AS high_cents)""",
    cte=False,
)
def _parse_amount(spark, d):
    k, v = F.col("event_id") % 6, F.format_number(F.col("event_id") + 1001, 0)
    up = F.format_number(F.col("event_id") + 6001, 0)
    text = F.when(k == 0, F.concat(F.lit("$"), v, F.lit(" - $"), up)).when(k == 1, F.concat(F.lit("Over $"), v)).when(k == 2, F.concat(F.lit("$"), v, F.lit(".00"))).when(k == 3, F.lit("None (or less than $201)")).when(k == 4, F.lit("illegible")).otherwise(F.concat(F.lit("$"), v, F.lit(" +")))
    a = amounts.parse(text)
    return testdata.read(spark, d, "events").select("event_id", a["kind"].alias("kind"), a["low_cents"].alias("low_cents"), a["high_cents"].alias("high_cents"))


query("html_links", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages", cte=False)(
    lambda spark, d: testdata.read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
)
query("json_props", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events", cte=False)(lambda spark, d: testdata.read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")))
query("folded_names", "SELECT id, trim(regexp_replace(lower(name), '[^a-z ]', '', 'g')) AS folded, 'x-' || trim(regexp_replace(lower(name), '[^a-z ]', '', 'g')) AS slug FROM member")(
    lambda spark, d: testdata.members(spark, d).select("id", names.folded(F.col("name")).alias("folded"), names.fallback_id(F.col("name")).alias("slug"))
)


# Identity ---------------------------------------------------------------------------------------
# Members as a crosswalk: eight people to a surname, and seats by their number, so that every tier, every doubt and every miss occurs.

_PEOPLE = """p AS (SELECT c_custkey AS k, chr(CAST(97 + (c_custkey // 2) % 12 AS INTEGER)) || 'stone' || translate(CAST(c_custkey // 96 AS VARCHAR), '0123456789', 'abcdefghij') AS last, CASE c_custkey % 5 WHEN 0 THEN 'anna' WHEN 1 THEN 'ann' WHEN 2 THEN 'robert' WHEN 3 THEN 'mary kay' ELSE 'zed' END AS first, CASE WHEN c_custkey % 5 = 2 THEN 'bob' END AS nick,
    'N' || c_nationkey % 3 AS state, CASE WHEN c_custkey % 4 = 0 THEN 'senate' ELSE 'house' END AS chamber, c_custkey % 7 AS district, CASE WHEN c_custkey % 3 = 0 THEN 1990 ELSE 9999 END AS ends FROM customer),
    x AS (SELECT *, 'Z' || lpad(CAST(k AS VARCHAR), 6, '0') AS bioguide FROM p),
    f AS (SELECT CAST(k AS VARCHAR) AS filing_id, CASE WHEN k % 11 = 0 THEN 'nobody' ELSE last END AS last, CASE WHEN k % 6 = 0 THEN 'bob' WHEN k % 6 = 1 THEN 'an' ELSE first END AS first, state, CASE WHEN k % 2 = 0 THEN district END AS seat FROM x)"""


def _people(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(crosswalk, filings) of the customers."""
    k = F.col("c_custkey")
    first = F.when(k % 5 == 0, "Anna").when(k % 5 == 1, "Ann").when(k % 5 == 2, "Robert").when(k % 5 == 3, "Mary Kay").otherwise("Zed")
    last = F.concat(F.char(F.lit(97) + F.floor(k / 2) % 12), F.lit("stone"), F.translate(F.floor(k / 96).cast("string"), "0123456789", "abcdefghij"))
    x = testdata.read(spark, d, "customer").select(
        k.alias("k"), F.concat(F.lit("Z"), F.lpad(k.cast("string"), 6, "0")).alias("bioguide"), last.alias("last"), first.alias("first"), F.when(k % 5 == 2, "Bob").alias("nickname"), F.concat(F.lit("n"), (F.col("c_nationkey") % 3).cast("string")).alias("state"),
        F.when(k % 4 == 0, "senate").otherwise("house").alias("chamber"), (k % 7).cast("int").alias("district"), F.when(k % 3 == 0, 1990).otherwise(9999).alias("last_term_end_year"),
    )
    filed = x.select(
        F.col("k").cast("string").alias("filing_id"), F.when(F.col("k") % 11 == 0, "Nobody").otherwise(F.col("last")).alias("last"), F.when(F.col("k") % 6 == 0, "Bob").when(F.col("k") % 6 == 1, "An").otherwise(F.col("first")).alias("first"),
        F.upper("state").alias("state"), F.when(F.col("k") % 2 == 0, F.lpad(F.col("district").cast("string"), 2, "0")).alias("district"),
    )
    return x.drop("k"), filed


_ONE = "CASE WHEN count(DISTINCT bioguide) FILTER (WHERE {0}) = 1 THEN min(bioguide) FILTER (WHERE {0}) WHEN count(DISTINCT bioguide) FILTER (WHERE {0} AND seat = district) = 1 THEN min(bioguide) FILTER (WHERE {0} AND seat = district) END"
_EXACT = "(split_part(f.first, ' ', 1) = split_part(x.first, ' ', 1) OR coalesce(nick = split_part(f.first, ' ', 1), false))"
_ALIKE = "(starts_with(x.first, f.first) OR starts_with(f.first, x.first) OR coalesce(nick = f.first, false))"


@query(
    "identity_resolve",
    f"""WITH {_PEOPLE}, c AS (SELECT filing_id, {_ONE.format(_EXACT)} AS t1, count(DISTINCT bioguide) FILTER (WHERE {_EXACT}) AS exact, {_ONE.format('true')} AS t2, {_ONE.format(_ALIKE)} AS t3
      FROM f JOIN x ON x.state = f.state AND x.last = f.last GROUP BY filing_id),
    r AS (SELECT f.filing_id, c.filing_id IS NOT NULL AS seen, coalesce(t1, CASE WHEN exact < 2 THEN coalesce(t2, t3) END) AS bioguide FROM f LEFT JOIN c ON c.filing_id = f.filing_id)
    SELECT filing_id, bioguide, CASE WHEN bioguide IS NOT NULL THEN 'matched' WHEN seen THEN 'ambiguous' ELSE 'not_found' END AS resolution FROM r""",
    cte=False,
)
def _identity(spark, d):
    x, filed = _people(spark, d)
    return identity.resolve(filed, x)


@query(
    "identity_chamber",
    f"""WITH {_PEOPLE}, s AS (SELECT filing_id, split_part(first, ' ', 1) AS first, last, NULL::BIGINT AS seat FROM f),
    c AS (SELECT filing_id, {_ONE.format('true')} AS t1, {_ONE.format("(starts_with(x.first, s.first) OR starts_with(s.first, x.first) OR coalesce(nick = s.first, false))")} AS t2 FROM s JOIN x ON x.last = s.last AND x.chamber = 'senate' AND ends >= 2000 GROUP BY filing_id),
    r AS (SELECT s.filing_id, c.filing_id IS NOT NULL AS seen, coalesce(t1, t2) AS bioguide FROM s LEFT JOIN c ON c.filing_id = s.filing_id)
    SELECT filing_id, bioguide, CASE WHEN bioguide IS NOT NULL THEN 'matched' WHEN seen THEN 'ambiguous' ELSE 'not_found' END AS resolution FROM r""",
    cte=False,
)
def _identity_chamber(spark, d):
    x, filed = _people(spark, d)
    return identity.resolve_in_chamber(filed, x, "senate", 2000)


# Ingest -----------------------------------------------------------------------------------------
# Lines and pages of the sources, made from the tables.


@query(
    "clerk_index",
    "SELECT CAST(o_orderkey AS VARCHAR) AS filing_id, 'Mem' || o_custkey AS last, CASE WHEN o_orderkey % 4 = 0 THEN 'P' ELSE 'X' END AS filing_type, 'ST' AS state, lpad(CAST(o_custkey % 50 AS VARCHAR), 2, '0') AS district, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(o_orderdate AS DATE) AS filed_on, 'Jo Mem' || o_custkey AS full_name, o_orderkey % 4 = 0 AS is_ptr FROM orders",
    cte=False,
)
def _clerk(spark, d):
    date = F.to_date("o_orderdate")
    cells = [F.lit(" "), F.concat(F.lit("Mem"), F.col("o_custkey").cast("string")), F.lit("Jo"), F.lit(""), F.when(F.col("o_orderkey") % 4 == 0, "P").otherwise("X"), F.concat(F.lit("ST"), F.lpad((F.col("o_custkey") % 50).cast("string"), 2, "0")), F.year(date).cast("string"), F.date_format(date, "M/d/yyyy"), F.col("o_orderkey").cast("string")]
    lines = testdata.read(spark, d, "orders").select(F.concat(F.concat_ws("\t", *cells), F.lit("\r")).alias("value"))
    head = spark.createDataFrame([("Prefix\tLast\tFirst\tSuffix\tFilingType\tStateDst\tYear\tFilingDate\tDocID\r",), ("too\tshort",)], "value string")
    return indexes.clerk_index(head.unionByName(lines), 1990).select("filing_id", "last", "filing_type", "state", "district", F.col("year").cast("long"), "filed_on", "full_name", "is_ptr")


@query(
    "house_report",
    """WITH r AS (SELECT l_orderkey, l_linenumber, count(*) OVER w AS nth, l_partkey AS p, CAST(l_shipdate AS DATE) AS told, CAST(o_orderdate AS DATE) AS tx FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING))
    SELECT CAST(l_orderkey AS VARCHAR) AS filing_id, CAST(nth - 1 AS BIGINT) AS position, 'Firm ' || p || ' (TK) [ST]' AS asset, 'TK' AS ticker, 'ST' AS asset_type, tx AS tx_date, told AS disclosed_date, CASE p % 3 WHEN 0 THEN 'spouse' ELSE 'self' END AS owner,
      CASE p % 4 WHEN 0 THEN 'atLeast' WHEN 1 THEN 'range' WHEN 2 THEN 'exact' ELSE 'range' END AS amount_kind, CAST(p * 100 AS BIGINT) AS low_cents, CAST(CASE WHEN p % 4 IN (1, 3) THEN p * 100 + 500000 ELSE p * 100 END AS BIGINT) AS high_cents, p % 5 = 0 AS is_amendment, CASE WHEN p % 7 = 0 THEN 'Bought by plan.' END AS filing_description FROM r""",
    cte=False,
)
def _house_report(spark, d):
    p, us = F.col("l_partkey"), lambda c: F.date_format(F.to_date(c), "MM/dd/yyyy")
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    tail = F.when(p % 4 == 0, F.concat(F.lit("Over\n"), money(p))).when(p % 4 == 1, F.concat(money(p), F.lit(" - "), money(p + 5000))).when(p % 4 == 2, money(p)).otherwise(F.concat(money(p), F.lit(" -\n"), money(p + 5000)))
    row = F.concat(F.when(p % 3 == 0, "SP ").otherwise(""), F.lit("Firm "), p.cast("string"), F.lit("\n(TK) [ST] P "), us("o_orderdate"), F.lit(" "), us("l_shipdate"), F.lit(" "), tail, F.when(p % 5 == 0, "\nF      S     : Amended").otherwise(""), F.when(p % 7 == 0, "\nD          : Bought\nby plan.").otherwise(""))
    # Orders and lines meet by the text of their key, which is the filing's id, so that the reports lie where their rows are put together.
    of = lambda key: F.col(key).cast("string").alias("filing_id")
    line = testdata.read(spark, d, "lineitem").select(of("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    joined = line.join(testdata.read(spark, d, "orders").select(of("o_orderkey"), "o_orderdate"), "filing_id")
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("row"))))["row"]
    text = F.concat(F.lit(f"Name: Jo\n{reports.HEAD_OPENS} Transaction\nType Date\n{reports.HEAD_CLOSES}\n"), F.array_join(rows, "\n"), F.lit(f"\n{reports.FOOTERS[0]} of codes\nnone"))
    filings = joined.groupBy("filing_id").agg(text.alias("text")).select("filing_id", F.lit(None).cast("date").alias("filed_on"), "text")
    return reports.house_rows(filings).select("filing_id", F.col("position").cast("long"), "asset", "ticker", "asset_type", "tx_date", "disclosed_date", "owner", "amount_kind", "low_cents", "high_cents", "is_amendment", "filing_description")


# Watching, sinks, increments ----------------------------------------------------------------------

@query(
    "alert_digest",
    f"""WITH {_WATCH}, u AS (SELECT * FROM feed WHERE symbol IN (SELECT upper(ticker) FROM tickers) OR member_id IN (SELECT member_id FROM follows)),
    s AS (SELECT list_sort(list_distinct(list(ticker))) AS names, count(*) AS n FROM u)
    SELECT n, array_to_string(names[1:4], ', ') AS names, CAST(greatest(len(names) - 4, 0) AS BIGINT) AS more, NULL AS member_name, NULL AS tx_type, NULL AS symbol, NULL AS amount, NULL AS lag_days FROM s""",
)
def _alert(spark, d):
    return watch.alert(feed.relevant(testdata.trades(spark, d), *_watched(spark)))


on_both("provenance", "SELECT (SELECT string_agg(chamber, ', ' ORDER BY chamber) FROM (SELECT DISTINCT m.chamber FROM feed f JOIN member m ON m.id = f.member_id)) AS chambers, (SELECT string_agg(CAST(y AS VARCHAR), ', ' ORDER BY y) FROM (SELECT DISTINCT year(tx_date) AS y FROM feed)) AS years")(sinks.provenance)
query("incremental_events", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL", cte=False)(lambda spark, d: refresh.event_counts(testdata.read(spark, d, "events")))
_LO, _HI, _DAY = _DOLLARS.format("low_cents"), _DOLLARS.format("high_cents"), "strftime({0}, '%b %-d, %Y')"
_SPOKEN = f"CASE amount_kind WHEN 'range' THEN 'from ' || {_LO} || ' up to ' || {_HI} WHEN 'atLeast' THEN {_LO} || ' or more' ELSE 'an amount that was not read' END"
_VERB = "CASE tx_type WHEN 'buy' THEN 'Bought' WHEN 'sell' THEN 'Sold' WHEN 'partial_sell' THEN 'Sold (partial)' ELSE 'Exchanged' END"
_OWNER = "CASE owner WHEN 'self' THEN 'Member' WHEN 'spouse' THEN 'Spouse' WHEN 'joint' THEN 'Joint' ELSE 'Dependent' END"


@on_both(
    "display_columns",
    f"""SELECT f.id, {_VERB} AS verb, CASE tx_type WHEN 'buy' THEN '↑' WHEN 'exchange' THEN '↔' ELSE '↓' END AS arrow, tx_type = 'buy' AS is_acquisition, {_OWNER} AS owner_label,
    CASE m.party WHEN 'democrat' THEN 'D' WHEN 'republican' THEN 'R' WHEN 'independent' THEN 'I' ELSE '' END AS party_letter, CASE m.party WHEN 'democrat' THEN 'Democrat' WHEN 'republican' THEN 'Republican' WHEN 'independent' THEN 'Independent' ELSE 'Party unknown' END AS party_label,
    CASE m.chamber WHEN 'house' THEN 'House' WHEN 'senate' THEN 'Senate' ELSE 'Executive Branch' END AS chamber_tag, CASE m.chamber WHEN 'senate' THEN 'US Senate eFD' WHEN 'executive' THEN 'White House Public Disclosures' ELSE 'US House Clerk' END AS source_name,
    CASE amount_kind WHEN 'range' THEN {_LO} || ' – ' || {_HI} WHEN 'atLeast' THEN '≥ ' || {_LO} ELSE '?' END AS headline,
    CASE amount_kind WHEN 'range' THEN 'two bounds' WHEN 'atLeast' THEN 'lower bound only' ELSE 'no figure read' END AS caption, {_SPOKEN} AS spoken,
    {_DAY.format('disclosed_date')} AS date_label, {_DAY.format('tx_date')} || '; ' || {_GAP} AS timing FROM feed f LEFT JOIN member m ON m.id = f.member_id""",
)
def _display(t, m):
    shown = t.drop("chamber").join(m.select(F.col("id").alias("_m"), "party", "chamber"), F.col("member_id") == F.col("_m"), "left")
    return shown.select(
        "id", C.verb().alias("verb"), C.arrow().alias("arrow"), C.is_acquisition().alias("is_acquisition"), C.named(F.col("owner"), C.OWNERS).alias("owner_label"), C.party_letter().alias("party_letter"), C.party_label().alias("party_label"),
        C.chamber_tag(["house", "senate", "executive"]).alias("chamber_tag"), C.source_name().alias("source_name"), C.amount_headline().alias("headline"), C.amount_caption().alias("caption"), C.amount_spoken().alias("spoken"),
        C.date_label(F.col("disclosed_date")).alias("date_label"), C.timing().alias("timing"),
    )


on_trades(
    "summaries",
    f"""SELECT id, concat_ws('; ', member_name || ' / ' || {_OWNER}, {_VERB} || ': ' || {_CLEAN}, ticker,
      CASE asset_type WHEN 'ST' THEN 'Stock' WHEN 'OP' THEN 'Option' WHEN 'MF' THEN 'Mutual fund' WHEN 'EF' THEN 'Exchange-traded fund' WHEN 'GS' THEN 'Government security' END, {_SPOKEN}, {_DAY.format('tx_date')} || '; ' || {_GAP}) AS summary FROM feed""",
)(lambda t: t.select("id", C.summary().alias("summary")))
query("html_rows", "SELECT page_id, row, cells[row + 1] AS cell FROM (SELECT page_id, cells, unnest(range(len(cells))) AS row FROM (SELECT page_id, list_transform(regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1), lambda x: trim(regexp_replace(x, '(?s)<[^>]*>', '', 'g'))) AS cells FROM pages))", cte=False)(
    lambda spark, d: testdata.read(spark, d, "pages").select("page_id", F.posexplode(F.transform(F.regexp_extract_all("html", F.lit("(?s)<li[^>]*>(.*?)</li>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "(?s)<[^>]*>", "")))).alias("row", "cell")).select("page_id", F.col("row").cast("long").alias("row"), "cell")
)


# People, contacts, changes --------------------------------------------------------------------------


@query(
    "person_columns",
    """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'democrat' WHEN 1 THEN 'democrat' WHEN 2 THEN 'republican' WHEN 3 THEN 'independent' ELSE 'unknown' END AS party, CASE WHEN c_custkey % 4 = 0 THEN 'ST' ELSE 'ST-' || lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') END AS seat,
      CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 60 END AS seat_number, CASE c_custkey % 3 WHEN 0 THEN 'AC' WHEN 1 THEN '—' ELSE 'C' END AS initials, c_custkey % 2 = 0 AS is_bioguide, 'Jo Doe' || c_custkey AS called,
      CASE c_custkey % 6 WHEN 0 THEN 'Democrat · ' WHEN 1 THEN 'Democrat · ' WHEN 2 THEN 'Republican · ' WHEN 3 THEN 'Independent · ' ELSE '' END || CASE c_custkey % 2 WHEN 0 THEN 'Senate' ELSE 'Executive Branch' END || ' · ' || CASE WHEN c_custkey % 4 = 0 THEN 'ST' ELSE 'ST-' || lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') END AS identity_line,
      CASE WHEN c_custkey % 3 = 0 THEN 'BR.' || c_custkey % 100 END AS ticker FROM customer""",
    cte=False,
)
def _person(spark, d):
    k, t = F.col("c_custkey"), lambda c: c.cast("string")
    raw = F.when(k % 6 == 0, "Democrat").when(k % 6 == 1, "DEMOCRATIC").when(k % 6 == 2, "Republican").when(k % 6 == 3, "Libertarian").when(k % 6 == 4, "")
    people = testdata.read(spark, d, "customer").select(
        "c_custkey", C.party(raw).alias("party"), F.lit("ST").alias("state"), F.when(k % 4 != 0, F.lpad(t(k % 60), 2, "0")).alias("district"), F.when(k % 2 == 0, "senate").otherwise("executive").alias("chamber"),
        F.when(k % 3 == 0, F.concat(F.lit("Ann Q. "), "c_name")).when(k % 3 == 1, "Q.").otherwise(F.col("c_name")).alias("name"), F.when(k % 2 == 0, F.concat(F.lit("Doe"), t(k), F.lit(", Jo"))).otherwise(F.concat(F.lit("Jo Doe"), t(k))).alias("filed"),
        F.concat(F.when(k % 2 == 0, "Z").otherwise("z"), F.lpad(t(k), 6, "0")).alias("code"), F.when(k % 3 == 0, F.concat(F.lit(" br."), t(k % 100), F.lit(" "))).when(k % 3 == 1, " ").otherwise("thirteenchars").alias("asked"),
    )
    return people.select(
        "c_custkey", "party", C.seat(F.col("state"), F.col("district")).alias("seat"), names.seat_number(F.col("district")).cast("long").alias("seat_number"), C.initials(F.col("name")).alias("initials"), names.is_bioguide(F.col("code")).alias("is_bioguide"),
        names.last_first(F.col("filed")).alias("called"), C.identity_line().alias("identity_line"), watch.admissible_ticker(F.col("asked")).alias("ticker"),
    )


@query(
    "contact_classes",
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'fresh' WHEN 3 THEN 'not_modified' WHEN 1 THEN 'served_from_cache' WHEN 5 THEN 'served_from_cache' ELSE 'failed' END AS outcome,
      CASE event_id % 7 WHEN 1 THEN 'too_large' WHEN 2 THEN 'undecodable' WHEN 4 THEN 'no_cache' WHEN 5 THEN 'offline' WHEN 6 THEN 'bad_status' END AS reason, event_id % 7 IN (0, 3) AS reached, event_id % 7 IN (1, 2, 4, 6) AS unexpected FROM events""",
    cte=False,
)
def _contacts(spark, d):
    k = F.col("event_id") % 7
    status = F.when(k <= 2, 200).when(k <= 4, 304).when(k == 6, 500)
    landed = testdata.read(spark, d, "events").select("event_id", status.alias("status"), F.when(k == 1, indexes.MOST_BYTES + 1).otherwise(10).alias("bytes"), (k != 2).alias("utf8_ok"), k.isin(1, 3, 5).alias("cache_hit"))
    return indexes.classify_contact(landed).select("event_id", "outcome", "reason", "reached", "unexpected")


query("index_year_window", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1996", cte=False)(
    lambda spark, d: indexes.year_window(testdata.read(spark, d, "orders").select("o_orderkey", F.year(F.to_date("o_orderdate")).cast("long").alias("year")), 1996)
)


@query(
    "refresh_summaries",
    """WITH o AS (SELECT event_id, a AS added, e, CASE WHEN a > 0 AND e % 4 > 0 THEN 'added' WHEN a > 0 THEN 'nothing_new' WHEN e % 13 = 1 THEN 'bad_answer' WHEN e % 11 = 2 AND (e % 5 = 1 OR e % 17 = 0) THEN 'unreachable'
      WHEN e % 4 = 0 THEN 'nothing_new' WHEN e % 3 > e % 2 THEN 'nothing_added' ELSE 'unreadable' END AS outcome
      FROM (SELECT event_id, event_id AS e, greatest(event_id % 6 - 2, 0) AS a FROM events))
    SELECT event_id, added, outcome, outcome || CASE WHEN outcome = 'added' THEN '; rows ' || added ELSE '' END || CASE WHEN outcome IN ('added', 'nothing_added') AND e % 3 > 0 THEN '; filings ' || e % 3 WHEN outcome = 'unreadable' THEN '; filings ' || e % 4 ELSE '' END
      || CASE WHEN outcome = 'added' AND e % 2 > 0 THEN '; on paper ' || e % 2 ELSE '' END || CASE WHEN outcome = 'added' AND e % 7 = 0 THEN '; more wait' ELSE '' END AS told FROM o""",
    cte=False,
)
def _refreshed(spark, d):
    e = F.col("event_id")
    runs = testdata.read(spark, d, "events").select(
        "event_id", F.greatest(e % 6 - 2, F.lit(0)).alias("added"), (e % 13 == 1).alias("unexpected"), (e % 11 != 2).alias("reached"), (e % 5 == 1).cast("int").alias("failed"), (e % 17 != 0).cast("int").alias("indexed"),
        (e % 4).alias("new_filings"), (e % 3).alias("downloaded"), (e % 2).alias("scanned"), (e % 7 == 0).alias("more_remaining"),
    )
    return runs.select("event_id", "added", refresh.outcome().alias("outcome"), refresh.told().alias("told"))


@query(
    "data_ages",
    """SELECT o_orderkey, CASE WHEN a < 0 THEN 'dated in the future' WHEN a = 0 THEN 'downloaded today' WHEN a = 1 THEN '1 day old' ELSE a || ' days old' END AS age,
      coalesce(CASE WHEN o_orderkey % 3 = 0 THEN a > 7 WHEN o_orderkey % 3 = 1 THEN a + 3 > 7 END, false) AS stale FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-06-30') AS a FROM orders)""",
    cte=False,
)
def _ages(spark, d):
    k, then, now = F.col("o_orderkey"), F.to_date("o_orderdate"), F.lit("1996-06-30").cast("date")
    last, made = F.when(k % 3 == 0, then), F.when(k % 3 < 2, F.date_sub(then, 3))
    return testdata.read(spark, d, "orders").select("o_orderkey", C.age_phrase(then, now).alias("age"), C.is_stale(last, made, now).alias("stale"))


_FOLLOWS = "follows(member_id) AS (VALUES ('C1'), ('C5'), ('C12'), ('X1'), ('X2'))"


def _follows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ("C1", "C5", "C12", "X1", "X2", "C5")], "member_id string")


query("followed_members", f"WITH {_FOLLOWS} SELECT m.id AS member_id, m.name, m.chamber FROM member m JOIN follows ON m.id = member_id")(lambda spark, d: watch.followed(_follows(spark), testdata.members(spark, d)))
query("followed_missing", f"WITH {_FOLLOWS} SELECT count(*) AS missing FROM follows WHERE member_id NOT IN (SELECT id FROM member)")(lambda spark, d: watch.missing(_follows(spark), testdata.members(spark, d)))
on_trades("seen_trimmed", "SELECT id AS row_id FROM feed ORDER BY id DESC LIMIT (SELECT CASE WHEN count(*) > 300 THEN 200 ELSE count(*) END FROM feed)")(lambda t: feed.trim_seen(t.select(F.col("id").alias("row_id")), 300, 200))
on_trades("seen_marked", "SELECT id AS row_id FROM feed WHERE is_amendment OR tx_type = 'exchange'")(lambda t: watch.mark_seen(t.filter("is_amendment").select(F.col("id").alias("row_id")), t.filter("tx_type = 'exchange'")))
on_trades("new_section", "SELECT id, row_number() OVER (ORDER BY disclosed_date DESC, id DESC) AS rank FROM feed WHERE NOT is_amendment QUALIFY rank <= 50")(lambda t: watch.new_section(t, t.filter("is_amendment").select(F.col("id").alias("row_id"))).select("id", "rank"))
query("widget_watchlist", f"WITH {_WATCH} SELECT id, row_number() OVER (ORDER BY disclosed_date DESC, id DESC) AS rank FROM feed WHERE symbol IN (SELECT upper(ticker) FROM tickers) OR member_id IN (SELECT member_id FROM follows) QUALIFY rank <= 5")(
    lambda spark, d: watch.widget(testdata.trades(spark, d), "watchlist", *_watched(spark)).select("id", "rank")
)
on_trades("copied_with_change", "SELECT id, CASE WHEN is_amendment THEN 'spouse' ELSE owner END AS owner, asset_type FROM feed")(
    lambda t: feed.changed(t.select("id", "owner", "asset_type"), t.filter("is_amendment").select("id", F.lit("spouse").alias("owner"), F.lit(None).cast("string").alias("asset_type")))
)
on_trades("feed_json", "SELECT id, CAST(tx_date AS VARCHAR) AS tx_date, asset, ticker, low_cents FROM feed")(
    lambda t: sinks.feed_json(t).select(*[F.get_json_object("value", f"$.{c}").cast(k).alias(c) for c, k in (("id", "string"), ("tx_date", "string"), ("asset", "string"), ("ticker", "string"), ("low_cents", "long"))])
)
on_trades("index_years", "SELECT string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) AS years FROM (SELECT DISTINCT year(disclosed_date) AS y FROM feed)")(lambda t: t.agg(F.array_join(F.sort_array(F.collect_set(F.year("disclosed_date"))), ",").alias("years")))


@query("member_ids", f"WITH {_PEOPLE} SELECT filing_id, CASE WHEN k % 4 = 0 THEN 'K' || k ELSE 'x-' || last || '-' || replace(first, ' ', '-') || '-n' END AS member_id FROM f JOIN p ON CAST(p.k AS VARCHAR) = f.filing_id".replace("last || '-' || replace(first", "f.last || '-' || replace(f.first"), cte=False)
def _member_ids(spark, d):
    x, filed = _people(spark, d)
    named = filed.withColumn("full_name", F.concat_ws(" ", "first", "last", "filing_id"))
    known = named.filter("cast(filing_id as bigint) % 4 = 0").select("full_name", F.concat(F.lit("K"), "filing_id").alias("member_id"))
    return identity.member_ids(named, known, filed.select("filing_id", F.lit(None).cast("string").alias("bioguide")))


@query(
    "members_attached",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'democrat' WHEN 1 THEN 'republican' ELSE 'unknown' END AS party, CASE WHEN c_custkey % 2 = 0 AND c_nationkey % 5 > 0 THEN n_name ELSE '' END AS committees FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    cte=False,
)
def _attached(spark, d):
    k, cust, nation = F.col("c_custkey"), testdata.read(spark, d, "customer"), testdata.read(spark, d, "nation")
    code = F.concat(F.lit("Z"), k.cast("string"))
    members = cust.select("c_custkey", code.alias("bioguide_id"))
    legislators = cust.filter(k % 3 < 2).select(code.alias("bioguide"), F.when(k % 3 == 0, "democrat").otherwise("republican").alias("party"))
    committees = nation.select(F.when(F.col("n_nationkey") % 5 > 0, F.concat(F.lit("T"), F.col("n_nationkey").cast("string"))).alias("thomas_id"), F.col("n_name").alias("name"))
    served = cust.select(F.concat(F.lit("T"), F.col("c_nationkey").cast("string")).alias("key"), F.when(k % 2 == 0, code).alias("bioguide"))
    below = served.withColumn("key", F.concat("key", F.lit("01")))  # subcommittees have no record of their own
    return identity.attach(members, legislators, indexes.roster(committees, served.unionByName(below))).select("c_custkey", "party", F.array_join("committees", ",").alias("committees"))


# More sources ---------------------------------------------------------------------------------------


def _us(date: Column) -> Column:
    return F.date_format(date, "MM/dd/yyyy")


@query(
    "senate_index",
    """SELECT 'Jo' AS first, 'Mem' || c_custkey AS last, 'Mem' || c_custkey || ', Jo (Senator)' AS display, CASE c_custkey % 3 WHEN 0 THEN 'ptr' ELSE 'paper' END AS kind, '0000abcd-0000-0000-0000-' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS filing_id, c_custkey % 5 = 0 AS is_amendment,
      DATE '2001-01-01' + CAST(c_custkey % 365 AS INTEGER) AS filed_on FROM customer WHERE c_custkey % 3 < 2""",
    cte=False,
)
def _senate_index(spark, d):
    k, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    kind = F.when(k % 3 == 0, "ptr").when(k % 3 == 1, "paper").otherwise("annual")
    link = F.concat(F.lit('<a href="/search/view/'), kind, F.lit("/0000ABCD-0000-0000-0000-"), F.lpad(key, 12, "0"), F.lit('/">Report'), F.when(k % 5 == 0, " (Amendment 1)").otherwise(""), F.lit("</a>"))
    row = F.array(F.lit(" Jo "), F.concat(F.lit("Mem"), key), F.concat(F.lit("Mem"), key, F.lit(", Jo (Senator)")), link, _us(F.date_add(F.lit("2001-01-01").cast("date"), (k % 365).cast("int"))))
    pages = testdata.read(spark, d, "customer").groupBy(F.floor(k / 100)).agg(F.collect_list(row).alias("data"))
    return indexes.senate_index(pages.select(F.to_json(F.struct(F.lit(1).alias("draw"), "data")).alias("value")))


@query(
    "senate_report",
    """WITH r AS (SELECT l_orderkey, l_partkey AS p, CAST(l_shipdate AS DATE) AS told, CAST(o_orderdate AS DATE) AS tx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nth FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT CAST(l_orderkey AS VARCHAR) AS filing_id, nth - 1 AS position, told AS tx_date, tx AS disclosed_date, CASE p % 4 WHEN 0 THEN 'spouse' WHEN 1 THEN 'joint' WHEN 2 THEN 'dependent' ELSE 'self' END AS owner, CASE WHEN p % 3 > 0 THEN 'TK' END AS ticker, 'Firm & ' || p AS asset,
      CASE p % 5 WHEN 0 THEN 'ST' WHEN 1 THEN 'OP' WHEN 2 THEN 'GS' WHEN 3 THEN 'CT' ELSE 'PS' END AS asset_type, CASE p % 4 WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' WHEN 2 THEN 'partial_sell' ELSE 'exchange' END AS tx_type, '$1,001 - $15,000' AS amount_text, CASE WHEN p % 2 = 0 THEN 'Note ' || p END AS filing_description FROM r""",
    cte=False,
)
def _senate_report(spark, d):
    p, key = F.col("l_partkey"), F.col("l_partkey").cast("string")
    cells = [
        F.lit("1"), _us(F.to_date("l_shipdate")), F.when(p % 4 == 0, "Spouse").when(p % 4 == 1, "Joint").when(p % 4 == 2, "Child").otherwise("Self"), F.when(p % 3 > 0, '<a href="#">TK</a>').otherwise("--"), F.concat(F.lit("Firm &amp;\n "), key, F.lit("<br>Company: x")),
        F.when(p % 5 == 0, "Stock").when(p % 5 == 1, "Stock Option").when(p % 5 == 2, "Municipal Security").when(p % 5 == 3, "Cryptocurrency").otherwise("Non-Public Stock"),
        F.when(p % 4 == 0, "Purchase").when(p % 4 == 1, "Sale (Full)").when(p % 4 == 2, "Sale (Partial)").otherwise("Exchange"), F.lit("$1,001 - $15,000"), F.when(p % 2 == 0, F.concat(F.lit("Note&nbsp;"), key)).otherwise("--"),
    ]
    tr = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    line, orders = testdata.read(spark, d, "lineitem"), testdata.read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("filed_on"))
    rows = line.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", tr.alias("tr")))), lambda x: x["tr"]), "\n").alias("body"))
    html = F.concat(F.lit('<table class="table table-striped"><thead><tr><th>#</th></tr></thead><tbody>'), "body", F.lit("</tbody></table>"))
    pages = rows.join(orders, rows.l_orderkey == orders.o_orderkey).select(F.col("l_orderkey").cast("string").alias("filing_id"), html.alias("html"), "filed_on")
    return indexes.senate_report(pages).drop("warning")


@query("paper_images", "SELECT CAST(c_custkey AS VARCHAR) AS filing_id, CAST(i AS BIGINT) AS position, '/media/' || c_custkey || '?p=1&n=' || i AS url FROM customer, range(2) t(i)", cte=False)
def _paper(spark, d):
    key = F.col("c_custkey").cast("string")
    image = lambda i: F.concat(F.lit("<IMG class='x filingImage' src='/media/"), key, F.lit(f"?p=1&amp;n={i}'>"))
    pages = testdata.read(spark, d, "customer").select(key.alias("filing_id"), F.concat(F.lit("<img src='/logo.png'>"), image(0), image(1), image(0)).alias("html"))
    return indexes.paper_images(pages).select("filing_id", F.col("position").cast("long"), "url")


@query(
    "link_index",
    """WITH l AS (SELECT '/f?a=1&b=' || n_nationkey || '.pdf' AS url, 'Quill ' || n_name || ' 1.' || n_nationkey + 1 || '.24' || CASE WHEN n_nationkey % 4 = 0 THEN ' amended' ELSE '' END AS text, DATE '2024-01-01' + CAST(n_nationkey AS INTEGER) AS dated, n_nationkey % 4 = 0 AS is_amendment FROM nation WHERE n_nationkey % 2 = 0)
    SELECT *, row_number() OVER (ORDER BY dated DESC) AS rank FROM l""",
    cte=False,
)
def _links(spark, d):
    k = F.col("n_nationkey")
    a = F.concat(F.lit('<a class="x" href="/f?a=1&amp;b='), k.cast("string"), F.lit('.pdf"><b>'), F.when(k % 2 == 0, "Quill ").otherwise("Reed "), "n_name", F.lit("</b> 1."), (k + 1).cast("string"), F.lit(".24"), F.when(k % 4 == 0, " amended").otherwise(""), F.lit("</a>"))
    page = testdata.read(spark, d, "nation").agg(F.array_join(F.collect_list(a), "\n").alias("html"))  # 25 nations
    return indexes.link_index(page, "quill")


@query(
    "cabinet_index",
    """SELECT 'OGE Form' AS kind, 'Jo Doe' || s_suppkey AS name, 'Department of Energy' AS agency, CASE s_suppkey % 4 WHEN 0 THEN 'Secretary' ELSE 'Attorney General' END AS title, DATE '2020-01-01' + CAST(s_suppkey % 300 AS INTEGER) AS filed_on, '/o/' || s_suppkey || '.pdf' AS url FROM supplier WHERE s_suppkey % 4 < 2 AND s_suppkey % 3 = 0""",
    cte=False,
)
def _cabinet(spark, d):
    k, key = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    record = F.struct(
        F.concat(F.lit("<a href='/o/"), key, F.when(k % 9 == 9, ".doc").otherwise(".pdf"), F.lit("'>OGE&nbsp;Form</a>")).alias("type"), F.concat(F.lit("Doe"), key, F.lit(", Jo")).alias("name"), F.when(k % 3 == 0, "Department of Energy").when(k % 3 == 1, "Department of Puzzles").otherwise("Energy Board").alias("agency"),
        F.when(k % 4 == 0, "Secretary").when(k % 4 == 1, "Attorney General").when(k % 4 == 2, "Deputy Secretary").otherwise("Clerk").alias("title"), F.concat(F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd"), F.lit("T00:00:00")).alias("docDate"),
    )
    pages = testdata.read(spark, d, "supplier").groupBy(F.floor(k / 100)).agg(F.collect_list(record).alias("data"))
    return indexes.cabinet(indexes.agency_index(pages.select(F.to_json(F.struct("data")).alias("value"))))


@query(
    "crosswalk_seats",
    """SELECT 'Z' || c_custkey AS bioguide, 'Doe' || c_custkey AS last, 'Robert' AS first, CASE c_custkey % 3 WHEN 0 THEN 'Bob' WHEN 1 THEN 'Rob' END AS nickname, 'ST' AS state, chamber, district, CAST(2000 + c_custkey % 20 AS BIGINT) AS last_term_end_year, CASE WHEN c_custkey % 2 = 0 THEN 'democrat' ELSE 'independent' END AS party
      FROM customer, (VALUES ('house', 1::BIGINT), ('senate', NULL)) t(chamber, district)""",
    cte=False,
)
def _crosswalk(spark, d):
    k, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    term = lambda kind, district, end, party: F.struct(F.lit(kind).alias("type"), F.lit("ST").alias("state"), F.lit(district).cast("int").alias("district"), F.concat(end.cast("string"), F.lit("-01-03")).alias("end"), party.alias("party"))
    person = F.struct(
        F.struct(F.concat(F.lit("Z"), key).alias("bioguide")).alias("id"),
        F.struct(F.lit("Robert").alias("first"), F.concat(F.lit("Doe"), key).alias("last"), F.when(k % 3 == 0, "Bob").alias("nickname"), F.concat(F.when(k % 3 == 1, "Rob").otherwise("Robert"), F.lit(" Doe")).alias("official_full")).alias("name"),
        F.array(term("rep", 1, F.lit(1990), F.lit("Republican")), term("rep", 1, F.lit(1992), F.lit("Republican")), term("sen", None, 2000 + k % 20, F.when(k % 2 == 0, "Democrat").otherwise("Other"))).alias("terms"),
    )
    files = testdata.read(spark, d, "customer").groupBy(F.floor(k / 100)).agg(F.collect_list(person).alias("people"))
    seats = indexes.crosswalk(files.select(F.to_json("people").alias("value")))
    return seats.withColumns({c: F.col(c).cast("long") for c in ("district", "last_term_end_year")})


query("newest_feed", "SELECT 2 AS schema_version, max(CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '#' || o_orderkey) AS generated_at FROM orders WHERE o_orderkey % 3 = 2", cte=False)(
    lambda spark, d: indexes.newest_feed(testdata.read(spark, d, "orders").select((F.col("o_orderkey") % 3).alias("schemaVersion"), F.concat(F.date_format(F.to_date("o_orderdate"), "yyyy-MM-dd"), F.lit("#"), F.col("o_orderkey").cast("string")).alias("generatedAt"))).select(F.col("schemaVersion").cast("int").alias("schema_version"), F.col("generatedAt").alias("generated_at"))
)


@query("ocr_lines", "SELECT c_custkey AS filing_id, page, CAST(n AS BIGINT) AS line_no, 'w' || n || 'a  w' || n || 'b  w' || n || 'c' AS line FROM customer, range(1, 3) p(page), range(4) l(n)", cte=False)
def _ocr(spark, d):
    """Three fragments a line, each a little lower than the one before, in a random order."""
    page, n, i = (F.explode(F.sequence(F.lit(lo), F.lit(hi))) for lo, hi in ((1, 2), (0, 3), (0, 2)))
    f = testdata.read(spark, d, "customer").select("c_custkey", page.alias("page")).select("*", n.alias("n")).select("*", i.alias("i"))
    fragments = f.select(F.col("c_custkey").alias("filing_id"), F.col("page").cast("long").alias("page"), (F.col("i") * 0.25).cast("double").alias("min_x"), (0.9 - F.col("n") * 0.05 - F.col("i") * 0.002).cast("double").alias("mid_y"), F.concat(F.lit("w"), F.col("n").cast("string"), F.char(F.lit(97) + F.col("i"))).alias("text"))
    return indexes.ocr_lines(fragments).withColumn("line_no", F.col("line_no").cast("long"))


from quaystone.plans import forms, stateful  # noqa: E402, F401  (they register their queries)

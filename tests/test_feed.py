"""Identity, watching, increments, sinks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quaystone.functions import columns as C
from quaystone.operators import feed, identity, rules, stats, watch
from quaystone.plans import sinks
from quaystone.sources import testdata
from quaystone.streaming import refresh

COLUMNS = "id string, filing_id string, member_id string, member_name string, owner string, asset string, ticker string, asset_type string, tx_type string, tx_date date, disclosed_date date, amount_kind string, low_cents bigint, high_cents bigint, is_amendment boolean, warning string"


def trade(id, member="m1", ticker="AA", kind="ST", tx="2025-01-01", told="2025-01-20", low=100_100, high=1_500_000, owner="self", amended=False, tx_type="buy"):
    return (id, f"f{id}", member, f"Name {member}", owner, f"{ticker} Corp", ticker, kind, tx_type, dt.date.fromisoformat(tx), dt.date.fromisoformat(told), "range", low, high, amended, None)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMNS)


def test_lag_facts(spark):
    lags = [1, 5, 10, 20, 40, 45, 46, 60, 100]
    rows = [trade(str(i), tx=str(dt.date(2025, 1, 1)), told=str(dt.date(2025, 1, 1) + dt.timedelta(days=x))) for i, x in enumerate([*lags, -3])]
    r = stats.lag_stats(frame(spark, *rows)).first()
    assert (r.n, r.median_days, r.mean_days, r.over_45, r.percent_over_45) == (9, 40, 36, 3, 33)
    assert [x.n for x in stats.lag_buckets(frame(spark, *rows)).orderBy("position").collect()] == [2, 2, 2, 2, 1]
    none = stats.lag_stats(frame(spark, *rows).limit(0)).first()
    assert (none.n, none.median_days, none.percent_over_45) == (0, 0, 0)


def test_cluster(spark):
    days = ["2025-03-01", "2025-03-04", "2025-03-07", "2025-03-27"]
    (r,) = rules.ticker_cluster(frame(spark, *[trade(str(i), member=f"m{i}", told=d) for i, d in enumerate(days)])).collect()
    assert (r.members, r.span_days, r.id) == (3, 6, "2")
    assert rules.ticker_cluster(frame(spark, *[trade(str(i), member="m1", told=d) for i, d in enumerate(days)])).isEmpty()


def test_filed_late(spark):
    rows = [trade("a", "m1", told="2025-05-01"), trade("b", "m2", told="2025-03-22"), trade("c", "m3", told="2025-02-16"), trade("d", "m4", told="2024-02-16"), trade("e", "m5", told="2025-02-15"), trade("f", "m6", told="2029-02-15")]
    assert {r.id: r.lag_days for r in rules.filed_late(frame(spark, *rows)).collect()} == {"a": 120, "b": 80, "c": 46}


def test_volume_trend_rounds_as_its_sql_does(spark):
    told = ["2025-04-28", "2025-05-01", *[f"2025-06-{d}" for d in range(24, 31)]]
    (r,) = rules.member_volume_trend(frame(spark, *[trade(str(i), told=d) for i, d in enumerate(told)])).collect()
    assert (r.id, r.recent, r.multiple) == ("8", 7, 3.9)  # 7 / (2 / 33 * 30) is 3.8499999999999996, ten times that 38.5


def test_headline_fallbacks(spark):
    assert rules.headline(frame(spark, trade("a")).limit(0)).isEmpty()
    r = rules.headline(frame(spark, trade("a"))).first()
    assert (r.lead, r.lead_n, r.supporting) == ("snapshot", 1, None)
    r = rules.headline(frame(spark, trade("a", low=500_000_100))).first()
    assert (r.lead, r.lead_n) == ("largest_bracket", 500_000_100)


def test_merge_and_dedupe(spark):
    seed, new = frame(spark, trade("a"), trade("b", kind="OP")), frame(spark, trade("z"), trade("c", low=5))
    assert {(r.id, r.origin) for r in feed.merge(seed, new).collect()} == {("a", "seed"), ("b", "seed"), ("c", "new")}
    rows = frame(spark, trade("a"), trade("b", low=7, amended=True), trade("c", tx="2025-01-02"))
    assert {r.id for r in feed.possible_duplicate_amendments(rows).collect()} == {"a", "b"}


@pytest.mark.parametrize(("query", "want"), [("ann lee", "1"), ("bo", "3"), ("ann", None), ("lee", None), ("zed", "3"), ("nobody", None)])
def test_name_match(spark, query, want):
    members = spark.createDataFrame([("1", "Ann Lee"), ("2", "Ann Leeson"), ("3", "Bo Zed")], "id string, name string")
    assert ([r.id for r in feed.name_match(members, query).collect()] or [None])[0] == want


def test_resolve(spark):
    cross = [("A1", "Núñez", "José", "Pepe", "CA", "house", 1), ("B1", "Smith", "John", None, "TX", "house", 1), ("B2", "Smith", "John", None, "TX", "house", 2), ("C1", "Van Hollen", "Chris", None, "MD", "senate", None)]
    crosswalk = spark.createDataFrame([(*r, 9999, "x") for r in cross], "bioguide string, last string, first string, nickname string, state string, chamber string, district int, last_term_end_year int, party string")
    rows = [("1", "Nunez Jr.", "Jose", "CA", "01"), ("2", "Smith", "John", "TX", "02"), ("3", "Smith", "John", "TX", "09"), ("4", "Hollen", "Chris Van", "MD", ""), ("5", "Nunez", "Pepe", "CA", "1"), ("6", "Doe", "X", "CA", "1"), ("7", "Smith", "Zoe", "TX", "1"), ("8", "VanHollen", "Chris", "MD", None)]
    got = {r.filing_id: (r.bioguide, r.resolution) for r in identity.resolve(spark.createDataFrame(rows, "filing_id string, last string, first string, state string, district string"), crosswalk).collect()}
    # A suffix belongs to the surname here; a surname alone may be settled by the seat.
    assert got["1"] == (None, "not_found") and got["2"] == ("B2", "matched") and got["3"] == (None, "ambiguous") and got["5"] == ("A1", "matched")
    assert got["6"] == (None, "not_found") and got["7"] == ("B1", "matched") and got["8"] == ("C1", "matched")


def test_watch(spark):
    t = frame(spark, trade("a"), trade("b", member="m2", ticker=None), trade("c", member="m3", ticker="ZZ"))
    w, f = spark.createDataFrame([("aa",)], "ticker string"), spark.createDataFrame([("m2",)], "member_id string")
    assert {r.id for r in feed.relevant(t, w, f).collect()} == {"a", "b"}
    assert feed.relevant(t, w.limit(0), f.limit(0)).isEmpty()
    seen = spark.createDataFrame([("a",)], "row_id string")
    assert [r.id for r in feed.unseen(t, w, f, seen).collect()] == ["b"]
    assert {r.row_id for r in watch.first_watch(t, seen, False).collect()} == {"a", "b", "c"}
    one = watch.alert(t.filter("id = 'a'")).first()
    assert (one.n, one.member_name, one.tx_type, one.symbol) == (1, "Name m1", "buy", "AA") and watch.alert(t).first().member_name is None
    assert feed.active_facets(types={"buy"}, owners=set(), search="x", late_only=False) == 2
    assert feed.by_ticker(t, " ").isEmpty() and feed.by_ticker(t, "aa ").count() == t.filter("ticker = 'AA'").count()
    assert watch.alert(t).first().names == "AA, ZZ" and watch.alert(t.limit(0)).isEmpty()
    assert [r.id for r in watch.widget(t, "watchlist", w.limit(0), f.limit(0)).collect()] == ["c", "b", "a"]


def test_refresh_is_incremental(spark, tmp_path):
    landing, table, point = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "point")
    frame(spark, trade("a"), trade("b", low=3)).coalesce(1).write.mode("append").parquet(landing)
    schema = frame(spark, trade("a")).schema
    refresh.refresh(spark, landing, schema, table, point).awaitTermination()
    frame(spark, trade("late", tx="2001-01-01", told="2001-01-05"), trade("same")).coalesce(1).write.mode("append").parquet(landing)
    refresh.refresh(spark, landing, schema, table, point).awaitTermination()
    assert {r.id for r in refresh.feed_table(spark, table, schema).collect()} == {"a", "b", "late"}
    refresh.merge_batch(frame(spark, trade("late", tx="2001-01-01", told="2001-01-05")), 1, table)  # a batch that runs again
    assert {r.id for r in refresh.feed_table(spark, table, schema).collect()} == {"a", "b", "late"}


def test_sinks(spark, tmp_path):
    t = frame(spark, trade("a"))
    sinks.write_tables({"trades": t}, str(tmp_path / "feed"))
    assert sinks.read_tables(spark, str(tmp_path / "feed"), "trades").count() == 1
    with pytest.raises(sinks.EmptyFeed):
        sinks.write_tables({"trades": t.limit(0)}, str(tmp_path / "feed"))
    members = spark.createDataFrame([("m1", "senate", "democrat")], "id string, chamber string, party string")
    feed.write_csv(feed.csv_projection(t.withColumn("asset", F.lit('a "b", c')), members).coalesce(1), str(tmp_path / "csv"))
    head, row = (next((tmp_path / "csv").glob("part-*")).read_text()).strip().split("\n")
    assert head.count(",") == 18 and '"a ""b"", c"' in row


def test_labels_of_all_kinds(spark):
    rows = spark.createDataFrame([("range", 100_100, 1_500_000), ("atLeast", 5_000_000_100, 5_000_000_100), ("exact", 1_550, 1_550), ("none", 0, 0), ("unknown", 0, 0), (None, 0, 0)], "amount_kind string, low_cents long, high_cents long")
    got = [tuple(r) for r in rows.select(C.amount_headline(), C.amount_caption(), C.amount_spoken()).collect()]
    assert got[0] == ("$1,001 – $15,000", "two bounds", "from $1,001 up to $15,000")
    assert got[1] == ("≥ $50,000,001", "lower bound only", "$50,000,001 or more")
    assert got[2] == ("$15.50", "one figure", "$15.50 exactly")
    assert got[3] == ("no amount", "under the threshold", "nothing above the threshold")
    assert got[4] == got[5] == ("?", "no figure read", "an amount that was not read")


def test_only_capital_codes_go_from_assets(spark):
    names = ["Acme (AC.B) [ST]", "Acme (Class-A/B) [ST]", "Acme [OP]", "Acme [st]", "Acme (ABCDEFGH) [ST]"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in names], "asset string").select(C.clean_asset()).collect()]
    assert got == ["Acme", "Acme (Class-A/B)", "Acme", "Acme [st]", "Acme (ABCDEFGH)"]


def test_changed(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("c", 3, "z")], "id string, n int, s string")
    new = spark.createDataFrame([("a", 9, None), ("b", None, "y")], "id string, n int, s string")
    assert sorted(tuple(r) for r in feed.changed(rows, new).collect()) == [("a", 9, "x"), ("b", 2, "y"), ("c", 3, "z")]


def test_follows(spark):
    members = spark.createDataFrame([("1", "Zoe", "house"), ("2", "Ann", "senate")], "id string, name string, chamber string")
    follows = spark.createDataFrame([("1",), ("2",), ("9",), ("9",)], "member_id string")
    assert [r.member_id for r in watch.followed(follows, members).collect()] == ["2", "1"]
    assert watch.missing(follows, members).first().missing == 1


def test_refresh_tells_its_counts(spark):
    cols = "added long, new_filings long, downloaded long, scanned long, failed long, indexed long, reached boolean, unexpected boolean, more_remaining boolean"
    runs = [(3, 2, 2, 1, 0, 9, True, False, True), (0, 2, 2, 1, 0, 9, True, False, True), (0, 2, 1, 1, 0, 9, True, False, False), (0, 0, 0, 0, 0, 9, True, False, False), (0, 2, 0, 0, 1, 0, False, False, False)]
    assert [r.told for r in spark.createDataFrame(runs, cols).select(refresh.told().alias("told")).collect()] == ["added; rows 3; filings 2; on paper 1; more wait", "nothing_added; filings 2", "unreadable; filings 2", "nothing_new", "unreachable"]


def test_lines_meet_their_parts_before_orders(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = testdata.trades(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for key in ("l_partkey", "o_custkey"):
        assert "Join" not in plan.split(f"hashpartitioning({key}")[1].split("FileScan")[0]

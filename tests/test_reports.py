"""Report grammars, amounts, ids."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quaystone.functions import amounts, ids
from quaystone.sources import indexes, reports

HEAD = "ID Owner Asset Transaction\nType Date\n$200?\n"
FILING = "filing_id string, member_id string, form string, filed_on date, text string, recovered_by_ocr boolean"


@pytest.fixture
def read(spark):
    """Texts of one form -> rows of each text, in order."""

    def run(form, *texts, filed=None):
        filings = spark.createDataFrame([(f"f{i}", "m", form, filed, t, False) for i, t in enumerate(texts)], FILING)
        found = [[] for _ in texts]
        for r in sorted(reports.parse_reports(filings).collect(), key=lambda r: r.position):
            found[int(r.filing_id[1:])].append(r)
        return found

    return run


def test_house_rows(read):
    """Rows, wrapped figures, page breaks, labels and owners, each in a filing of its own."""
    bodies = [
        "SP Apple Inc. (AAPL) [ST] P 01/02/2025 01/10/2025 $1,001 -\n$15,000",
        "A (AA) [ST] P 01/02/2025 01/10/2025 $1,001 -\nB (BB) [ST] S 01/02/2025 01/10/2025",
        "A (AA) [ST] P 01/02/2025 01/10/2025 Over\n$1,000,000",
        "Long name of a\nfund P 01/02/2025 01/10/2025 $1,001 -\nID Owner Asset\n$200?\n$15,000 company (LONG) [ST]",
        "JT\nOne Corp (ONE) P 01/02/2025 01/10/2025 $1,001 - $15,000\n[OP]\nF      S     : Amended\nD          : Bought ten\ncalls.\n1234567 Two (TWO) [ST] S (partial) 1/2/25 1/9/25 $15.00",
        "",
        "* For the complete list\nA (AA) [ST] P 01/02/2025 01/10/2025 $1,001 - $15,000",
        "A (AA) [ST] P 01/02/2025 01/10/2025 $1,001 -\n$900 rest of\nthe next (NX) [ST] S 1/2/25 1/9/25 junk\nPart above\nD   : says so!\nDC SP Third [MF] Fourth (FOUR) [ST] E 1/2/25 1/9/25 $5.00\nx (X) [ST] P 13/45/2025 1/9/25 $5.00\nD   : late",
    ]
    got = read("house", *[HEAD + b for b in bodies], "A (AA) [ST] P 01/02/2025 01/10/2025 $1,001 - $15,000", None)
    (row,) = got[0]
    assert (row.owner, row.ticker, row.asset_type, row.tx_type) == ("spouse", "AAPL", "ST", "buy")
    assert (row.amount_kind, row.low_cents, row.high_cents, row.warnings) == ("range", 100_100, 1_500_000, [])
    first, second = got[1]
    assert first.warnings == ["upper bound of the range not found"] and not second.warnings
    assert [(r.amount_kind, r.low_cents, r.high_cents) for r in got[2]] == [("atLeast", 100_000_000, 100_000_000)]
    assert [(r.asset, r.ticker, r.asset_type, r.high_cents) for r in got[3]] == [("Long name of a fund company (LONG) [ST]", "LONG", "ST", 1_500_000)]
    assert [(r.owner, r.asset_type, r.is_amendment, r.filing_description) for r in got[4]] == [("joint", "OP", True, "Bought ten calls."), ("self", "ST", False, None)]
    last = got[4][1]
    assert (last.asset, last.tx_type, last.amount_kind, last.low_cents) == ("Two (TWO) [ST]", "partial_sell", "exact", 1500)
    assert got[5] == got[6] == got[8] == got[9] == []
    a, b, c = got[7]
    assert a.warnings == ["ignored an upper bound that is not above the lower"] and a.high_cents == 100_100
    assert (b.asset, b.warnings, b.filing_description) == ("rest of the next (NX) [ST]", ["amount not understood: junk"], "says so!")
    assert (c.asset, c.tx_type, c.owner, c.position) == ("Fourth (FOUR) [ST]", "exchange", "self", 2) and c.filing_description.startswith("Part above")


def test_filed_date_and_impossible_day(read):
    ((row,),) = read("house", HEAD + "A (AA) [ST] E 02/30/2025 03/10/2025 junk", filed=dt.date(2025, 4, 1))
    assert (row.tx_date, row.disclosed_date, row.amount_kind) == (dt.date(2025, 3, 2), dt.date(2025, 4, 1), "unknown")
    assert row.warnings


def test_scan(spark, read):
    texts = ["OGE Received: 4/23/2026\n12 RIVERTON PORT\nOR REV purchase 1/5/2026 No S1,001 - S15.000\n13 X sale 514/26 Yes $1 -\n14 Y sale 9951/26 No $5", "a purchase 1/5/2026 No $5", "Date: 2024.02.11 09:05\na\nb\nc\nd\ne\nz purchase 1/5/2026 No $5"]
    got = read("scan", *texts)
    assert [(r.asset, r.tx_type, r.tx_date, r.amount_kind) for r in got[0]] == [("RIVERTON PORT OR REV", "buy", dt.date(2026, 1, 5), "range"), ("X", "sell", dt.date(2026, 5, 14), "range")]
    assert got[0][0].high_cents == 1_500_000 and got[0][1].warnings == ["amount goes on past its line"] and got[1] == []
    assert (got[2][0].asset, got[2][0].disclosed_date) == ("z", dt.date(2024, 2, 11))
    filings = spark.createDataFrame([(f"f{i}", "m", "scan", None, t, False) for i, t in enumerate(texts)] + [("f9", "m", "house", None, HEAD + "x P 13/45/2025 1/9/25 $5.00", False)], FILING)
    assert sorted((r.filing_id, r.warning) for r in reports.report_warnings(filings).collect()) == [
        ("f0", "date not understood: 9951/26"), ("f1", "no received date: rows skipped"), ("f2", "5 lines without a row discarded"), ("f2", "dated by the certifying signature, for want of a received date"), ("f9", "a row's dates could not be read"),
    ]


def test_native(read):
    (rows,) = read("native", "1 A Fund purchase 1/5/2026 No $1,001 -\n$15,000\n1 again sale 1/5/2026 No $5\n2 B sale 1/6/2026 Yes $50,001 - $100,000\n3 C sale 1/6/2026 $5", filed=dt.date(2026, 2, 1))
    assert [(r.asset, r.low_cents, r.high_cents) for r in rows] == [("A Fund", 100_100, 1_500_000), ("B", 5_000_100, 10_000_000)]


def test_parse_reports(spark):
    text = HEAD + "A (AA) [ST] P 01/02/2025 01/10/2025 $1,001 - $15,000"
    filings = spark.createDataFrame([("f1", "m", "house", None, text, True), ("f2", "m", "house", None, None, False), ("f3", "m", "scan", dt.date(2025, 1, 1), "1 a sale 1/5/2025 No $5", False)], FILING)
    rows = reports.parse_reports(filings)
    assert sorted((r.filing_id, r.asset, tuple(r.warnings)) for r in rows.collect()) == [("f1", "A (AA) [ST]", ("recovered by OCR",)), ("f3", "a", ())]
    assert {(r.filing_id, r.status) for r in reports.filing_status(filings, rows).collect()} == {("f1", "parsed"), ("f2", "without_text"), ("f3", "parsed")}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("$1,001 - $15,000", ("range", 100_100, 1_500_000, None)), ("$7,340,021 +", ("atLeast", 734_002_100, 734_002_100, None)), ("their share: Over $82,500", ("atLeast", 8_250_000, 8_250_000, None)),
        ("Over", ("unknown", 0, 0, "threshold")), ("$15.07", ("exact", 1507, 1507, None)), ("None (or less than $201)", ("none", 0, 0, None)), ("$50,001 -", ("range", 5_000_100, 5_000_100, "upper")), ("", ("unknown", 0, 0, None)), ("junk", ("unknown", 0, 0, None)), ("junk $5", ("unknown", 0, 0, None)), ("noneX $5", ("none", 0, 0, None)), ("$15,000 - $1,001", ("range", 1_500_000, 100_100, None)), (None, ("unknown", 0, 0, None)),
    ],
)
def test_amount_column(spark, text, want):
    a = spark.createDataFrame([(text,)], "t string").select(amounts.parse(F.col("t")).alias("a")).first().a
    assert (a.kind, a.low_cents, a.high_cents, a.pending) == want


def test_fnv(spark):
    def plain(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
        return f"{h:016x}"

    texts = ["", "a", "foobar", "Núñez – 東京", "x" * 200]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ids.fnv1a64(F.col("t")).alias("h")).collect()
    assert all(r.h == plain(r.t) for r in got)


def test_clerk_index(spark):
    lines = ["﻿Prefix\tLast\tFirst\tSuffix\tFilingType\tStateDst\tYear\tFilingDate\tDocID", "Hon.\tDoe\tJane\tJr\tP\tCA12\t2025\t1/31/2025\t2001\r", "\tRoe\tRic\t\tX\tTX00\tbad\t13/1/2025\t2002", "too\tfew", ""]
    rows = {r.filing_id: r for r in indexes.clerk_index(spark.createDataFrame([(x,) for x in lines], "value string"), 2024).collect()}
    assert set(rows) == {"2001", "2002"}
    assert (rows["2001"].full_name, rows["2001"].state, rows["2001"].district, rows["2001"].is_ptr, rows["2001"].filed_on) == ("Jane Doe Jr", "CA", "12", True, dt.date(2025, 1, 31))
    assert (rows["2002"].year, rows["2002"].filed_on) == (2024, None)


def test_senate_report_and_links(spark):
    cells = ["1", "01/05/2025", "Spouse", "-- <a>AB</a>", "Abc Corp <b>Company:</b> x Description: ten", "Stock Option", "Sale (Partial)", "$1,001 - $15,000", "--"]
    html = '<table class="table table-striped"><tbody><tr>' + "".join(f"<td>{c}</td>" for c in cells) + "</tr><tr><td>short</td></tr></tbody></table>"
    (r,) = indexes.senate_report(spark.createDataFrame([("f", html, None)], "filing_id string, html string, filed_on date")).collect()
    assert (r.owner, r.ticker, r.asset, r.asset_type, r.tx_type, r.filing_description) == ("spouse", "AB", "Abc Corp", "OP", "partial_sell", "ten")
    page = '<a href="/a.pdf">Doe 278T 01.02.25</a><a href="/a.pdf">Doe again</a><a href="/b.pdf">Doe Amended</a><a href="/c.pdf">Roe 1.1.25</a>'
    rows = indexes.link_index(spark.createDataFrame([(page,)], "html string"), "doe").orderBy("rank").collect()
    assert [(x.url, x.dated, x.is_amendment) for x in rows] == [("/a.pdf", dt.date(2025, 1, 2), False), ("/b.pdf", None, True)]


def test_ocr_lines(spark):
    f = [("f", 1, 0.5, 0.900, "b"), ("f", 1, 0.1, 0.895, "a"), ("f", 1, 0.1, 0.888, "c"), ("f", 2, 0.1, 0.5, "d")]
    rows = indexes.ocr_lines(spark.createDataFrame(f, "filing_id string, page int, min_x double, mid_y double, text string")).orderBy("page", "line_no").collect()
    assert [r.line for r in rows] == ["a  b", "c", "d"]


@pytest.mark.parametrize("form", ["house", "scan", "native"])
def test_filings_are_read_once_and_lines_exchanged_once(spark, form):
    filings = spark.createDataFrame([("f1", None, "a\nb")], "filing_id string, filed_on date, text string")
    plan = reports.READERS[form](filings)._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("ExistingRDD"), plan.count("Exchange hashpartitioning")) == (1, 1)


def test_native_lines_stay_in_their_text(spark, read):
    """Only rows leave their text, without Python; words are told apart as before: white space, colons, dollar signs, marks, lost slashes."""
    texts = [
        "1 A\u00a0Fund (Sale): 1/5/2026 *No* $1,001 –\r\n $15,000\r0 B sale 1/5/2026 No $5\r0003 C:D PURCHASE, 1/6/2026 yes$5.50\n4\tE exchange 1/6/2026 No x:y$7",
        "1 sale 1/5/2026 No $5\n2 A sale 115/2026 No $5 sale 1/5/2026 No $5\n3 B sale 1/5/2026 No\n12345 C sale 1/5/2026 No $5\n4 D sale 13/5/2026 No $5\n5 E resale sale 1/5/2026 No $5 -\n",
    ]
    got = read("native", *texts, filed=dt.date(2026, 2, 1))
    assert [(r.asset, r.tx_type, r.amount_kind, r.low_cents, r.high_cents) for r in got[0]] == [("A Fund", "sell", "range", 100_100, 1_500_000), ("C: D", "buy", "exact", 550, 550), ("E", "exchange", "unknown", 0, 0)]
    assert [(r.asset, r.position, r.warnings) for r in got[1]] == [("E resale", 0, ["amount goes on past its line"])]
    plan = reports.native_rows(spark.createDataFrame([("f1", None, "a")], "filing_id string, filed_on date, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "posexplode" not in plan


@pytest.mark.parametrize(("name", "exchanges", "windows"), [("house_report", 3, 9), ("native_form", 2, 2)])
def test_lines_go_through_few_windows_and_exchanges(spark, name, exchanges, windows):
    """Orders and lines are exchanged to meet, and after that only lines that Python has classified."""
    from quaystone.plans import catalogue, forms  # noqa: F401

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == exchanges and plan.count("+- Window [") <= windows

"""The batch build from indexes and texts of every source."""

import datetime as dt

from quaystone.operators import stats
from quaystone.plans import build
from quaystone.sources import indexes

HEAD = "ID Owner Asset Transaction\n$200?\n"


def test_build(spark):
    lines = ["P\tLast\tFirst\tSuffix\tT\tS\tY\tD\tDocID", "\tDoe\tJane\t\tP\tCA12\t2025\t1/31/2025\t2001", "\tRoe\tRic\t\tP\tTX01\t2025\t1/30/2025\t2002", "\tZed\tZoe\t\tA\tTX01\t2025\t1/30/2025\t2003"]
    index = indexes.clerk_index(spark.createDataFrame([(x,) for x in lines], "value string"), 2025)
    cross = spark.createDataFrame([("D000001", "Doe", "Jane", None, "CA", "house", 12, 9999, "Democrat")], "bioguide string, last string, first string, nickname string, state string, chamber string, district int, last_term_end_year int, party string")
    row = "Abc (ABC) [ST] P 01/02/2025 01/10/2025 $1,001 - $15,000\n"
    files = spark.createDataFrame([("2001", (HEAD + row * 2 + "Bad (BAD) [ST] P 13/45/2025 01/10/2025 $5\n").encode()), ("2002", b" ")], "filing_id string, content binary")
    texts = build.recover_text(files, extract=lambda b: bytes(b).decode(), recognise=lambda b: "")
    known = spark.createDataFrame([], "full_name string, member_id string")
    house = build.house(index, texts, cross, known)
    assert sorted((r.filing_id, r.member_id) for r in house.trades.collect()) == [("2001", "D000001")] * 2

    cells = ["1", "01/05/2025", "Self", "XY", "Xy Corp", "Stock", "Purchase", "$1,001 - $15,000", "--"]
    html = '<table class="table-striped"><tbody><tr>' + "".join(f"<td>{c}</td>" for c in cells) + "</tr><tr>" + "".join(f"<td>{c}</td>" for c in [cells[0], "soon", *cells[2:]]) + "</tr></tbody></table>"
    s_index = spark.createDataFrame([("s1", "ptr", False, dt.date(2025, 2, 1)), ("s2", "paper", False, None)], "filing_id string, kind string, is_amendment boolean, filed_on date")
    senate = build.senate(s_index, spark.createDataFrame([("s1", html)], "filing_id string, html string"), spark.createDataFrame([("s1", "S000001")], "filing_id string, member_id string"))
    forms = [("w1", "Ann Lee", "native", dt.date(2025, 3, 1), "1 A sale 1/5/2025 No $5", False, False), ("w2", "Ann Lee", "native", dt.date(2025, 3, 1), "1 A sale 1/5/2025 No $5", False, True)]
    executive = build.executive(spark.createDataFrame(forms, "filing_id string, name string, form string, filed_on date, text string, recovered_by_ocr boolean, is_amendment boolean"), "white_house")

    out = build.assemble(house, senate, executive)
    rows = {r.filing_id: r for r in out.trades.collect()}
    assert set(rows) == {"2001", "s1", "w1"}  # the repeated row of 2001 is one
    assert rows["2001"].id.startswith("2001-") and rows["w1"].member_id == "x-ann-lee" and rows["s1"].low_cents == 100_100
    assert {(r.filing_id, r.status) for r in out.status.collect()} == {("2001", "parsed"), ("2002", "without_text"), ("s1", "parsed"), ("s2", "without_text"), ("w1", "parsed"), ("w2", "without_text")}
    assert {r.filing_id: r.warnings for r in out.status.collect() if r.warnings} == {"2001": ["a row's dates could not be read"], "s1": ["1 rows without a date left out"]}
    assert {r.source: r.unreadable for r in build.coverage(out.status).collect()} == {"house": 1, "senate": 1, "white_house": 1}
    assert stats.status_counts(out.status).count() == 6
    assert stats.source_line(["a", "b", "c"]) == "a, b, and c" and stats.source_line(["a", "b"]) == "a and b"
    again = build.house(index, texts, cross, known, status=out.status)
    assert again.trades.isEmpty()


def test_landed_files_and_membership(spark, tmp_path):
    """Files above the ceiling are not taken; a map of committees gives a row for each member, empty lists none."""
    for name, size in (("a.pdf", 3), ("b.pdf", 30)):
        (tmp_path / name).write_bytes(b"x" * size)
    assert [r.length for r in indexes.landed(spark, str(tmp_path), most=3).collect()] == [3]
    text = '{"HSAG": [{"name": "A", "bioguide": "A1"}, {"name": "B", "bioguide": ""}], "HSAG01": [{"name": "A", "bioguide": "A1"}], "SSXX": []}'
    rows = indexes.membership_json(spark.createDataFrame([(text,)], "value string"))
    assert sorted(tuple(r) for r in rows.collect()) == [("HSAG", ""), ("HSAG", "A1"), ("HSAG01", "A1")]
    told = indexes.roster(spark.createDataFrame([("HSAG", "Agriculture")], "thomas_id string, name string"), rows).collect()
    assert [(r.bioguide, r.committees) for r in told] == [("A1", ["Agriculture"])]

"""Names to people: tiers, seats, nicknames, suffixes."""

from quaystone.functions import columns as C
from quaystone.operators import identity

CROSS = "bioguide string, last string, first string, nickname string, state string, chamber string, district int, last_term_end_year int, party string"
FILED = "filing_id string, last string, first string, state string, district string, full_name string"


def people(spark):
    rows = [
        ("A1", "Quill", "Robert", "Bob", "TX", "house", 3), ("B1", "Stone", "Ann", None, "CA", "house", 1), ("B2", "Stone", "Ann", None, "CA", "house", 7), ("B3", "Stone", "Peter", "Pete", "CA", "house", 9),
        ("C1", "Del Mar", "Iris", None, "WA", "house", 2), ("D1", "Núñez", "José", None, "NM", "senate", None), ("D1", "Núñez", "José", None, "NM", "house", 4), ("E1", "Reed", "Carl", "Chip", "ME", "senate", None), ("E2", "Reed", "Dora", None, "VT", "senate", None), ("E3", "Reed", "Old", None, "VT", "senate", None),
    ]
    return spark.createDataFrame([(*r, 1950 if r[0] == "E3" else 9999, "Democrat") for r in rows], CROSS)


def test_tiers(spark):
    asked = [
        ("1", "Quill", "Buddy", "tx", None, "A1", "matched"),  # the only one of the surname in the state
        ("2", "Stone", "Ann", "CA", "07", "B2", "matched"), ("3", "Stone", "Ann", "CA", None, None, "ambiguous"), ("4", "Stone", "Ann", "CA", "9", None, "ambiguous"),
        ("5", "Stone", "Pete", "CA", None, "B3", "matched"), ("6", "Stone", "P", "CA", None, "B3", "matched"), ("7", "Stone", "Zed", "CA", "9", "B3", "matched"), ("8", "Stone", "Zed", "CA", None, None, "ambiguous"),
        ("9", "Mar", "Iris Del", "WA", None, "C1", "matched"), ("10", "NUNEZ", "Jose", "NM", None, "D1", "matched"), ("11", "Nobody", "X", "NM", None, None, "not_found"), ("12", None, None, None, None, None, "not_found"),
    ]
    filings = spark.createDataFrame([(*a[:5], f"{a[2]} {a[1]}") for a in asked], FILED)
    got = {r.filing_id: (r.bioguide, r.resolution) for r in identity.resolve(filings, people(spark)).collect()}
    assert got == {a[0]: a[5:] for a in asked}
    known = spark.createDataFrame([("Zed Stone", "known")], "full_name string, member_id string")
    ids = {r.filing_id: r.member_id for r in identity.member_ids(filings, known, identity.resolve(filings, people(spark))).collect()}
    assert (ids["8"], ids["1"], ids["11"]) == ("known", "A1", "x-nobody-x-nm")
    assert identity.resolve(filings.limit(0), people(spark)).isEmpty() and identity.resolve(filings, people(spark).limit(0)).filter("bioguide is not null").isEmpty()


def test_chamber(spark):
    asked = [("1", "Reed", "Chip", "E1"), ("2", "Reed", "Ch", None), ("3", "Reed III", "Dora Ann", "E2"), ("4", "Jr.", "Jose Nunez", "D1"), ("5", "Reed", "", None), ("6", "Nunez", "Someone", "D1"), ("7", "Quill", "Robert", None)]
    filings = spark.createDataFrame([(i, last, first, f"as filed {i}") for i, last, first, _ in asked], "filing_id string, last string, first string, display string")
    got = {r.filing_id: (r.bioguide, r.resolution) for r in identity.resolve_in_chamber(filings, people(spark), "senate", 2020).collect()}
    assert {i: b for i, (b, _) in got.items()} == {a[0]: a[3] for a in asked}
    assert got["2"][1] == got["5"][1] == "ambiguous" and got["7"][1] == "not_found"
    shown = {r.filing_id: (r.member_id, r.display, r.state) for r in identity.senate_people(filings, people(spark), 2020).collect()}
    assert shown["1"] == ("E1", "Carl Reed", "ME") and shown["4"] == ("D1", "José Núñez", "NM") and shown["7"] == ("x-quill-robert", "as filed 7", None)


def test_attach(spark):
    members = spark.createDataFrame([("A1", "A1", "old"), ("x-y", None, "old")], "id string, bioguide_id string, party string")
    roster = spark.createDataFrame([("A1", ["One", "Two"])], "bioguide string, committees array<string>")
    got = {r.id: (r.party, r.committees) for r in identity.attach(members, people(spark), roster).collect()}
    assert got == {"A1": ("Democrat", ["One", "Two"]), "x-y": ("unknown", [])}


def test_lines_about_people(spark):
    rows = spark.createDataFrame([("democrat", "house", "CA", "31", "buy"), ("unknown", "senate", "ME", None, "sell"), ("independent", None, None, None, "exchange")], "party string, chamber string, state string, district string, tx_type string")
    got = rows.select(C.identity_line().alias("i"), C.source_name().alias("s"), C.arrow().alias("a")).collect()
    assert [tuple(r) for r in got] == [("Democrat · House · CA-31", "US House Clerk", "↑"), ("Senate · ME", "US Senate eFD", "↓"), ("Independent", "US House Clerk", "↔")]
    assert set(C.ASSET_NAMES) == set("ST OP MF EF GS CS AB OT CT HN OI PS RP SA CO FA IH IR TR VA WU".split())

"""Derived columns of a trade: dates, display names, amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LATE_DAYS = 45
CAP_DAYS = 1200  #: lags beyond this are taken for mistyped years

#: The asset codes of the house form, and what they stand for.
ASSET_NAMES = {
    "ST": "Stock", "OP": "Option", "MF": "Mutual fund", "EF": "Exchange-traded fund", "GS": "Government security", "CS": "Corporate security", "AB": "Asset-backed",
    "OT": "Other", "CT": "Cryptocurrency", "HN": "Hedge fund", "OI": "Ownership interest", "PS": "Stock (private)", "RP": "Real property", "SA": "Stock appreciation right",
    "CO": "Collectible", "FA": "Farm", "IH": "Inheritance", "IR": "IRA", "TR": "Trust", "VA": "Variable annuity", "WU": "Whole life insurance",
}
#: What is shown for the codes of directions, owners, chambers and parties.
VERBS = {"buy": "Bought", "sell": "Sold", "partial_sell": "Sold (partial)", "exchange": "Exchanged"}
OWNERS = {"self": "Member", "spouse": "Spouse", "joint": "Joint", "dependent": "Dependent"}
CHAMBERS = {"house": "House", "senate": "Senate", "executive": "Executive Branch"}
PARTIES = {"democrat": "Democrat", "republican": "Republican", "independent": "Independent", "unknown": "Party unknown"}
TX_ORDER = ["buy", "sell", "partial_sell", "exchange"]


def named(code: Column, names: dict[str, str], otherwise: Column | None = None) -> Column:
    """A display name by a literal map."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[code], otherwise if otherwise is not None else code)


def lag_days(tx: str = "tx_date", disclosed: str = "disclosed_date") -> Column:
    return F.datediff(disclosed, tx)


def impossible() -> Column:
    return F.col("tx_date") > F.col("disclosed_date")


def late() -> Column:
    return ~impossible() & (lag_days() > LATE_DAYS)


def is_option() -> Column:
    return F.col("asset_type").eqNullSafe(F.lit("OP"))


def sort_date() -> Column:
    return F.when(impossible(), F.col("disclosed_date")).otherwise(F.col("tx_date"))


def _in_brackets(text: Column, opens: str, closes: str) -> Column:
    """What stands in brackets at the end of a text; empty if nothing does."""
    inner = F.substring_index(F.substring(text, F.lit(1), F.length(text) - 1), opens, -1)
    return F.when(text.endswith(closes) & text.contains(opens), inner).otherwise("")


def _capitals(x: Column, least: int, most: int, also: str = "") -> Column:
    plain = F.translate(x, also, "") if also else x
    return F.length(x).between(least, most) & (F.translate(plain, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "") == "")


def clean_asset() -> Column:
    """The asset's name without a code in square brackets at its end, and without a ticker in round ones before that code."""
    name = F.rtrim("asset")
    code = _in_brackets(name, "[", "]")
    coded = _capitals(code, 2, 4)
    short = F.rtrim(F.substring(name, F.lit(1), F.length(name) - F.length(code) - 2))
    ticker = _in_brackets(short, "(", ")")
    listed = _capitals(ticker, 1, 7, "0123456789.-") & F.substring(ticker, 1, 1).between("A", "Z")
    return F.trim(F.when(coded & listed, F.substring(short, F.lit(1), F.length(short) - F.length(ticker) - 2)).when(coded, short).otherwise(F.col("asset")))


def symbol() -> Column:
    return F.coalesce("ticker", F.substring(clean_asset(), 1, 18))


def gap_phrase() -> Column:
    days = lag_days()
    return F.when(impossible(), "dates contradict").otherwise(F.concat(F.lit("lag "), days.cast("string"), F.lit(" d")))


def dollars(cents: Column) -> Column:
    """Grouped dollars; cents only if there are any."""
    whole = F.format_number(F.floor(cents / 100), 0)
    return F.concat(F.lit("$"), whole, F.when(F.pmod(cents, F.lit(100)) != 0, F.format_string(".%02d", F.pmod(cents, F.lit(100)))).otherwise(F.lit("")))


def amount_label(kind: str = "amount_kind", low: str = "low_cents", high: str = "high_cents") -> Column:
    lo, hi = dollars(F.col(low)), dollars(F.col(high))
    k = F.col(kind)
    return F.when(k == "range", F.concat(lo, F.lit(" – "), hi)).when(k == "atLeast", F.concat(lo, F.lit("+"))).when(k == "exact", lo).when(k == "none", F.lit("None (under $201)")).otherwise(F.lit("Amount not readable"))


def party(raw: Column) -> Column:
    name = F.lower(raw)
    return F.when(name.isin("democrat", "democratic"), "democrat").when(name == "republican", "republican").when(F.coalesce(name, F.lit("")) != "", "independent").otherwise("unknown")


def seat(state: Column, district: Column) -> Column:
    return F.concat_ws("-", state, district)


def initials(name: Column) -> Column:
    """First letters of the last two words that do not end in a full stop; a dash if there is none."""
    parts = F.filter(F.split(F.trim(name), r"\s+"), lambda x: ~x.endswith(".") & (x != ""))
    last = F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 2)
    return F.when(F.size(parts) == 0, "—").otherwise(F.upper(F.array_join(F.transform(last, lambda x: F.substring(x, 1, 1)), "")))


def percent(part: Column, whole: Column) -> Column:
    """Whole percents, halves away from zero; 0 of nothing."""
    return F.when(whole > 0, F.round(part * 100.0 / whole)).otherwise(F.lit(0.0)).cast("long")


def document_url(filing: Column, base: str) -> Column:
    """null unless the filing id is letters and digits alone."""
    return F.when(filing.rlike("^[A-Za-z0-9]+$"), F.concat(F.lit(base), filing, F.lit(".pdf")))


def date_label(d: Column) -> Column:
    return F.date_format(d, "MMM d, yyyy")


def age_phrase(then: Column, now: Column) -> Column:
    days = F.datediff(now, then)
    return F.when(days < 0, "dated in the future").when(days == 0, "downloaded today").when(days == 1, "1 day old").when(days > 1, F.concat(days.cast("string"), F.lit(" days old")))


def lenient_date(y: Column, m: Column, d: Column) -> Column:
    """Day numbers past a month's end roll over; null if the parts are out of range."""
    ok = m.between(1, 12) & d.between(1, 31)
    return F.when(ok, F.date_add(F.make_date(y, m, F.lit(1)), d - 1))


def iso_date(text: Column) -> Column:
    part = lambda i: F.try_to_number(F.regexp_extract(F.trim(text), r"^(\d{4})-(\d{1,2})-(\d{1,2})$", i), F.lit("9999")).cast("int")
    return lenient_date(part(1), part(2), part(3))


def us_date(text: Column) -> Column:
    """M/D/Y; two-digit years are of this century; years outside 1901-2199 are null."""
    t = F.trim(text)
    month, day, given = (x.try_cast("int") for x in (F.substring_index(t, "/", 1), F.substring_index(F.substring_index(t, "/", 2), "/", -1), F.substring_index(t, "/", -1)))
    year = given + F.when(given < 100, 2000).otherwise(0)
    return F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{1,4}$"), F.when((year > 1900) & (year < 2200), lenient_date(year, month, day)))


def verb() -> Column:
    return named(F.col("tx_type"), VERBS)


def is_acquisition() -> Column:
    return F.col("tx_type") == "buy"


def party_letter(column: str = "party") -> Column:
    """Empty where the party is not known."""
    return F.when(F.col(column).isin("democrat", "republican", "independent"), F.upper(F.substring(column, 1, 1))).otherwise("")


def party_label(column: str = "party") -> Column:
    return named(F.coalesce(F.col(column), F.lit("unknown")), PARTIES)


def _by_kind(kind: str, told: dict[str, Column], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for k, text in told.items():
        out = F.when(F.col(kind) == k, text).otherwise(out)
    return out


def amount_headline(kind: str = "amount_kind", low: str = "low_cents", high: str = "high_cents") -> Column:
    """A bracket at a glance. An open one has no upper end, and none is made up."""
    lo, hi = dollars(F.col(low)), dollars(F.col(high))
    return _by_kind(kind, {"range": F.concat(lo, F.lit(" – "), hi), "atLeast": F.concat(F.lit("≥ "), lo), "exact": lo, "none": F.lit("no amount")}, "?")


def amount_caption(kind: str = "amount_kind") -> Column:
    """What sort of figure it is."""
    told = {"range": "two bounds", "atLeast": "lower bound only", "exact": "one figure", "none": "under the threshold"}
    return _by_kind(kind, {k: F.lit(v) for k, v in told.items()}, "no figure read")


def amount_spoken(kind: str = "amount_kind", low: str = "low_cents", high: str = "high_cents") -> Column:
    """A bracket to be read aloud: no dashes and signs."""
    lo, hi = dollars(F.col(low)), dollars(F.col(high))
    told = {"range": F.concat(F.lit("from "), lo, F.lit(" up to "), hi), "atLeast": F.concat(lo, F.lit(" or more")), "exact": F.concat(lo, F.lit(" exactly")), "none": F.lit("nothing above the threshold")}
    return _by_kind(kind, told, "an amount that was not read")


def timing() -> Column:
    return F.concat(date_label(F.col("tx_date")), F.lit("; "), gap_phrase())


def summary() -> Column:
    """A row's facts on one line, parted by semicolons; what is not known is left out."""
    kind = named(F.col("asset_type"), ASSET_NAMES, F.lit(None).cast("string"))
    return F.concat_ws("; ", F.concat(F.col("member_name"), F.lit(" / "), named(F.col("owner"), OWNERS)), F.concat(verb(), F.lit(": "), clean_asset()), F.col("ticker"), kind, amount_spoken(), timing())


def chamber_tag(chambers: list[str], column: str = "chamber") -> Column:
    """The chamber in words, if the feed covers more than one."""
    return named(F.col(column), CHAMBERS) if len(set(chambers)) > 1 else F.lit(None).cast("string")


def is_stale(last_contact: Column, generated: Column, now: Column, days: int = 7) -> Column:
    """Whether the last contact, or else the data, is older; false if neither is known."""
    return F.coalesce(F.datediff(now, F.coalesce(last_contact, generated)) > days, F.lit(False))


def identity_line(party_column: str = "party", chamber: str = "chamber", state: str = "state", district: str = "district") -> Column:
    """Party, chamber and seat, without what is not known."""
    shown = F.when(F.col(party_column) != "unknown", named(F.col(party_column), PARTIES))
    return F.concat_ws(" · ", shown, named(F.col(chamber), CHAMBERS), F.nullif(seat(F.col(state), F.col(district)), F.lit("")))


def source_name(chamber: str = "chamber") -> Column:
    """Where a row comes from; the house clerk where the chamber is not known."""
    return named(F.col(chamber), {"senate": "US Senate eFD", "executive": "White House Public Disclosures"}, F.lit("US House Clerk"))


def arrow() -> Column:
    """Up for what was acquired, down for what was disposed of, both ways for exchanges."""
    return F.when(F.col("tx_type") == "buy", "↑").when(F.col("tx_type") == "exchange", "↔").otherwise("↓")

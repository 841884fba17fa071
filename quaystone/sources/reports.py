"""Rows of filed reports, by windows over the lines of a filing.

A text is exploded to lines, each line is classified by the kinds of its words (`functions.tokens`, in Arrow batches), and rows are put
together from the lines around the one that holds their dates. Lines are exchanged once, by filing; a filing has a few hundred.
Filter filings before their lines are read. Money goes through the one grammar of `amounts`.

A line with a row's dates always begins a row. A row with no readable date is left out and told by `report_warnings`.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.functions import amounts
from quaystone.functions import columns as C
from quaystone.functions import tokens as K

COLUMNS = (
    "filing_id", "position", "member_id", "owner", "asset", "ticker", "asset_type", "tx_type", "tx_date", "disclosed_date",
    "amount_kind", "low_cents", "high_cents", "filing_description", "warnings", "is_amendment",
)

#: Fixed values of the house form: transaction codes, owner codes by precedence, first and last heading cell, footers, furniture.
TX_CODES = {"S (partial)": "partial_sell", "P": "buy", "S": "sell", "E": "exchange"}
OWNER_CODES = {"SP": "spouse", "JT": "joint", "DC": "dependent"}
HEAD_OPENS, HEAD_CLOSES = "ID Owner Asset", "$200?"
FOOTERS = ("* For the complete list", "I CERTIFY", "Digitally Signed", "my knowledge and belief")
FURNITURE_OPENS = ("Filing ID #", "Name:", "Status:", "State/District:", "Initial Public Offering")
FURNITURE_HAS = ("Clerk of the House", "Legislative Resource Center")
#: Fixed values of the executive form: transaction words and furniture.
TX_WORDS = {"purchase": "buy", "sale": "sell", "exchange": "exchange"}
SCAN_WORDS = (
    "oge form 278-t", "instructions", "public form", "account num", "filer's name", "filer's information", "transactions", "notification", "days ago", "received over", "summary of contents", "privacy act",
    "u.s.c", "c.f.r", "office of government ethics", "executive branch personnel",
)
MOST_STRAY = 4  #: lines without a row that can be a row's description

def _any(flags: list[Column]) -> Column:
    out = F.lit(False)
    for flag in flags:
        out = out | flag
    return out


def tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def owner(codes: Column) -> Column:
    """The owner that codes name, by precedence; null if they name none."""
    out = F.lit(None).cast("string")
    for code, name in reversed(OWNER_CODES.items()):
        out = F.when(codes.contains(code), name).otherwise(out)
    return out


def _per_line(fields: str, told):
    """A function of a string column to a struct, one line at a time, in Arrow batches; of null it is a struct of nulls."""
    kinds = {name: kind for name, kind in (f.split() for f in fields.split(","))}
    names, none = list(kinds), (None,) * len(kinds)

    @F.arrow_udf(T.StructType([T.StructField(n, T.BooleanType() if k == "boolean" else T.StringType()) for n, k in kinds.items()]))
    def run(column: pa.Array) -> pa.Array:
        rows = [none if x is None else told(x) for x in column.to_pylist()]
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, pa.bool_() if k == "boolean" else pa.string()) for c, k in zip(columns, kinds.values(), strict=True)], names)

    return run


#: Up to the first figure of a line, and white space, as Java reads them in `amounts` and `tidy`.
_TO_FIGURE = re.compile(rf"^([^\n\r\x85\u2028\u2029]*?){amounts.FIGURE}")
#: What a line of a house report has if it is more than words, the beginning of a page number included.
_MARKED = re.compile(r"[/:\[($]|\s\s|^Page")
_GAPS = re.compile(r"[ \t\n\x0b\f\r]+")


def _house_line(line: str) -> tuple:
    """line: what is left of it without codes that are held; head: what is before a row's code. Both null where there is no such thing."""
    if line[:2] not in OWNER_CODES and not _MARKED.search(line):  # words alone
        return None, None, None, None, None, "", None, None, "", None, False, False, False, line == "Yes No", None, None, None
    codes, rest = K.after(line, OWNER_CODES)
    held = codes if codes and (not rest or K.label(rest)[0]) else None
    line = rest if held else line
    some = K.words(line) if "/" in line else []
    row, (letter, body) = K.dated_code(some, TX_CODES), K.label(line)
    code, tx, told, tail, head = (row[1], some[row[2]], some[row[2] + 1], " ".join(some[row[2] + 2 :]), " ".join(some[: row[0]])) if row else (None, None, None, "", None)
    coded = [x for x, _, _ in K.enclosed(line, "[", "]") if K.is_code(x)] if "[" in line else []
    alone = coded[0] if coded and line == f"[{coded[0]}]" else None
    like = bool(coded) or ("(" in line and any(K.is_symbol(x) for x, _, _ in K.enclosed(line, "(", ")"))) or bool(K.after(line, OWNER_CODES)[0])
    page = line == "Yes No" or (line.startswith("Page ") and len(line.split()) == 4 and K.is_page_number(line.split()))
    # What is left of a line without its first figure, and its symbol and code.
    left = _GAPS.sub(" ", _TO_FIGURE.sub(r"\1 ", line, count=1)).strip(" ") if not row and "$" in line else None
    return held, line if held else None, code, tx, told, tail, head, letter, body, alone, bool(coded), like, len(K.apart(line)) > 1, page, left, *(K.symbol_and_code(left) if left else (None, None))


def _asset_name(text: str) -> tuple:
    """(owner codes, name, ticker, asset code) of all the text before a row's code."""
    name = K.last_coded(text)
    number, gap, rest = name.partition(" ")
    name = rest.lstrip() if gap and K.is_number(number, 99, 6) else name  # an amended row's number on the form
    codes, name = K.after(name, OWNER_CODES)
    return codes, name, *K.symbol_and_code(name)


def _executive_line(line: str) -> tuple:
    low = line.lower()
    if "/" not in line and "page" not in low and "Date:" not in line:  # neither dates nor a page number
        return (None,) * 8 + (False,)
    some = K.words(line)
    at = K.dated_word(some, TX_WORDS)
    received = next((K.date(K.word(some, i + 2)) for i, x in enumerate(some) if K.bare(x) == "oge" and K.bare(K.word(some, i + 1)) == "received"), None) if "oge" in low and "received" in low else None
    parts = next((K.word(some, i + 1).split(".") for i, x in enumerate(some) if x == "Date:"), []) if "Date:" in line else []
    signed = "/".join([parts[1], parts[2], parts[0]]) if len(parts) == 3 and K.is_number(parts[0], 4, 4) and K.is_number(parts[1], 2) and K.is_number(parts[2], 2) else None
    row = (None,) * 6 if at is None else (" ".join(some[:at]), K.bare(some[at]), some[at + 1], K.date(some[at + 1], fused=True), " ".join(some[at + 3 :]), " ".join(map(K.money, some[at + 3 :])))
    return *row, received, signed, "page" in low and K.is_page_number(some)


house_line = _per_line("held string, line string, code string, tx string, told string, tail string, head string, letter string, body string, alone string, coded boolean, like boolean, heading boolean, page boolean, left string, left_ticker string, left_code string", _house_line)
asset_name = _per_line("codes string, name string, ticker string, code string", _asset_name)
_EXECUTIVE = "head string, word string, raw string, date string, tail string, amount string, received string, signed string, page boolean"
scan_line = _per_line(_EXECUTIVE, _executive_line)


#: Control characters, one by one: Java looks such a class up, and compares the ends of one of ranges.
_CONTROL = "[" + "".join(rf"\x{i:02x}" for i in (*range(0x20), *range(0x7F, 0xA0))) + "]"


def clean(line: Column) -> Column:
    """Without control characters and outer spaces."""
    return F.trim(F.regexp_replace(line, _CONTROL, " "))


def _split(text: Column) -> Column:
    """The lines of a text, as they are."""
    return F.when(text.contains("\r"), F.split(text, r"\r\n|\r|\n")).otherwise(F.split(text, "\n"))


def lines(filings: DataFrame) -> DataFrame:
    """filing_id, filed_on, n, raw (the line), line (without control characters and outer spaces) of every line."""
    split = filings.select("filing_id", "filed_on", F.posexplode(_split(F.coalesce("text", F.lit("")))).alias("n", "raw"))
    return split.withColumn("line", clean(F.col("raw")))


def _by(*keys: str):
    """(up to a line, before it) among the lines with the same keys."""
    w = Window.partitionBy("filing_id", *keys).orderBy("n")
    return w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)


def _house_tokens(filings: DataFrame) -> DataFrame:
    """The table's lines, classified: kind, and what it takes to put rows together."""
    upto, before = _by()
    line = F.col("line")
    told = lines(filings).filter(line != "").withColumn("w", house_line("line"))
    told = told.withColumn("event", F.when(line.contains(HEAD_OPENS), "open").when(line.contains(HEAD_CLOSES), "close").when(_any([line.startswith(x) for x in FOOTERS]), "foot"))
    told = told.withColumns({"before": F.last("event", True).over(before), "above_d": F.lead("w.letter").over(Window.partitionBy("filing_id").orderBy("n")).eqNullSafe(F.lit("D"))})
    told = told.withColumn("event", F.when((F.col("event") != "close") | F.col("before").eqNullSafe(F.lit("open")), F.col("event")))
    told = told.withColumns({"place": F.last("event", True).over(upto), "events": F.count("event").over(upto), "feet": F.count_if(F.col("event") == "foot").over(upto)})
    furniture = _any([line.startswith(x) for x in FURNITURE_OPENS] + [line.contains(x) for x in FURNITURE_HAS]) | F.col("w.page")
    told = told.filter((F.col("place") == "close") & F.col("event").isNull() & ~furniture)
    # Owner codes alone, or before a label, speak of the next row (held). A row: its code, its dates and its amount.
    names = ("held", "code", "tx", "told", "tail", "head", "letter", "body", "alone", "coded", "like", "heading", "left", "left_ticker", "left_code")
    told = told.select("filing_id", "filed_on", "n", "above_d", "events", "feet", F.coalesce("w.line", "line").alias("line"), *[F.col(f"w.{c}").alias(c) for c in names])
    told = told.withColumns({"tx_date": C.us_date(F.col("tx")), "told_date": C.us_date(F.col("told")), "is_row": F.col("code").isNotNull(), "amount": F.when(F.col("code").isNotNull(), amounts.parse(F.col("tail")))}).drop("tx", "told")
    told = told.withColumn("valid", F.col("is_row") & F.col("tx_date").isNotNull() & F.col("told_date").isNotNull())
    told = told.withColumns({"part": F.count_if("is_row").over(upto), "row": F.count_if("valid").over(upto), "awaits": F.last(F.when(F.col("is_row"), F.coalesce("amount.pending", F.lit(""))), True).over(upto)})
    # All windows share one sort, and each step asks for the last mark up to a line, so that a line is carried through few of them.
    # The first figure below a row that waits for one is that row's: no other since the row. Codes held before a row: since the row above.
    figure = F.when(~F.col("is_row") & (F.col("awaits") != ""), amounts.cents(line))
    told = told.withColumn("figure", figure)
    mark = F.when(F.col("is_row"), True).when(F.col("figure").isNotNull(), False)
    waits = F.last(F.when(F.col("held").isNotNull() & ~F.col("is_row"), F.struct("row", "held")), True).over(upto)
    told = told.withColumns({"first": F.last(mark, True).over(before), "waits": waits})
    told = told.withColumns({"figure": F.when(F.col("first"), F.col("figure")), "waits": F.when(F.col("waits.row") == F.col("row") - 1, F.col("waits.held"))}).drop("first", "awaits")
    letter, body = F.col("letter"), F.col("body")
    free = ~F.col("is_row") & F.col("figure").isNull()
    kind = (
        F.when(F.col("is_row"), "row").when(F.col("figure").isNotNull(), "figure").when(line == "", "owner").when(F.col("alone").isNotNull(), "code").when(letter.isNotNull(), "label").when(F.col("heading"), "heading").otherwise("text")
    )
    told = told.withColumns({"kind": kind, "letter": F.when(free, letter), "body": F.when(free & letter.isNotNull(), body)})
    # A text right above a description belongs to it; texts below one go on with it to a full stop, or to what looks like an asset.
    ends = lambda c: c.rlike(r"[.!?]$")
    is_label = F.col("kind") == "label"
    told = told.withColumn("kind", F.when((F.col("kind") == "text") & F.col("above_d") & ~F.col("coded"), "above").otherwise(F.col("kind")))
    opens = is_label & F.coalesce((F.col("letter") == "D") & (F.col("body") != "") & ~ends(F.col("body")), F.lit(False))
    told = told.withColumn("over", F.last(F.when(F.col("kind").isin("row", "label"), F.struct("events", opens.alias("opens"))), True).over(upto)).drop("above_d", "coded", "heading")
    told = told.withColumn("open", F.coalesce(F.col("over.opens") & (F.col("over.events") == F.col("events")), F.lit(False)) & (F.col("kind") == "text")).drop("over")
    since = lambda what: F.when(is_label, True).when(F.col("open") & what, False)
    told = told.withColumns({"likes": F.last(since(F.col("like")), True).over(upto), "stops": F.last(since(ends(line)), True).over(before)})
    told = told.withColumn("kind", F.when(F.col("open") & F.col("likes") & F.col("stops"), "more").otherwise(F.col("kind"))).drop("open", "likes", "stops", "like")
    # What a label says is of the row above, unless asset text of the next row came between: in the same part, on the same page.
    of_figure = lambda c: F.when(F.col("kind") == "figure", F.col(c))
    told = told.withColumns({c: of_figure(c) for c in ("left", "left_ticker", "left_code")})
    pending = (F.col("kind") == "text") | ((F.col("left") != "") & F.col("left_ticker").isNull())
    run = F.col("part") + F.col("events")
    told = told.withColumn("pending", F.last(F.when(pending, run), True).over(before))
    told = told.withColumn("mine", (F.col("row") > 0) & ~F.col("pending").eqNullSafe(run)).drop("pending")
    return told.withColumn("mine", F.when(F.col("kind") == "more", F.last(F.when(is_label, F.col("mine")), True).over(upto)).otherwise(F.col("mine")))


def house_rows(filings: DataFrame) -> DataFrame:
    """Rows of house reports (filing_id, filed_on, text)."""
    told = _house_tokens(filings)
    own = F.col("kind").isin("row", "figure", "code") | (F.col("kind").isin("label", "more") & F.col("mine"))
    piece = F.struct("n", "kind", "line", "body", "letter", "figure", "left", "left_ticker", "left_code", "part", "events", "feet", "alone")
    row = F.struct("code", "tx_date", "told_date", "tail", "amount", "part", "events", "feet", "head", "waits")
    told = told.withColumn("target", F.when(own, F.col("row")).otherwise(F.col("row") + 1))
    held = F.max(F.when((F.col("kind") == "row") & F.col("held").isNotNull(), F.struct("n", "held")))["held"]
    found = told.groupBy("filing_id", "target").agg(F.max(F.when(F.col("valid"), row)).alias("r"), held.alias("held"), F.max("filed_on").alias("filed_on"), F.array_sort(F.collect_list(piece)).alias("pieces")).filter("r is not null")
    found = found.withColumn("held", F.coalesce("held", "r.waits"))
    those = lambda test, value: F.filter(F.transform(F.filter("pieces", test), value), lambda x: x.isNotNull())
    first = lambda kind, value: F.get(those(lambda p: p["kind"] == kind, value), F.lit(0))
    # Asset text of the part just before the row, on the same page.
    buffered = those(lambda p: p["kind"].isin("text", "left") & (p["part"] == F.col("r.part") - 1) & (p["events"] == F.col("r.events")), lambda p: p["line"])
    name = tidy(F.concat_ws(" ", F.concat_ws(" ", buffered), F.col("before_left"), F.col("r.head")))
    # Figure text that is no part of its row's name opens the next row's.
    left = first("figure", lambda p: F.when(p["left"] != "", F.struct(p["left"], p["left_ticker"], p["left_code"])))
    found = found.withColumn("f", left).withColumns({c: F.col(f"f.{c}") for c in ("left", "left_ticker", "left_code")})
    by = Window.partitionBy("filing_id").orderBy("target")
    found = found.withColumn("before_left", F.when(F.lag("left_ticker").over(by).isNull(), F.lag("left").over(by)))
    found = found.withColumn("is", asset_name(name)).withColumns({c: F.col(f"is.{c}") for c in ("codes", "name", "ticker")}).withColumn("asset_type", F.col("is.code"))
    found = found.withColumns({"figure": first("figure", lambda p: p["figure"]), "orphan": first("code", lambda p: p["alone"])})
    claims = F.col("ticker").isNull() & F.col("left_ticker").isNotNull()
    left_code = F.col("left_code")
    below = lambda p: (p["kind"] == "label") & (p["letter"] == "D") & (p["body"] != "")
    text = those(lambda p: (below(p) | p["kind"].isin("more", "above")) & (p["feet"] == F.col("r.feet")), lambda p: F.when(p["kind"] == "label", p["body"]).otherwise(p["line"]))
    amended = F.exists("pieces", lambda p: (p["kind"] == "label") & (p["letter"] == "F") & (p["body"] == "Amended"))
    a, figure = F.col("r.amount"), F.col("figure")
    upper, over = a["pending"].eqNullSafe(F.lit("upper")), a["pending"].eqNullSafe(F.lit("threshold"))
    warned = F.filter(
        F.array(
            F.when(upper & figure.isNull(), "upper bound of the range not found"),
            F.when(upper & (figure <= a["low_cents"]), "ignored an upper bound that is not above the lower"),
            F.when(over & figure.isNull(), "threshold of the amount not found"),
            F.when((a["kind"] == "unknown") & ~over & (F.col("r.tail") != ""), F.concat(F.lit("amount not understood: "), F.col("r.tail"))),
        ),
        lambda x: x.isNotNull(),
    )
    tx = C.named(F.col("r.code"), TX_CODES)
    done = found.select(
        "filing_id", (F.col("target") - 1).cast("int").alias("position"), F.coalesce(owner(F.col("codes")), owner(F.col("held")), F.lit("self")).alias("owner"),
        F.when(claims, tidy(F.concat_ws(" ", "name", "left"))).otherwise(F.col("name")).alias("asset"), F.when(claims, F.col("left_ticker")).otherwise(F.col("ticker")).alias("ticker"),
        F.coalesce("asset_type", F.when(claims, left_code), "orphan").alias("asset_type"), tx.alias("tx_type"), F.col("r.tx_date").alias("tx_date"), F.col("r.told_date").alias("told_date"),
        F.when(over & figure.isNotNull(), "atLeast").otherwise(a["kind"]).alias("amount_kind"), F.when(over, F.coalesce(figure, F.lit(0))).otherwise(a["low_cents"]).alias("low_cents"),
        F.when(over, F.coalesce(figure, F.lit(0))).when(upper & (figure > a["low_cents"]), figure).otherwise(a["high_cents"]).alias("high_cents"), F.nullif(tidy(F.concat_ws(" ", text)), F.lit("")).alias("filing_description"), warned.alias("warnings"), amended.alias("is_amendment"), "filed_on",
    )
    return done.withColumn("disclosed_date", F.coalesce("filed_on", "told_date")).drop("told_date", "filed_on")


# Executive branch ---------------------------------------------------------------------------------


def _executive(rows: DataFrame, notes: list[Column]) -> DataFrame:
    """Rows of executive forms (filing_id, n, asset, word, tx_date, disclosed_date, a) in the common columns: owner self, no ticker."""
    notes = [F.when(F.col("a.pending").isNotNull(), "amount goes on past its line"), *notes]
    nth = F.row_number().over(Window.partitionBy("filing_id").orderBy("n")) - 1
    return rows.select(
        "filing_id", nth.cast("int").alias("position"), F.lit("self").alias("owner"), "asset", F.lit(None).cast("string").alias("ticker"), F.lit(None).cast("string").alias("asset_type"), C.named(F.lower("word"), TX_WORDS).alias("tx_type"), "tx_date", "disclosed_date",
        F.col("a.kind").alias("amount_kind"), F.col("a.low_cents").alias("low_cents"), F.col("a.high_cents").alias("high_cents"), F.lit(None).cast("string").alias("filing_description"), F.filter(F.array(*notes), lambda x: x.isNotNull()).alias("warnings"), F.lit(False).alias("is_amendment"),
    )


def _scan_lines(filings: DataFrame) -> DataFrame:
    """Lines of scanned forms: rows, their dates, the description lines before them, and the date of disclosure."""
    line, low = F.col("line"), F.lower("line")
    page = Window.partitionBy("filing_id").orderBy("n")
    whole = page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = lines(filings).withColumn("w", scan_line("line"))
    told = told.withColumns({"received": C.us_date(F.col("w.received")), "signed": C.us_date(F.col("w.signed")), "word": F.col("w.word")})
    furniture = (line == "") | F.col("received").isNotNull() | F.col("signed").isNotNull() | F.col("w.page") | _any([low.contains(w) for w in SCAN_WORDS]) | (low.contains("description") & low.contains("type"))
    told = told.withColumn("stray", F.col("word").isNull() & ~furniture).withColumns({"received": F.first("received", True).over(whole), "signed": F.first("signed", True).over(whole)})
    # Lines before a row are its description, but for those that filled the buffer before.
    told = told.withColumn("part", F.count("word").over(_by()[1])).withColumn("nth", F.count_if("stray").over(_by("part")[0]))
    size = F.count_if("stray").over(Window.partitionBy("filing_id", "part"))
    whole_buffers = F.floor(size / (MOST_STRAY + 1)) * (MOST_STRAY + 1)
    kept = F.array_sort(F.collect_list(F.when(F.col("stray") & (F.col("nth") > whole_buffers), F.struct("n", "line"))).over(Window.partitionBy("filing_id", "part")))
    return told.withColumns({"before": F.transform(kept, lambda x: x["line"]), "raw_date": F.col("w.raw"), "tx_date": C.us_date(F.col("w.date")), "discarded": F.when(F.col("stray") & (F.col("nth") % (MOST_STRAY + 1) == 0), F.lit(MOST_STRAY + 1))})


def scan_rows(filings: DataFrame) -> DataFrame:
    """Rows of scanned executive forms: a type word, a date, and Yes or No make a row; lines before it are its description."""
    told = _scan_lines(filings).filter("word is not null")
    told = told.withColumn("disclosed_date", F.coalesce("filed_on", "received", "signed")).filter("disclosed_date is not null and tx_date is not null")
    head = tidy(F.concat_ws(" ", F.concat_ws(" ", "before"), F.col("w.head")))
    opening = F.substring_index(head, " ", 1)
    numbered = F.length(opening).between(1, 4) & (F.translate(opening, "0123456789", "") == "") & head.contains(" ")
    asset = F.when(numbered, F.substring(head, F.length(opening) + 2, F.length(head))).otherwise(head)
    rows = told.select("filing_id", "n", asset.alias("asset"), "word", "tx_date", "disclosed_date", amounts.parse(F.col("w.amount")).alias("a"), F.col("w.tail").alias("tail"))
    return _executive(rows, [F.when(F.col("a.kind") == "unknown", F.concat(F.lit("amount not understood: "), "tail")), F.when(F.col("asset") == "", "no description")])


#: A native row: its number (numbers grow from 1) and name, a transaction word, a date (its first slash perhaps lost), Yes or No, an amount; words one space apart.
_MARKS = r"[().,;:\[\]*]*"
_NATIVE_ROW = rf"^(?!0+ )([0-9]{{1,4}}) (\S.*?) {_MARKS}((?i:{'|'.join(TX_WORDS)})){_MARKS} ([0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}|[0-9]{{3,4}}/[0-9]{{2,4}}) {_MARKS}(?i:yes|no){_MARKS} (.+)$"
_CUT = "\x01"  #: between parts; a line has no control characters


def native_rows(filings: DataFrame) -> DataFrame:
    """Rows of native executive forms: numbered lines with growing numbers; a dangling dash takes the figure alone on the next line.

    Lines are told apart inside their text and only rows are exploded, with the line below where the amount may go on there.
    """
    # As words are told apart: a colon ends one, a dollar sign begins one. White space beyond ASCII is rare, and slow to look for.
    gaps = lambda x: F.when(F.length(x) == F.octet_length(x), F.regexp_replace(x, "  +", " ")).otherwise(F.regexp_replace(x, r"(?U)\s\s+|[^\S ]", " "))
    spaced = lambda x: F.trim(gaps(F.replace(F.replace(x, F.lit("$"), F.lit(" $")), F.lit(":"), F.lit(": "))))
    parts = lambda x: F.when(x.contains("/"), F.regexp_replace(spaced(clean(x)), _NATIVE_ROW, F.lit(_CUT.join(["$1", "$2", "$3", "$4", "$5"]))))
    split = filings.select("filing_id", "filed_on", _split(F.coalesce("text", F.lit(""))).alias("lines"))
    below = lambda row, i: F.when(row.rlike(f"{amounts.DASH}$"), clean(F.coalesce(F.get("lines", i + 1), F.lit(""))))
    found = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("n"), parts(x).alias("row"))), lambda r: r["row"].contains(_CUT))
    told = split.select("filing_id", "filed_on", F.inline(F.transform(found, lambda r: F.struct(r["n"].alias("n"), F.split(r["row"], _CUT).alias("w"), below(r["row"], r["n"]).alias("below")))))
    w = lambda i: F.get("w", F.lit(i))
    told = told.select("filing_id", "n", "filed_on", w(0).cast("int").alias("number"), w(1).alias("asset"), w(2).alias("word"), F.when(F.length(w(3)) - F.length(F.replace(w(3), F.lit("/"))) == 2, C.us_date(w(3))).alias("tx_date"), w(4).alias("tail"), "below")
    told = told.filter("tx_date is not null").withColumn("most", F.max("number").over(_by()[1])).filter(F.col("number") > F.coalesce("most", F.lit(0)))
    tail = F.when(F.col("below").rlike(f"^{amounts.FIGURE}$"), F.concat_ws(" ", "tail", "below")).otherwise(F.col("tail"))
    return _executive(told.select("filing_id", "n", "asset", "word", "tx_date", F.col("filed_on").alias("disclosed_date"), amounts.parse(tail).alias("a")), [])


READERS = {"house": house_rows, "scan": scan_rows, "native": native_rows}


def parse_reports(filings: DataFrame, forms: tuple[str, ...] = tuple(READERS)) -> DataFrame:
    """Rows of filings (filing_id, member_id, form: house, scan or native; filed_on, text, recovered_by_ocr). Null or empty text gives no rows.

    forms: those that occur; a reader of none is not planned.
    """
    rows = None
    for form in forms:
        found = READERS[form](filings.filter(F.col("form") == form).select("filing_id", "filed_on", "text"))
        rows = found if rows is None else rows.unionByName(found)
    about = filings.select("filing_id", "member_id", "recovered_by_ocr")
    noted = F.when(F.col("recovered_by_ocr"), F.array_append("warnings", F.lit("recovered by OCR"))).otherwise(F.col("warnings"))
    return rows.join(about, "filing_id").withColumn("warnings", noted).select(*COLUMNS)


def report_warnings(filings: DataFrame) -> DataFrame:
    """filing_id, warning: what was left out of filings, or taken in place of what is missing."""
    only = lambda form: filings.filter(F.col("form") == form).select("filing_id", "filed_on", "text")
    house = _house_tokens(only("house")).filter("is_row and not valid").select("filing_id", F.lit("a row's dates could not be read").alias("warning"))
    scan = _scan_lines(only("scan"))
    undated = F.coalesce("filed_on", "received", "signed").isNull()
    line_notes = F.array(F.when(F.col("word").isNotNull() & ~undated & F.col("tx_date").isNull(), F.concat(F.lit("date not understood: "), "raw_date")), F.when(F.col("discarded").isNotNull(), F.concat(F.col("discarded").cast("string"), F.lit(" lines without a row discarded"))))
    by_line = scan.select("filing_id", F.explode(F.filter(line_notes, lambda x: x.isNotNull())).alias("warning"))
    signed = F.col("filed_on").isNull() & F.col("received").isNull() & F.col("signed").isNotNull()
    by_filing = scan.select("filing_id", F.when(undated, "no received date: rows skipped").when(signed, "dated by the certifying signature, for want of a received date").alias("warning")).distinct().filter("warning is not null")
    return house.unionByName(by_line).unionByName(by_filing)


def filing_status(filings: DataFrame, rows: DataFrame) -> DataFrame:
    """filing_id, source, status: parsed, without_text, or no_rows (text that gave none)."""
    n = rows.groupBy("filing_id").agg(F.count("*").alias("n"))
    status = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "without_text").when(F.coalesce("n", F.lit(0)) > 0, "parsed").otherwise("no_rows")
    return filings.join(n, "filing_id", "left").select("filing_id", F.col("form").alias("source"), status.alias("status"))

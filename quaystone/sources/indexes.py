"""Filing indexes and reference files as DataFrames, in built-in functions alone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaystone.functions import columns as C
from quaystone.functions import names as N

MOST_BYTES = 64 << 20
NBSP = " "


def landed(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """Files of a landing folder (path, length, content), without those above the ceiling."""
    return spark.read.format("binaryFile").load(path).filter(F.col("length") <= most)


def classify_contact(contact: DataFrame) -> DataFrame:
    """outcome, reached, unexpected of (status, bytes, utf8_ok, cache_hit); a null status is an offline source."""
    usable = (F.col("status") == 200) & (F.col("bytes") <= MOST_BYTES) & F.col("utf8_ok")
    reason = F.when(F.col("status").isNull(), "offline").when(F.col("bytes") > MOST_BYTES, "too_large").when((F.col("status") == 200) & ~F.col("utf8_ok"), "undecodable").when(F.col("status") == 304, "no_cache").otherwise("bad_status")
    outcome = F.when(F.coalesce(usable, F.lit(False)), "fresh").when((F.col("status") == 304) & F.col("cache_hit"), "not_modified").when(F.col("cache_hit"), "served_from_cache").otherwise("failed")
    fine = outcome.isin("fresh", "not_modified")
    return contact.withColumns({"outcome": outcome, "reason": F.when(~fine, reason), "reached": fine, "unexpected": ~fine & F.col("status").isNotNull()})


def year_window(index: DataFrame, year: int) -> DataFrame:
    return index.filter(F.col("year").between(year - 1, year))


def clerk_index(lines: DataFrame, fallback_year: int) -> DataFrame:
    """Tab-separated index: lines (value), header line included. Rows with fewer than nine fields go."""
    text = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r$", "")
    f = F.split(text, "\t")
    cell = lambda i: F.trim(F.get(f, F.lit(i)))
    rows = lines.filter((F.trim(text) != "") & (F.size(f) >= 9) & ~((cell(1) == "Last") & (cell(8) == "DocID")))
    full = F.regexp_replace(F.trim(F.concat_ws(" ", cell(2), cell(1), cell(3))), " +", " ")
    state = F.substring(cell(5), 1, 2)
    return rows.select(
        cell(1).alias("last"), cell(2).alias("first"), cell(3).alias("suffix"), cell(4).alias("filing_type"), state.alias("state"), F.substring(cell(5), 3, 10).alias("district"),
        F.coalesce(cell(6).try_cast("int"), F.lit(fallback_year)).alias("year"), C.us_date(cell(7)).alias("filed_on"), cell(8).alias("filing_id"), full.alias("full_name"), (cell(4) == "P").alias("is_ptr"),
    )


_SEARCH = "struct<draw:int,recordsTotal:int,recordsFiltered:int,data:array<array<string>>>"


def senate_index(pages: DataFrame) -> DataFrame:
    """Search result pages (value: JSON) to filings; rows without a report link of a known kind go."""
    cell = lambda i: F.get("r", F.lit(i))
    rows = pages.select(F.explode(F.from_json("value", _SEARCH)["data"]).alias("r")).filter(F.size("r") >= 5)
    link = cell(3)
    kind = F.regexp_extract(link, r"/view/(ptr|paper)/([0-9a-fA-F-]{36})/", 1)
    return rows.select(
        F.trim(cell(0)).alias("first"), F.trim(cell(1)).alias("last"), F.trim(cell(2)).alias("display"), kind.alias("kind"), F.lower(F.regexp_extract(link, r"/view/(ptr|paper)/([0-9a-fA-F-]{36})/", 2)).alias("filing_id"),
        F.lower(link).contains("amendment").alias("is_amendment"), C.us_date(cell(4)).alias("filed_on"),
    ).filter(F.col("filing_id") != "")


PAGE = 100  #: rows of a full search page


def search_pages(pages: DataFrame, size: int = PAGE) -> DataFrame:
    """Landed pages (offset, value: JSON) up to the first short or empty one, in which a search ends; what lies beyond is of another search.

    A page that is missing before that, or a search without an end, fails the query: an index with a hole must not pass for a whole one.
    """
    counted = pages.withColumn("_n", F.coalesce(F.size(F.from_json("value", _SEARCH)["data"]), F.lit(-1))).withColumn("_n", F.greatest("_n", F.lit(0)))
    end = counted.filter(F.col("_n") < size).agg(F.min("offset").alias("_end"))
    used = counted.join(F.broadcast(end), F.col("_end").isNull() | (F.col("offset") <= F.col("_end")))  # with one row
    held = used.agg(F.count_distinct("offset").alias("_held"), F.max("_end").alias("_e"))
    whole = F.coalesce(F.col("_held") * size == F.col("_e") + size, F.lit(False))
    sure = F.when(whole, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("search pages with a gap or without an end: "), F.col("_held").cast("string"), F.lit(" pages up to offset "), F.coalesce(F.col("_e").cast("string"), F.lit("?")))))
    return used.join(F.broadcast(held), F.lit(True)).filter(sure).select(*pages.columns)


def strip_html(x: Column) -> Column:
    """Text of a cell: tags gone, the usual references decoded, white space folded."""
    text = F.when(x.contains("<"), F.regexp_replace(x, "(?s)<[^>]*>", " ")).otherwise(x)
    decoded = text
    for ref, char in (("&nbsp;", " "), ("&#160;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        decoded = F.replace(decoded, F.lit(ref), F.lit(char))
    return F.trim(F.regexp_replace(F.replace(F.when(x.contains("&"), decoded).otherwise(text), F.lit(NBSP), F.lit(" ")), r"\s+", " "))


def html_rows(pages: DataFrame, id_column: str = "filing_id", table: str = r"(?s)<table[^>]*table-striped[^>]*>.*?</table>") -> DataFrame:
    """Rows of the first matching table of each page: id, row, raw cells."""
    body = F.regexp_extract(F.col("html"), f"({table})", 1)
    body = F.regexp_extract(body, r"(?s)<tbody[^>]*>(.*?)</tbody>", 1)
    rows = pages.select(F.col(id_column), *[c for c in ("filed_on", "is_amendment") if c in pages.columns], F.posexplode(F.regexp_extract_all(body, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "tr"))
    return rows.withColumn("cells", F.regexp_extract_all("tr", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1))).drop("tr")


def senate_report(pages: DataFrame) -> DataFrame:
    """Transactions of electronic reports (filing_id, html, filed_on): eight cells a row."""
    cell = lambda i: F.get("cells", F.lit(i))
    owner, kind, tx = F.lower(cell(2)), F.lower(cell(5)), F.lower(cell(6))
    symbols = F.filter(F.split(F.replace(cell(3), F.lit("--"), F.lit(" ")), r"\s+"), lambda x: x.rlike(r"^[A-Z][A-Z0-9.\-]{0,6}$"))
    label = r"(?i)\s*\b(?:Company|Description):"
    name = F.trim(F.regexp_extract(cell(4), rf"^(.*?)(?:{label}|$)", 1))
    inline = F.trim(F.regexp_extract(cell(4), r"(?i)\bDescription:\s*(.*)$", 1))
    parts = F.filter(F.array(inline, cell(8)), lambda x: x.isNotNull() & ~x.isin("", "--"))
    asset_type = (
        F.when(kind.contains("non-public") | kind.contains("nonpublic"), "PS").when(kind.contains("option"), "OP").when(kind.contains("municipal"), "GS").when(kind.contains("corporate bond"), "CS").when(kind.contains("crypto"), "CT")
        .when(kind.contains("etf") | kind.contains("exchange traded"), "EF").when(kind.contains("mutual fund"), "MF").when(kind.contains("stock"), "ST")
    )
    tx_type = F.when(tx.contains("purchase"), "buy").when(tx.contains("exchange"), "exchange").when(tx.contains("partial"), "partial_sell").when(tx.contains("sale"), "sell").otherwise("buy")
    date = C.us_date(cell(1))
    # Texts of cells are made once a cell, before they are asked for by name.
    stripped = html_rows(pages).filter(F.size("cells") >= 8).withColumn("cells", F.transform("cells", strip_html))
    return stripped.select(
        "filing_id", F.col("row").cast("long").alias("position"), date.alias("tx_date"), F.coalesce("filed_on", date).alias("disclosed_date"),
        F.when(owner.contains("spouse"), "spouse").when(owner.contains("joint"), "joint").when(owner.contains("dependent") | owner.contains("child"), "dependent").otherwise("self").alias("owner"),
        F.get(symbols, F.lit(0)).alias("ticker"), name.alias("asset"), asset_type.alias("asset_type"), tx_type.alias("tx_type"), cell(7).alias("amount_text"), F.nullif(F.array_join(parts, " "), F.lit("")).alias("filing_description"),
    ).withColumn("warning", F.when(F.col("tx_date").isNull(), "row skipped: date not understood"))


def paper_images(pages: DataFrame) -> DataFrame:
    """Page images of paper reports, in order, each once."""
    tags = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)<img\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"""(?i)class\s*=\s*["'][^"']*filingImage"""))
    sources = F.array_distinct(F.transform(tags, lambda t: F.replace(F.regexp_extract(t, r"""(?i)src\s*=\s*["']([^"']*)["']""", 1), F.lit("&amp;"), F.lit("&"))))
    return pages.select("filing_id", F.posexplode(sources).alias("position", "url"))


def link_index(pages: DataFrame, filer: str) -> DataFrame:
    """Links to PDF files whose text matches a filer: url, text, dated, is_amendment, rank (newest first, undated last)."""
    anchors = F.regexp_extract_all("html", F.lit(r"""(?is)<a\b[^>]*href\s*=\s*["'][^"']*\.pdf["'][^>]*>.*?</a>"""), F.lit(0))
    links = pages.select(F.posexplode(anchors).alias("position", "a")).select("position", F.replace(F.regexp_extract("a", r"""(?i)href\s*=\s*["']([^"']*)["']""", 1), F.lit("&amp;"), F.lit("&")).alias("url"), strip_html(F.col("a")).alias("text"))
    wanted = links.filter(F.col("text").rlike(f"(?i){filer}"))
    once = wanted.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("position"))).filter("_n = 1").drop("_n")
    tokens = F.regexp_extract_all("text", F.lit(r"\b(\d{1,2}\.\d{1,2}\.\d{2,4})\b"), F.lit(1))
    last = F.replace(F.get(tokens, F.size(tokens) - 1), F.lit("."), F.lit("/"))
    dated = once.withColumns({"dated": F.when(F.size(tokens) > 0, C.us_date(last)), "is_amendment": F.lower("text").contains("amend")})
    return dated.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("dated"), "text")).cast("long")).drop("position")


_OGE = "struct<recordsTotal:int,data:array<struct<type:string,name:string,agency:string,title:string,docDate:string>>>"


def agency_index(responses: DataFrame) -> DataFrame:
    """Records of an agency API (value: JSON) that link a PDF."""
    r = responses.select(F.explode(F.from_json("value", _OGE)["data"]).alias("r")).select("r.*")
    url = F.regexp_extract("type", r"""(?i)href\s*=\s*["']?([^"'\s>]+\.pdf)""", 1)
    return r.select(strip_html(F.col("type")).alias("kind"), N.last_first(F.col("name")).alias("name"), "agency", "title", C.iso_date(F.substring("docDate", 1, 10)).alias("filed_on"), url.alias("url")).filter(F.col("url") != "")


#: Names of the fifteen executive departments.
DEPARTMENTS = ("state", "treasury", "defense", "justice", "interior", "agriculture", "commerce", "labor", "health and human services", "housing and urban development", "transportation", "energy", "education", "veterans affairs", "homeland security")


def cabinet(index: DataFrame) -> DataFrame:
    """Heads of departments: the title begins with the office."""
    agency, title = F.lower("agency"), F.lower(F.trim("title"))
    known = agency.rlike("|".join(DEPARTMENTS))
    return index.filter(agency.contains("department of") & known & (title.startswith("secretary") | title.startswith("attorney general")))


_LEGISLATORS = "array<struct<id:struct<bioguide:string>,name:struct<first:string,last:string,nickname:string,official_full:string>,terms:array<struct<type:string,state:string,district:int,end:string,party:string>>>>"


def crosswalk(files: DataFrame) -> DataFrame:
    """Seats of legislators (value: JSON): one row a person, state, chamber and district; party of the latest term."""
    p = files.select(F.explode(F.from_json("value", _LEGISLATORS)).alias("p")).select("p.*")
    first = F.col("name.first")
    official = F.split("name.official_full", " ")[0]
    nickname = F.coalesce("name.nickname", F.when(official != first, official))
    end = lambda t: F.coalesce(F.substring(t["end"], 1, 4).try_cast("int"), F.lit(9999))
    base = p.select(F.col("id.bioguide").alias("bioguide"), F.col("name.last").alias("last"), first.alias("first"), nickname.alias("nickname"), F.explode("terms").alias("t"))
    told = base.select("bioguide", "last", "first", "nickname", F.col("t.state").alias("state"), F.when(F.col("t.type") == "sen", "senate").otherwise("house").alias("chamber"), F.col("t.district").alias("district"), end(F.col("t")).alias("ends"), F.col("t.party").alias("party"))
    person = Window.partitionBy("bioguide")
    told = told.withColumns({"last_term_end_year": F.max("ends").over(person), "party": C.party(F.max_by("party", "ends").over(person))})
    return told.drop("ends").dropDuplicates(["bioguide", "state", "chamber", "district"])


def roster(committees: DataFrame, membership: DataFrame) -> DataFrame:
    """Committee names of each member. committees: (thomas_id, name); membership: (key, bioguide). Subcommittee keys and blank ids go."""
    known = committees.filter(F.coalesce("thomas_id", F.lit("")) != "").select(F.col("thomas_id").alias("key"), "name")
    return membership.filter(F.coalesce("bioguide", F.lit("")) != "").join(known, "key").groupBy("bioguide").agg(F.sort_array(F.collect_set("name")).alias("committees"))


def membership_json(files: DataFrame) -> DataFrame:
    """(key, bioguide) of a JSON map of committee keys to members."""
    kind = "map<string,array<struct<name:string,party:string,rank:int,title:string,bioguide:string>>>"
    return files.select(F.explode(F.from_json("value", kind)).alias("key", "m")).select("key", F.explode("m").alias("m")).select("key", "m.bioguide")


def newest_feed(feeds: DataFrame, version: int = 2) -> DataFrame:
    """Of feed headers the newest with the right schema version."""
    return feeds.filter(F.col("schemaVersion") == version).orderBy(F.desc("generatedAt")).limit(1)


FRESH_DAYS = 7


def last_modified(spark: SparkSession, path: str) -> dt.datetime | None:
    """When the newest file of a path was written; None where there is no file, or only empty ones."""
    from pyspark.errors import AnalysisException

    try:
        files = spark.read.format("binaryFile").load(path)
        return files.filter(F.col("length") > 0).agg(F.max("_metadata.file_modification_time").alias("t")).first().t
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def tiered(spark: SparkSession, cache: str, primary: str, mirror: str, now: dt.datetime, days: int = FRESH_DAYS, bundled: str | None = None) -> tuple[str, str] | None:
    """(tier, path) of a reference file: the cache while it is fresh, else primary, mirror, the stale cache, what is bundled; None if there is none.

    Freshness is told by when the files were written, of which only the time comes to the driver.
    """
    cached = last_modified(spark, cache)
    if cached is not None and now - cached <= dt.timedelta(days=days):
        return "fresh", cache
    for tier, path in (("primary", primary), ("mirror", mirror)):
        if last_modified(spark, path) is not None:
            return tier, path
    if cached is not None:
        return "stale", cache
    return ("bundled", bundled) if bundled is not None and last_modified(spark, bundled) is not None else None


def ocr_lines(fragments: DataFrame, tolerance: float = 0.011) -> DataFrame:
    """Lines of pages from text fragments (filing_id, page, min_x, mid_y, text): bands from the top, fragments from the left.

    A band begins where a fragment is `tolerance` or more below the band's first: a running decision over a page's sorted
    fragments, which pass by one after another and are not held.
    """

    def banded(batches):
        page = first = None
        band = -1
        for batch in batches:
            out = []
            for key, y in zip(zip(batch["filing_id"], batch["page"], strict=True), batch["mid_y"], strict=True):
                if key != page:
                    page, first, band = key, None, -1
                if first is None or first - y >= tolerance:
                    first, band = y, band + 1
                out.append(band)
            yield batch.assign(band=out)

    by = ["filing_id", "page"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fragments.select(*by, "min_x", "mid_y", "text").schema)
    ordered = fragments.select(*by, "min_x", "mid_y", "text").filter("mid_y is not null").repartition(*by).sortWithinPartitions(*by, F.desc("mid_y"), "min_x", "text")
    lines = ordered.mapInPandas(banded, f"{kinds}, band int").groupBy(*by, "band").agg(F.array_sort(F.collect_list(F.struct(F.col("min_x").alias("x"), "text"))).alias("w"))
    return lines.select(*by, F.col("band").alias("line_no"), F.array_join(F.transform("w", lambda x: x["text"]), "  ").alias("line"))

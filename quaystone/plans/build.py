"""The batch build: indexes and report texts of every source to one feed.

Sources degrade, they do not abort: a filing without text or rows gets a status and the rest goes
on. Filters on filings come before their texts are read, since a reader is a barrier to pushdown.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaystone.functions import amounts, ids
from quaystone.operators import feed, identity
from quaystone.plans.tables import cut
from quaystone.sources import indexes, reports

#: Order of sources; of equal rows the earlier source's stays.
PRIORITY = {"house": 0, "senate": 1, "white_house": 2, "cabinet": 3}
TRADE = list(reports.COLUMNS)


def recover_text(files: DataFrame, extract=None, recognise=None) -> DataFrame:
    """filing_id, text, recovered_by_ocr of (filing_id, content): the text layer if it says anything, else recognition.

    extract and recognise take bytes and return text; without them a filing has no text.
    """

    def run(batches):
        for batch in batches:
            texts, seen = [], []
            for content in batch["content"]:
                text = extract(content) if extract and content is not None else None
                by_ocr = not (text or "").strip() and recognise is not None and content is not None
                texts.append(recognise(content) if by_ocr else text)
                seen.append(bool(by_ocr))
            batch = batch[["filing_id"]].copy()
            batch["text"], batch["recovered_by_ocr"] = texts, seen
            yield batch

    return files.select("filing_id", "content").mapInPandas(run, "filing_id string, text string, recovered_by_ocr boolean")


@dataclass
class Feed:
    trades: DataFrame
    status: DataFrame


def _noted(status: DataFrame, told: DataFrame) -> DataFrame:
    """status with warnings, sorted: what was left out of each filing. told: filing_id, warning."""
    by_filing = told.groupBy("filing_id").agg(F.sort_array(F.collect_set("warning")).alias("warnings"))
    return status.join(by_filing, "filing_id", "left").select("filing_id", "source", "status", F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))


def _sourced(rows: DataFrame, source: str) -> DataFrame:
    return rows.select(*TRADE, F.lit(source).alias("source"))


def house(index: DataFrame, texts: DataFrame, crosswalk: DataFrame, known: DataFrame, status: DataFrame | None = None) -> Feed:
    """Transaction reports of the clerk's index. known: full_name, member_id; status: filings already processed."""
    wanted = index.filter("is_ptr")
    if status is not None:
        wanted = wanted.join(status.select("filing_id"), "filing_id", "left_anti")
    member = identity.member_ids(wanted, known, identity.resolve(wanted, crosswalk))
    filings = wanted.join(member, "filing_id").join(texts, "filing_id", "left").withColumn("form", F.lit("house")).withColumn("recovered_by_ocr", F.coalesce("recovered_by_ocr", F.lit(False)))
    rows = cut(reports.parse_reports(filings, ("house",)), "house-rows")  # read twice below, parsed once
    return Feed(_sourced(rows, "house"), _noted(reports.filing_status(filings, rows), reports.report_warnings(filings)))


def senate(index: DataFrame, pages: DataFrame, members: DataFrame) -> Feed:
    """Electronic reports; paper ones have no text. members: filing_id, member_id. Rows without a date are left out, and the filing's status says so."""
    electronic = index.filter("kind = 'ptr'")
    rows = indexes.senate_report(pages.join(electronic.select("filing_id", "filed_on", "is_amendment"), "filing_id"))
    a = amounts.parse(F.col("amount_text"))
    told = rows.filter("tx_date is not null").join(members, "filing_id", "left").join(electronic.select("filing_id", "is_amendment"), "filing_id").select(
        "filing_id", F.col("position").cast("int").alias("position"), "member_id", "owner", "asset", "ticker", "asset_type", "tx_type", "tx_date", "disclosed_date", a["kind"].alias("amount_kind"), a["low_cents"].alias("low_cents"), a["high_cents"].alias("high_cents"),
        "filing_description", F.array().cast("array<string>").alias("warnings"), "is_amendment",
    )
    n = rows.groupBy("filing_id").agg(F.count("*").alias("n"))
    status = index.join(n, "filing_id", "left").select("filing_id", F.lit("senate").alias("source"), F.when(F.col("kind") == "paper", "without_text").when(F.col("n") > 0, "parsed").otherwise("no_rows").alias("status"))
    undated = rows.filter("tx_date is null").groupBy("filing_id").agg(F.count("*").alias("n"))
    return Feed(_sourced(told, "senate"), _noted(status, undated.select("filing_id", F.concat(F.col("n").cast("string"), F.lit(" rows without a date left out")).alias("warning"))))


def executive(filings: DataFrame, source: str) -> Feed:
    """Executive forms (filing_id, name, form, filed_on, text, recovered_by_ocr, is_amendment); amendments are not read, and cabinet filings need a date."""
    from quaystone.functions import names

    readable = filings.filter(~F.col("is_amendment"))
    if source == "cabinet":
        readable = readable.filter("filed_on is not null")
    rows = reports.parse_reports(readable.withColumn("member_id", names.fallback_id(F.col("name"))), ("scan", "native"))
    rows = cut(rows, "executive-rows")
    done = reports.filing_status(readable, rows).withColumn("source", F.lit(source))
    left = filings.join(readable.select("filing_id"), "filing_id", "left_anti").select("filing_id", F.lit(source).alias("source"), F.when(F.col("is_amendment"), "without_text").otherwise("failed").alias("status"))
    return Feed(_sourced(rows, source), _noted(done.unionByName(left), reports.report_warnings(readable)))


def assemble(*sources: Feed) -> Feed:
    """Sources in order of priority: stable ids, then one row a member and fingerprint; statuses accumulate."""
    trades, status = sources[0].trades, sources[0].status
    for s in sources[1:]:
        trades, status = trades.unionByName(s.trades), status.unionByName(s.status)
    rank = F.lit(len(PRIORITY))
    for name, i in PRIORITY.items():
        rank = F.when(F.col("source") == name, i).otherwise(rank)
    numbered = ids.stable_ids(trades.withColumn("priority", rank))
    kept = feed.deduplicate(numbered, [F.col("priority"), F.col("filing_id"), F.col("position")])
    return Feed(kept.drop("priority"), status)


def coverage(status: DataFrame) -> DataFrame:
    """source, processed, unreadable, percent_unreadable, and up to 25 ids that gave no rows, for the log."""
    nth = F.row_number().over(Window.partitionBy("source", "status").orderBy("filing_id"))
    listed = status.withColumn("_n", nth)
    bad = F.col("status").isin("without_text", "failed")
    return listed.groupBy("source").agg(
        F.count("*").alias("processed"), F.count_if(bad).alias("unreadable"), F.round(F.avg(bad.cast("double")) * 100).cast("long").alias("percent_unreadable"), F.sort_array(F.collect_list(F.when((F.col("status") == "no_rows") & (F.col("_n") <= 25), F.col("filing_id")))).alias("no_rows")
    )

"""Queries over executive forms, the assembled feed, and ids of filers; their texts are made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaystone.functions import columns as C
from quaystone.operators import identity, stats
from quaystone.plans import build
from quaystone.plans.catalogue import _ALIKE, _EXACT, _FP, _ONE, _PEOPLE, _people, on_trades, query
from quaystone.sources import reports, testdata

_ROWS = """WITH r AS (SELECT l_orderkey, l_partkey AS p, CAST(o_orderdate AS DATE) AS tx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nth FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT CAST(l_orderkey AS VARCHAR) AS filing_id, nth - 1 AS position, {asset} AS asset, CASE p % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' ELSE 'exchange' END AS tx_type, tx AS tx_date, tx + 3 AS disclosed_date,
      CASE WHEN p % 7 = 0 THEN 'atLeast' WHEN p % 11 = 0 THEN 'unknown' ELSE 'range' END AS amount_kind, CAST(CASE WHEN p % 7 = 0 OR p % 11 > 0 THEN p + 1000 ELSE 0 END AS BIGINT) * 100 AS low_cents, CAST(CASE WHEN p % 7 = 0 THEN p + 1000 WHEN p % 11 > 0 THEN p + 6000 ELSE 0 END AS BIGINT) * 100 AS high_cents FROM r"""
_SHOWN = ["filing_id", "cast(position as bigint) as position", "asset", "tx_type", "tx_date", "disclosed_date", "amount_kind", "low_cents", "high_cents"]


def _texts(spark: SparkSession, d: str, head, row, filed: bool) -> DataFrame:
    """A form for each order, with a row for each of its lines; row: of the line's number on the form.

    Orders and lines meet by the text of their key, which is the filing's id, so that the forms lie where their rows are put together.
    """
    of = lambda key: F.col(key).cast("string").alias("filing_id")
    line = testdata.read(spark, d, "lineitem").select(of("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    orders = testdata.read(spark, d, "orders").select(of("o_orderkey"), F.to_date("o_orderdate").alias("tx"))
    items = line.join(orders, "filing_id").groupBy("filing_id", "tx").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("items"))
    body = F.array_join(F.transform("items", lambda x, i: row(i + 1, x["l_partkey"])), "\n")
    return items.select("filing_id", F.when(F.lit(filed), F.date_add("tx", 3)).alias("filed_on"), F.concat(head, F.lit("\n"), body).alias("text"))


def _word(p):
    return F.when(p % 3 == 0, "Purchase").when(p % 3 == 1, "SALE").otherwise("exchange")


def _money(n, mark: str, thousands: str):
    return F.concat(F.lit(mark), F.replace(F.format_number(n, 0), F.lit(","), F.lit(thousands)))


@query("scanned_form", _ROWS.format(asset="'Firm of ' || p || CASE WHEN p % 2 = 0 THEN ' and Sons' ELSE '' END"), cte=False)
def _scanned(spark, d):
    """Numbered rows whose names go over two lines; some dates have lost a slash, and some figures their dollar sign and comma."""

    def row(i, p):
        date = F.when(p % 4 == 1, F.date_format("tx", "Mdd/yyyy")).otherwise(F.date_format("tx", "M/d/yyyy"))
        plain = F.concat(_money(p + 1000, "$", ","), F.lit(" - "), _money(p + 6000, "$", ","))
        read = F.concat(_money(p + 1000, "S", "."), F.lit(" - "), _money(p + 6000, "S", "."))
        tail = F.when(p % 7 == 0, F.concat(F.lit("over "), _money(p + 1000, "$", ","))).when(p % 11 == 0, "smudge").when(p % 5 == 0, read).otherwise(plain)
        return F.concat(i.cast("string"), F.lit(" Firm of "), p.cast("string"), F.when(p % 2 == 0, "\nand Sons ").otherwise(" "), _word(p), F.lit(" "), date, F.lit(" No "), tail)

    head = F.concat(F.lit("OGE Received: "), F.date_format(F.date_add("tx", 3), "M/d/yyyy"), F.lit("\nFiler's Information\nPage 1 of 3"))
    return reports.scan_rows(_texts(spark, d, head, row, False)).selectExpr(*_SHOWN)


@query("native_form", _ROWS.format(asset="'Firm of ' || p"), cte=False)
def _native(spark, d):
    """Numbered rows on one line; some amounts go on below, and a line of an earlier number is no row."""

    def row(i, p):
        wrapped = F.concat(_money(p + 1000, "$", ","), F.when(p % 2 == 0, " -\n").otherwise(" - "), _money(p + 6000, "$", ","))
        tail = F.when(p % 7 == 0, F.concat(_money(p + 1000, "$", ","), F.lit(" +"))).when(p % 11 == 0, "smudge").otherwise(wrapped)
        return F.concat(i.cast("string"), F.lit(" Firm of  "), p.cast("string"), F.lit(" "), _word(p), F.lit(" "), F.date_format("tx", "M/d/yyyy"), F.lit(" Yes "), tail, F.lit("\n0 Again  "), _word(p), F.lit(" 1/1/1999 No $5"))

    return reports.native_rows(_texts(spark, d, F.lit("Periodic report"), row, True)).selectExpr(*_SHOWN)


@query(
    "assembled_feed",
    f"""WITH t AS (SELECT *, CAST(filing_id AS BIGINT) % 4 AS priority, row_number() OVER (PARTITION BY filing_id ORDER BY id) - 1 AS position FROM feed)
    SELECT CASE priority WHEN 0 THEN 'house' WHEN 1 THEN 'senate' WHEN 2 THEN 'white_house' ELSE 'cabinet' END AS source, filing_id, position FROM t QUALIFY row_number() OVER (PARTITION BY member_id, {_FP} ORDER BY priority, filing_id, position) = 1""",
)
def _assembled(spark, d):
    """All sources to one feed: of equal rows the earlier source's stays, whatever the order in which sources come."""
    position = F.row_number().over(Window.partitionBy("filing_id").orderBy("id")) - 1
    t = testdata.trades(spark, d).withColumns({"position": position, "filing_description": F.lit(None).cast("string"), "warnings": F.filter(F.array("warning"), lambda x: x.isNotNull())})
    feeds = []
    for source, i in reversed(build.PRIORITY.items()):
        own = t.filter(F.col("filing_id").cast("bigint") % 4 == i)
        status = own.select("filing_id", F.lit(source).alias("source"), F.lit("parsed").alias("status"), F.array().cast("array<string>").alias("warnings")).distinct()
        feeds.append(build.Feed(own.select(*build.TRADE, F.lit(source).alias("source")), status))
    return build.assemble(*feeds).trades.select("source", "filing_id", F.col("position").cast("long").alias("position"))


on_trades(
    "warning_counts",
    """WITH w AS (SELECT warning FROM feed UNION ALL SELECT 'dates contradict' FROM feed WHERE impossible UNION ALL SELECT 'amount not read' FROM feed WHERE amount_kind = 'unknown')
    SELECT warning, count(*) AS n FROM w WHERE warning IS NOT NULL GROUP BY warning""",
)(lambda t: stats.warning_counts(t.withColumn("warnings", F.filter(F.array("warning", F.when(C.impossible(), "dates contradict"), F.when(F.col("amount_kind") == "unknown", "amount not read")), lambda x: x.isNotNull()))))


@query(
    "member_ids_resolved",
    f"""WITH {_PEOPLE}, c AS (SELECT filing_id, {_ONE.format(_EXACT)} AS t1, count(DISTINCT bioguide) FILTER (WHERE {_EXACT}) AS exact, {_ONE.format('true')} AS t2, {_ONE.format(_ALIKE)} AS t3
      FROM f JOIN x ON x.state = f.state AND x.last = f.last GROUP BY filing_id)
    SELECT f.filing_id, CASE WHEN CAST(f.filing_id AS BIGINT) % 4 = 0 THEN 'K' || f.filing_id ELSE coalesce(t1, CASE WHEN exact < 2 THEN coalesce(t2, t3) END, 'x-' || f.last || '-' || replace(f.first, ' ', '-') || '-n') END AS member_id FROM f LEFT JOIN c ON c.filing_id = f.filing_id""",
    cte=False,
)
def _ids_resolved(spark, d):
    x, filed = _people(spark, d)
    named = filed.withColumn("full_name", F.concat_ws(" ", "first", "last", "filing_id"))
    known = named.filter("cast(filing_id as bigint) % 4 = 0").select("full_name", F.concat(F.lit("K"), "filing_id").alias("member_id"))
    return identity.member_ids(named, known, identity.resolve(filed, x))

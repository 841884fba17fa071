"""The trade, member and committee tables as a deterministic view of TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Floors of the disclosure brackets in dollars.
LADDER = [1_001, 15_001, 50_001, 100_001, 250_001, 500_001, 1_000_001, 5_000_001, 25_000_001, 50_000_001]
_TYPES = {"STANDARD": "ST", "SMALL": "OP", "MEDIUM": "MF", "LARGE": "EF", "ECONOMY": "GS"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _low(value: Column) -> Column:
    out = F.lit(LADDER[0])
    for floor in LADDER[1:]:
        out = F.when(value >= floor, F.lit(floor)).otherwise(out)
    return out.cast("long") * 100


def _high(low: Column) -> Column:
    out = F.lit((LADDER[-1] + LADDER[-1] - 2) * 100).cast("long")
    for floor, above in reversed(list(zip(LADDER, LADDER[1:], strict=False))):
        out = F.when(low == floor * 100, F.lit((above - 1) * 100).cast("long")).otherwise(out)
    return out


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines meet their parts first and are narrowed there, orders their customers; so lines are exchanged twice, and wide rows never."""
    line, order, cust, part, nation = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part", "nation"))
    c, p = F.col("c_custkey"), F.col("l_partkey")
    seg, prio, rf, ls = F.col("c_mktsegment"), F.substring("o_orderpriority", 1, 1), F.col("l_returnflag"), F.col("l_linestatus")
    first = F.split("p_type", " ")[0]
    kind_type = F.lit(None).cast("string")
    for name, code in _TYPES.items():
        kind_type = F.when(first == name, code).otherwise(kind_type)
    lines = line.join(part, line.l_partkey == part.p_partkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("p_name").alias("name"), kind_type.alias("kind_type"),
        F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("BR"), F.regexp_extract("p_brand", "([0-9]+)$", 1), F.substring("p_type", 1, 2))).alias("ticker"),
        F.when(rf == "N", "buy").when((rf == "A") & (ls == "F"), "sell").when((rf == "R") & (ls == "F"), "partial_sell").otherwise("exchange").alias("tx_type"),
        F.to_date("l_shipdate").alias("shipped"), _low(F.col("l_extendedprice") * F.col("l_quantity") * 2).alias("low"),
    )
    filed = order.filter(~((F.col("o_custkey") % 7 == 0) & (F.col("o_orderkey") % 16 != 0)))
    filed = filed.join(cust, filed.o_custkey == cust.c_custkey).join(nation, cust.c_nationkey == nation.n_nationkey).select(
        "o_orderkey", "c_custkey", F.col("c_name").alias("member_name"), F.col("n_name").alias("state"), F.when(seg == "BUILDING", "senate").when(seg == "FURNITURE", "executive").otherwise("house").alias("chamber"),
        F.when(c % 10 == 0, "spouse").when(prio == "1", "spouse").when(prio == "2", "joint").when(prio == "3", "dependent").otherwise("self").alias("owner"), F.to_date("o_orderdate").alias("tx_date"),
    )
    burst = (c % 13 == 0) & (F.col("l_linenumber") <= 2)
    low, unknown, at_least = F.col("low"), p % 97 == 0, F.col("l_suppkey") % 20 == 0
    base = lines.join(filed, lines.l_orderkey == filed.o_orderkey).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("l_orderkey").cast("string").alias("filing_id"), F.concat(F.lit("C"), c.cast("string")).alias("member_id"), "member_name", "state", "chamber", "owner", "name", "ticker",
        F.when((c % 11 == 0) & (p % 10 != 0), "MF").otherwise(F.col("kind_type")).alias("asset_type"), "tx_type", "tx_date",
        F.when(burst, F.date_sub(F.lit("2001-11-04").cast("date"), (p % 30).cast("int"))).otherwise(F.col("shipped")).alias("disclosed_date"),
        F.when(unknown, "unknown").when(at_least, "atLeast").otherwise("range").alias("amount_kind"),
        F.when(unknown, F.lit(0)).otherwise(low).cast("long").alias("low_cents"),
        F.when(unknown, F.lit(0)).when(at_least, low).otherwise(_high(low)).cast("long").alias("high_cents"),
        (F.col("l_orderkey") % 9 == 0).alias("is_amendment"),
        F.when(F.col("l_orderkey") % 5 == 0, "recovered by OCR").alias("warning"),
    )
    suffix = F.concat(F.coalesce(F.concat(F.lit(" ("), "ticker", F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(" ["), "asset_type", F.lit("]")), F.lit("")))
    return base.withColumn("asset", F.concat("name", suffix)).drop("name")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust, nation = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    seg = F.col("c_mktsegment")
    return cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey).select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("state"),
        F.when(seg == "BUILDING", "senate").when(seg == "FURNITURE", "executive").otherwise("house").alias("chamber"),
        F.when(F.col("c_custkey") % 3 != 0, F.array("c_mktsegment", "n_name")).otherwise(F.array().cast("array<string>")).alias("committees"),
        F.when(F.col("c_custkey") % 4 == 0, "democrat").when(F.col("c_custkey") % 4 == 1, "republican").when(F.col("c_custkey") % 4 == 2, "independent").otherwise("unknown").alias("party"),
    )


_LADDER_SQL = "CASE " + " ".join(f"WHEN v >= {x} THEN {x}" for x in reversed(LADDER)) + f" ELSE {LADDER[0]} END"
_HIGH_SQL = "CASE low " + " ".join(f"WHEN {a} THEN {b - 1}" for a, b in zip(LADDER, LADDER[1:], strict=False)) + f" ELSE {LADDER[-1] + LADDER[-1] - 2} END"

#: The same views in SQL, for the queries' counterparts.
CTE = f"""
base AS (
  SELECT *, CASE WHEN p_size % 5 <> 0 THEN 'BR' || regexp_extract(p_brand, '([0-9]+)$', 1) || substr(p_type, 1, 2) END AS ticker0,
    CASE WHEN c_custkey % 11 = 0 AND l_partkey % 10 <> 0 THEN 'MF' ELSE CASE split_part(p_type, ' ', 1) WHEN 'STANDARD' THEN 'ST' WHEN 'SMALL' THEN 'OP' WHEN 'MEDIUM' THEN 'MF' WHEN 'LARGE' THEN 'EF' WHEN 'ECONOMY' THEN 'GS' END END AS type0,
    l_extendedprice * l_quantity * 2 AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN nation ON c_nationkey = n_nationkey
  WHERE NOT (c_custkey % 7 = 0 AND l_orderkey % 16 <> 0)),
laddered AS (SELECT *, {_LADDER_SQL} AS low FROM base),
trade AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, CAST(l_orderkey AS VARCHAR) AS filing_id, 'C' || c_custkey AS member_id, c_name AS member_name, n_name AS state,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'senate' WHEN 'FURNITURE' THEN 'executive' ELSE 'house' END AS chamber,
    CASE WHEN c_custkey % 10 = 0 THEN 'spouse' ELSE CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'spouse' WHEN '2' THEN 'joint' WHEN '3' THEN 'dependent' ELSE 'self' END END AS owner,
    p_name || coalesce(' (' || ticker0 || ')', '') || coalesce(' [' || type0 || ']', '') AS asset, ticker0 AS ticker, type0 AS asset_type,
    CASE WHEN l_returnflag = 'N' THEN 'buy' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'sell' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'partial_sell' ELSE 'exchange' END AS tx_type,
    CAST(o_orderdate AS DATE) AS tx_date,
    CASE WHEN c_custkey % 13 = 0 AND l_linenumber <= 2 THEN DATE '2001-11-04' - CAST(l_partkey % 30 AS INTEGER) ELSE CAST(l_shipdate AS DATE) END AS disclosed_date,
    CASE WHEN l_partkey % 97 = 0 THEN 'unknown' WHEN l_suppkey % 20 = 0 THEN 'atLeast' ELSE 'range' END AS amount_kind,
    CAST(CASE WHEN l_partkey % 97 = 0 THEN 0 ELSE low END AS BIGINT) * 100 AS low_cents,
    CAST(CASE WHEN l_partkey % 97 = 0 THEN 0 WHEN l_suppkey % 20 = 0 THEN low ELSE {_HIGH_SQL} END AS BIGINT) * 100 AS high_cents,
    l_orderkey % 9 = 0 AS is_amendment, CASE WHEN l_orderkey % 5 = 0 THEN 'recovered by OCR' END AS warning
  FROM laddered),
feed AS (
  SELECT *, date_diff('day', tx_date, disclosed_date) AS lag, tx_date > disclosed_date AS impossible, CASE WHEN tx_date > disclosed_date THEN disclosed_date ELSE tx_date END AS sort_date, upper(ticker) AS symbol FROM trade),
member AS (
  SELECT 'C' || c_custkey AS id, c_name AS name, n_name AS state, CASE c_mktsegment WHEN 'BUILDING' THEN 'senate' WHEN 'FURNITURE' THEN 'executive' ELSE 'house' END AS chamber,
    CASE c_custkey % 4 WHEN 0 THEN 'democrat' WHEN 1 THEN 'republican' WHEN 2 THEN 'independent' ELSE 'unknown' END AS party, c_custkey, c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
committee AS (
  SELECT id AS member_id, c_mktsegment AS committee FROM member WHERE c_custkey % 3 <> 0
  UNION ALL SELECT id, state FROM member WHERE c_custkey % 3 <> 0)
"""

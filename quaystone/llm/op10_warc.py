"""Content-addressed WARC archive: payload bytes once by SHA-256, exact record headers apart.

`archive` writes two tables: `payloads` (digest, payload), each distinct payload once, and
`headers` (header, digest), the exact header bytes of every record. `read_headers` and
`read_payloads` read them back (digests are computed again from the bytes and must agree), and
`restore` joins them to the original records. Payload bytes are shuffled once, to be stored; a
payload that a third of all pages share is folded on the map side and crosses the network once a task.

Defined cases: a null html is an empty payload; payloads under `least` bytes are always responses;
rows that repeat a page_id with the same payload are all responses if that id is the smallest; a
null page_id or url is written as such and read back as null, an empty url as empty; a url with line breaks is written with
them (and percent signs) as percent codes and a header line that says so, and read back as it was; very long payloads are
stored whole; other columns are ignored; an empty table gives an empty archive. page_id is a bigint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import new_path, table

LEAST = 100  #: bytes from which an equal payload is revisited
CRLF = "\r\n"
CODED = "X-Target-URI-Percent-Coded"


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, digest, n, record_type, refers_to of every page; no payload."""
    rec = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n"))
    first = rec.filter(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rec.join(first, "digest", "left").select("page_id", "url", "digest", "n", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def _header(date: str) -> F.Column:
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    broken = F.coalesce(F.col("url").rlike("[\r\n]"), F.lit(False))
    url = F.when(broken, F.replace(F.replace(F.replace(F.col("url"), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))).otherwise(F.col("url"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line(CODED, F.when(broken, "true")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Refers-To", urn("refers_to")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("record_type") == "response", F.col("n")).otherwise(F.lit(0)).cast("string")),
        F.lit(CRLF),
    ).cast("binary")


def archive(pages: DataFrame, path: str, least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> None:
    records(pages, least).select(_header(date).alias("header"), "digest").write.option("compression", "zstd").parquet(f"{path}/headers")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    stored = pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload")).groupBy("digest").agg(F.first("payload").alias("payload"))
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """What the header bytes say."""
    text = F.col("header").cast("string")
    get = lambda name, value="([^\\r]*)": F.nullif(F.regexp_extract(text, rf"\n{name}: {value}\r\n", 1), F.lit(""))
    written = F.when(text.rlike("\nWARC-Target-URI: "), F.regexp_extract(text, "\nWARC-Target-URI: ([^\r]*)\r\n", 1))
    url = F.when(text.rlike(f"\n{CODED}: "), F.replace(F.replace(F.replace(written, F.lit("%0A"), F.lit("\n")), F.lit("%0D"), F.lit("\r")), F.lit("%25"), F.lit("%"))).otherwise(written)
    return spark.read.schema("header binary, digest string").parquet(f"{path}/headers").select(
        get("WARC-Record-ID", "<urn:page:(-?\\d+)>").cast("long").alias("page_id"), url.alias("url"), get("WARC-Type").alias("record_type"),
        get("WARC-Refers-To", "<urn:page:(-?\\d+)>").cast("long").alias("refers_to"), get("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("payload_digest"), "header",
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads, with a digest and a length taken from the bytes; a wrong digest stops the read."""
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    actual = F.sha2("payload", 256)
    return stored.select(F.when(actual == F.col("digest"), actual).otherwise(F.raise_error(F.lit("stored payload does not have its digest"))).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """Every record: header fields, exact header bytes, payload bytes; `record` is the WARC record itself."""
    joined = read_headers(spark, path).join(read_payloads(spark, path), "payload_digest")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.withColumn("record", F.concat("header", body, F.lit(b"\r\n\r\n")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    archive(table(spark, sf_dir, "pages"), path)
    rebuilt = (F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))
    return restore(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *rebuilt)


#: The record's header lines and payload, written out.
ORACLE = """
WITH rec AS (
  SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
sized AS (
  SELECT page_id, url, payload, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM rec),
firsts AS (
  SELECT payload_digest, min(page_id) AS first_id FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest),
told AS (
  SELECT page_id, url, payload, payload_bytes, payload_digest, first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again, first_id
  FROM sized LEFT JOIN firsts USING (payload_digest)),
records AS (
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to,
    'WARC/1.1' || crlf || 'WARC-Type: ' || CASE WHEN again THEN 'revisit' ELSE 'response' END || crlf || coalesce('WARC-Record-ID: <urn:page:' || page_id || '>' || crlf, '') || 'WARC-Date: 1970-01-01T00:00:00Z' || crlf
    || coalesce('WARC-Target-URI: ' || url || crlf, '') || 'WARC-Payload-Digest: sha256:' || payload_digest || crlf || CASE WHEN again THEN 'WARC-Refers-To: <urn:page:' || first_id || '>' || crlf ELSE '' END
    || 'Content-Type: text/html; charset=utf-8' || crlf || 'Content-Length: ' || CASE WHEN again THEN 0 ELSE payload_bytes END || crlf || crlf || CASE WHEN again THEN '' ELSE payload END || crlf || crlf AS record
  FROM told, (SELECT chr(13) || chr(10) AS crlf))
SELECT page_id, payload_bytes, payload_digest, record_type, refers_to, CAST(octet_length(encode(record)) AS BIGINT) AS record_bytes, sha256(record) AS record_sha256 FROM records
"""

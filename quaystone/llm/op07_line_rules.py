"""Quality rules with cross-document line frequency, in DataFrame operations alone.

Base figures come from each whole text by array functions. The method then hashes every line in a
normal form (small letters, digits as 0, white space folded), counts the distinct texts of a host
that hold it, removes lines that stand in more than `share` of the host's texts (and at least
`least`), and rejects documents that this depletes: under `left` of their words remain, which is half. `source` is the host of documents. Exact
copies of a text count once, so that copying a document does not make its lines boilerplate.

`line_rules` gives figures and the verdict; `clean_lines` gives the documents without the lines above the limits.
There a line is also above the limits, whatever its share, in as many different texts as the square root of the
host's, and `MOST` at least (20 of 400 texts, 10,000 of 10^8), so that neither a small nor a very large host has a limit that is out of
reach or below what headings are shared by; a document is also depleted when fewer than `FEWEST` words remain.

Repeated words are found from five-word windows hashed to 64 bits; only texts in which a hash
occurs twice take the longer way of sorting windows. Lines are grouped by host, line and text
before they are counted by host and line, so that a line in every document is counted in parts.

Defined cases: a null text has no words; a null source is a host of its own; a text of white space
has no words and fails; documents without a line above the limits keep the base verdict; repeated
doc_ids give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import cut, table

SHARE = 0.05
LEAST = 5
LEFT = 0.5  #: of the words; see the planted documents in tests/llm/test_exact.py
MOST = 20
FEWEST = 10  #: words, as for whole texts
BROADCAST_BYTES = 16 << 20
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"


def folded(x: F.Column) -> F.Column:
    """Small letters, digits as 0, white space but for line breaks folded."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[0-9]", "0"), r"[\x20\x09\x0B-\x0D]+", " ")


def normal(line: F.Column) -> F.Column:
    return F.trim(folded(line))


def base_figures(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, source, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines (hash and words of each line that is not blank); also: "raw", the text as it is."""
    text = F.coalesce("text", F.lit(""))
    step1 = docs.select("doc_id", "source", F.col("text").alias("raw"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"), F.split(text, "\n").alias("l"), F.split(folded(text), "\n").alias("f"))
    # Each word is hashed once, and a window from its words' hashes.
    step2 = step1.withColumns({"hw": F.transform("w", lambda x: F.xxhash64(x)), "l": F.filter("l", lambda x: x.rlike(r"[^\x20\x09-\x0D]")), "f": F.filter(F.transform("f", lambda x: F.trim(x)), lambda x: x != "")})
    five = F.transform(F.sequence(F.lit(0), F.size("hw") - 5), lambda i: F.xxhash64(*[F.get("hw", i + j) for j in range(5)]))
    step3 = step2.withColumn("h", F.when(F.size("hw") >= 5, five).otherwise(F.array().cast("array<bigint>")))
    sort = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    again = F.filter(F.col("s"), lambda x, j: (F.get("s", j - 1)["h"].eqNullSafe(x["h"])) | (F.get("s", j + 1)["h"].eqNullSafe(x["h"])))
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), lambda acc, p: F.struct((acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    step4 = step3.withColumn("s", F.when(repeats, sort).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    line = lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n"))
    return step4.select(
        "doc_id", "source", F.xxhash64("text").alias("text_hash"),
        F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"), F.transform("f", line).alias("lines"), *also,
    )


def above_limits(base: DataFrame, share: float, least: int, most: int | None = None) -> DataFrame:
    """s (source), above (hash) of lines above the limits."""
    texts = base.select("source", "text_hash").distinct().groupBy("source").agg(F.count("*").alias("n_texts"))
    lines = base.select("source", "text_hash", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).distinct()
    often = lines.groupBy("source", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    over = F.col("n") > F.col("n_texts") * share
    over = over if most is None else over | (F.col("n") >= F.greatest(F.lit(float(most)), F.sqrt("n_texts")))
    return often.join(texts, often.source.eqNullSafe(texts.source)).filter(over).select(often.source.alias("s"), F.col("h").alias("above"))


def line_rules(docs: DataFrame, share: float = SHARE, least: int = LEAST, left: float = LEFT) -> DataFrame:
    """The figures, base_failed, n_boilerplate (words in lines above the limits) and kept."""
    base = cut(base_figures(docs).withColumn("row", F.monotonically_increasing_id()), "lines")
    above = above_limits(base, share, least)
    held = base.select("row", "source", F.explode("lines").alias("line"))
    removed = held.join(above, held.source.eqNullSafe(F.col("s")) & (F.col("line.h") == F.col("above"))).groupBy("row").agg(F.sum("line.n").cast("long").alias("n_boilerplate"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = base.drop("lines", "text_hash").join(removed, "row", "left").withColumn("n_boilerplate", F.coalesce("n_boilerplate", F.lit(0).cast("long"))).withColumn("base_failed", failed)
    depleted = F.col("n_words") - F.col("n_boilerplate") < F.col("n_words") * left
    return found.withColumn("kept", ~(F.col("base_failed") | depleted)).drop("row", "source")


def clean_lines(docs: DataFrame, share: float = SHARE, least: int = LEAST, most: int = MOST, left: float = LEFT) -> DataFrame:
    """doc_id, text without the lines above the limits, n_words, n_boilerplate, n_lines_removed, base_failed, kept. Texts without such lines stay as they are, null too."""
    base = cut(base_figures(docs, "raw").withColumn("row", F.monotonically_increasing_id()), "lines")
    above = above_limits(base, share, least, most)
    held = base.select("row", "source", F.explode("lines").alias("line"))
    held = held.join(above, held.source.eqNullSafe(F.col("s")) & (F.col("line.h") == F.col("above")))
    removed = cut(held.groupBy("row").agg(F.sum("line.n").cast("long").alias("words"), F.count("*").alias("removed"), F.collect_set("above").alias("gone")), "removed")
    size = removed.agg(F.sum(F.size("gone") * 8 + 64).alias("n")).first().n or 0
    found = base.join(F.broadcast(removed) if size <= BROADCAST_BYTES else removed, "row", "left")
    rest = F.filter(F.split("raw", "\n"), lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & F.array_contains("gone", F.xxhash64(normal(x)))))
    n_boilerplate = F.coalesce("words", F.lit(0).cast("long"))
    remain = F.col("n_words") - n_boilerplate
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("raw")).otherwise(F.array_join(rest, "\n")).alias("text"), "n_words", n_boilerplate.alias("n_boilerplate"),
        F.coalesce("removed", F.lit(0).cast("long")).alias("n_lines_removed"), failed.alias("base_failed"), (~failed & (remain >= FEWEST) & (remain >= F.col("n_words") * left)).alias("kept"),
    )


def op7_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents"))


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
figures AS (
  SELECT b.doc_id, source, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, l
  FROM base b LEFT JOIN covered c USING (doc_id)),
lines AS (
  SELECT doc_id, source, text, trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, source, text, unnest(l) AS x FROM figures)),
often AS (SELECT source, line, count(DISTINCT text) AS n FROM lines GROUP BY source, line HAVING count(DISTINCT text) >= 5),
texts AS (SELECT source, count(DISTINCT text) AS n_texts FROM figures GROUP BY source),
above AS (SELECT o.source, o.line FROM often o JOIN texts t ON o.source IS NOT DISTINCT FROM t.source WHERE o.n > t.n_texts * 0.05),
removed AS (
  SELECT doc_id, CAST(sum(len(string_split(line, ' '))) AS BIGINT) AS n_boilerplate
  FROM lines l WHERE EXISTS (SELECT 1 FROM above a WHERE a.source IS NOT DISTINCT FROM l.source AND a.line = l.line) GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, coalesce(n_boilerplate, 0) AS n_boilerplate,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_words - coalesce(n_boilerplate, 0) < n_words * 0.5) AS kept
FROM figures LEFT JOIN removed USING (doc_id)
"""

"""The amount column of a filing as a disclosed bracket, in one CASE over the text: the one grammar of all forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A dollar figure: whole dollars with commas, and cents.
FIGURE = r"\$([0-9][0-9,]*)(?:\.([0-9]{2}))?"
DASH = "[-–—]"


def _in_cents(figure: Column) -> Column:
    """Cents of a text that is a figure alone; null of any other."""
    return (F.translate(figure, "$,", "").try_cast("decimal(21,2)") * 100).try_cast("long")


def cents(text: Column, before: str = "") -> Column:
    """The first figure in a text, in cents; null if there is none. before: a pattern of what stands right before the figure."""
    return F.when(text.contains("$"), _in_cents(F.regexp_extract(text, f"{before}({FIGURE})", 1)))


def _once(x: Column, told) -> Column:
    """told of a value that is computed once, however often told names it."""
    return F.get(F.transform(F.array(x), told), F.lit(0))


def parse(tail: Column) -> Column:
    """struct(kind, low_cents, high_cents, pending) of the text after a row's dates.

    pending: "upper" if a range's second figure is on the next line, "threshold" after a bare "Over". Words are looked for
    anywhere, before figures; a figure must open the text, and what follows it tells ranges, open ends and lone figures apart.
    """
    zero = F.lit(0)

    def row(kind: str, low: Column, high: Column, pending: str | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), low.cast("long").alias("low_cents"), high.cast("long").alias("high_cents"), F.lit(pending).cast("string").alias("pending"))

    def read(t: Column) -> Column:
        text, low, after, first, second = t["text"], t["low"], t["after"], t["first"], t["second"]
        over = F.when(low.contains("over"), cents(text, r"(?i)\bover\s*"))
        return (
            F.when(low.contains("none") | text.contains("less than $201"), row("none", zero, zero))
            .when(over.isNotNull(), row("atLeast", over, over))
            .when(low.contains("over") & text.rlike(r"(?i)\bover$"), row("unknown", zero, zero, "threshold"))
            .when(first.isNull(), row("unknown", zero, zero))
            .when(after == "", row("exact", first, first))
            .when(after.startswith("+"), row("atLeast", first, first))
            .when(second.isNotNull(), row("range", first, second))
            .when(after.rlike(f"^{DASH}$"), row("range", first, first, "upper"))
            .otherwise(row("unknown", zero, zero))
        )

    # Each step reads the text once, and names what it found for the next.
    opens = lambda t: F.struct(t.alias("text"), F.when(t.startswith("$"), F.regexp_extract(t, f"^({FIGURE})", 1)).alias("figure"))
    rest = lambda t: F.struct(t["text"].alias("text"), F.when(t["text"].rlike("[NVnv]"), F.lower(t["text"])).otherwise(t["text"]).alias("low"), F.trim(F.substring(t["text"], F.length(t["figure"]) + 1, F.length(t["text"]))).alias("after"), _in_cents(t["figure"]).alias("first"))
    ends = lambda t: F.struct(t["text"].alias("text"), t["low"].alias("low"), t["after"].alias("after"), t["first"].alias("first"), cents(t["after"], rf"^{DASH}\s*").alias("second"))
    plain = F.trim(F.regexp_replace(F.coalesce(tail, F.lit("")), r"\s\s+|[^\S ]", " "))
    return _once(_once(_once(_once(plain, opens), rest), ends), read)

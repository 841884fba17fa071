"""Content-derived ids of trades."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fingerprint() -> Column:
    """What makes two rows the same trade, joined by bars; nulls count as empty."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat_ws("|", part(F.coalesce("ticker", "asset")), part(F.col("asset_type")), part(F.col("tx_type")), F.date_format("tx_date", "yyyy-MM-dd"), part(F.col("low_cents")), part(F.col("high_cents")), part(F.col("owner")))


OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3


@F.pandas_udf(T.StringType())
def fnv1a64(text: pd.Series) -> pd.Series:
    """FNV-1a of the UTF-8 bytes, 16 hex digits; null of null. A batch is hashed at once, byte by byte of its longest text.

    Built-in functions would run an interpreted lambda for every byte; this takes a numpy step for every place in the texts.
    """
    raw = [x.encode() if isinstance(x, str) else b"" for x in text]
    size = np.array([len(x) for x in raw], np.int64)
    order = np.argsort(-size, kind="stable")  # the longest first, so that those still running are a prefix
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    start, size = (np.cumsum(size) - size)[order], size[order]
    h = np.full(len(raw), OFFSET, np.uint64)
    for at in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -at, side="left"))
        h[:n] = (h[:n] ^ data[start[:n] + at]) * np.uint64(PRIME)
    out = np.empty(len(raw), np.uint64)
    out[order] = h
    return pd.Series([None if x is None else f"{v:016x}" for x, v in zip(text, out.tolist(), strict=True)], dtype=object)


def stable_ids(trades: DataFrame, position: str = "position") -> DataFrame:
    """id = filing and hash of the fingerprint; equal ones of a filing get -2, -3, ... by position."""
    hashed = trades.withColumn("_h", fnv1a64(fingerprint()))
    nth = F.row_number().over(Window.partitionBy("filing_id", "_h").orderBy(position))
    return hashed.withColumn("id", F.concat("filing_id", F.lit("-"), "_h", F.when(nth > 1, F.concat(F.lit("-"), nth.cast("string"))).otherwise(F.lit("")))).drop("_h")

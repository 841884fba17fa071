"""Names of people as keys."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = {"ł": "l", "đ": "d", "ø": "o", "ı": "i"}
#: Accented small Latin letters, Vietnamese and Romanian ones included, and the letter each decomposes to.
_FOLDS = {c: x for c in map(chr, range(0xE0, 0x1F00)) if (x := _PLAIN.get(c) or unicodedata.normalize("NFD", c)[0]) in string.ascii_lowercase and c == c.lower()}
_FROM, _TO = "".join(_FOLDS), "".join(_FOLDS.values())


def folded(name: Column) -> Column:
    """Small letters without accents, and single characters of anything but letters and spaces gone."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(name, F.lit(""))), _FROM, _TO), "[^a-z ]", ""))


def same(a: Column, b: Column) -> Column:
    """Whether two names are equal but for case and accents, by collation; as a join's condition it is an equality."""
    return F.collate(a, "UNICODE_CI_AI") == F.collate(b, "UNICODE_CI_AI")


def without_suffix(name: Column) -> Column:
    """A folded name without jr, sr and ordinals at its end."""
    return F.trim(F.regexp_replace(name, r"((^| )(jr|sr|ii|iii|iv|v))+$", ""))


def letters(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit(""))


def seat_number(district: Column) -> Column:
    return F.expr("try_cast(trim({}) as int)".format("district")) if isinstance(district, str) else F.trim(district).try_cast("int")


def is_bioguide(x: Column) -> Column:
    return x.rlike("^[A-Z][0-9]{6}$")


def fallback_id(*parts: Column) -> Column:
    """x- and the folded parts with hyphens."""
    return F.concat(F.lit("x-"), F.regexp_replace(F.trim(F.concat_ws(" ", *[folded(p) for p in parts])), " +", "-"))


def last_first(name: Column) -> Column:
    """"Last, First" as "First Last"."""
    return F.when(F.instr(name, ",") > 0, F.trim(F.concat(F.trim(F.regexp_extract(name, "^[^,]*,(.*)$", 1)), F.lit(" "), F.trim(F.regexp_extract(name, "^([^,]*),", 1))))).otherwise(F.trim(name))

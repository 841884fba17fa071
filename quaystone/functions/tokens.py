"""Words of a line of a form, and what kind of word each is. Rows are found by the order of kinds; all else is done by windows over lines.

Small helpers for Arrow-batched functions: each takes one line, or its words.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable


def words(line: str) -> list[str]:
    """A colon ends a word, and a dollar sign begins one."""
    return line.replace("$", " $").replace(":", ": ").split()


def word(some: list[str], at: int) -> str:
    return some[at] if at < len(some) else ""


def bare(x: str) -> str:
    """In small letters, without the marks around it."""
    return x.strip("().,;:[]*").lower()


def is_number(x: str, most: int = 9, least: int = 1) -> bool:
    return least <= len(x) <= most and x.isascii() and x.isdigit()


def is_code(x: str) -> bool:
    """Two to four capitals."""
    return 2 <= len(x) <= 4 and x.isascii() and x.isalpha() and x.isupper()


def is_symbol(x: str) -> bool:
    """Up to seven capitals, digits, stops and dashes, a capital first."""
    plain = x.replace(".", "").replace("-", "")
    return 1 <= len(x) <= 7 and x[0].isalpha() and plain.isascii() and plain.isalnum() and plain == plain.upper()


def date(x: str, fused: bool = False) -> str | None:
    """Month, day and year between slashes. fused: also where the first slash is lost, with it back in its place."""
    parts = x.split("/")
    if len(parts) == 3 and is_number(parts[0], 2) and is_number(parts[1], 2) and is_number(parts[2], 4, 2):
        return x
    if fused and len(parts) == 2 and is_number(parts[0], 4, 3) and is_number(parts[1], 4, 2):
        return f"{parts[0][:-2]}/{parts[0][-2:]}/{parts[1]}"
    return None


def money(x: str) -> str:
    """A word as it stood before recognition read a dollar sign as S, and commas as full stops."""
    if x[:1] == "S" and x[1:2].isdigit():
        x = "$" + x[1:]
    first, *thousands = x.split(".")
    return ",".join([first, *thousands]) if thousands and first.lstrip("$").replace(",", "").isdigit() and all(is_number(y, 3, 3) for y in thousands) else x


def enclosed(text: str, opens: str, closes: str) -> list[tuple[str, int, int]]:
    """(inner, where the bracket opens, where what follows it begins) of every pair of brackets."""
    found, at = [], text.find(opens)
    while at >= 0:
        end, again = text.find(closes, at), text.find(opens, at + 1)
        if end >= 0 and not at < again < end:
            found.append((text[at + 1 : end], at, end + 1))
        at = again
    return found


def symbol_and_code(text: str) -> tuple[str | None, str | None]:
    """A symbol in round brackets before a code in square ones, else at the end; and the code: that one, or the first where there is no symbol."""
    codes = [(inner, at) for inner, at, _ in enclosed(text, "[", "]") if is_code(inner)]
    symbols = [(inner, end) for inner, _, end in enclosed(text, "(", ")") if is_symbol(inner)]
    for symbol, end in symbols:
        for code, at in codes:
            if at >= end and not text[end:at].strip():
                return symbol, code
    for symbol, end in symbols:
        if not text[end:].strip():
            return symbol, None
    return None, codes[0][0] if codes else None


def last_coded(text: str) -> str:
    """Of a text with several codes the part after the last but one, to the last."""
    codes = [x for x in enclosed(text, "[", "]") if is_code(x[0])]
    return text[codes[-2][2] : codes[-1][2]].strip() if len(codes) > 1 else text


def after(text: str, known: Iterable[str]) -> tuple[str, str]:
    """(known words that a text begins with, the rest with its gaps)."""
    held, rest = [], text
    while rest and (first := rest.split(maxsplit=1)[0]) in known and rest.startswith(first):
        held.append(first)
        rest = rest[len(first) :].lstrip()
    return " ".join(held), rest


def apart(text: str) -> list[str]:
    """The letters of a text of single letters, wide apart; empty for any other text."""
    letters = [x.strip() for x in text.strip().split("  ") if x.strip()]
    return letters if all(len(x) == 1 and x.isascii() and x.isalpha() for x in letters) else []


def label(line: str) -> tuple[str | None, str]:
    """(letter, body) of a label: the form's labels print as single capitals, wide apart, before a colon."""
    head, colon, body = line.partition(":")
    letters = apart(head) if colon else []
    return (letters[0], body.strip()) if letters and all(x.isupper() for x in letters) else (None, "")


def is_page_number(some: list[str]) -> bool:
    """Whether "page", a number, "of" and a number follow each other."""
    return any(bare(x) == "page" and is_number(word(some, i + 1)) and word(some, i + 2).lower() == "of" and is_number(bare(word(some, i + 3))) for i, x in enumerate(some))


@functools.cache
def _longest_first(codes: tuple[str, ...]) -> list[list[str]]:
    return sorted((c.split() for c in codes), key=len, reverse=True)


def dated_code(some: list[str], codes: Iterable[str]) -> tuple[int, str, int] | None:
    """(place, code, place of the first date) where a code and two dates stand; the longest code that fits."""
    for k, x in enumerate(some):
        if k and "/" in x and date(x) and date(word(some, k + 1)):
            for way in _longest_first(tuple(codes)):
                if k >= len(way) and some[k - len(way) : k] == way:
                    return k - len(way), " ".join(way), k
    return None


def dated_word(some: list[str], known: Iterable[str]) -> int | None:
    """The place of the first known word before a date and Yes or No."""
    return next((i for i in range(len(some) - 1) if "/" in some[i + 1] and bare(some[i]) in known and date(some[i + 1], fused=True) and bare(word(some, i + 2)) in ("yes", "no")), None)

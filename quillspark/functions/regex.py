"""Patterns are written once, with the meaning they have in web browsers, and turned into Java's and RE2's dialects.

White space includes no-break and ideographic spaces, word boundaries are ASCII, and ``$`` is the very end of the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import EDGE

#: Inside of a character class.
SPACE = r"\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_EDGE = EDGE


def _turn(pattern: str, edge: str, end: str) -> str:
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            out.append((SPACE if inside else f"[{SPACE}]") if two == r"\s" else f"[^{SPACE}]" if two == r"\S" else edge if two == r"\b" and not inside else two)
            i += 2
            continue
        if c == "[" and inside and edge == _EDGE:
            c = "\\["  # Java would open a class within the class
        elif c == "[":
            inside = True
        elif c == "]":
            inside = False
        out.append(end if c == "$" and not inside else c)
        i += 1
    return "".join(out)


def java(pattern: str, i: bool = False) -> str:
    return ("(?i)" if i else "") + _turn(pattern, _EDGE, r"\z")


def re2(pattern: str, i: bool = False) -> str:
    """As a literal of DuckDB's SQL."""
    return "'" + (("(?i)" if i else "") + _turn(pattern, r"\b", "$")).replace("'", "''") + "'"


def like(text: Column, pattern: str, i: bool = False) -> Column:
    return text.rlike(java(pattern, i))


def count(text: Column, pattern: str, i: bool = False) -> Column:
    return F.regexp_count(text, F.lit(java(pattern, i)))


def replace(text: Column, pattern: str, by: str, i: bool = False) -> Column:
    return F.regexp_replace(text, java(pattern, i), by)


#: The characters of ``\\s``.
BLANKS = " \t\n\x0b\x0c\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def split(text: Column, pattern: str) -> Column:
    return F.split(text, java(pattern), -1)


def find_all(text: Column, pattern: str, group: int = 0, i: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern, i)), group)

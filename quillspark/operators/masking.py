"""Fragile runs (formulas, citations, statistics) behind placeholder tokens, and back.

Masking is sequential within a text (each step sees what the one before left), so it runs as an Arrow-batched function; detection counts
and restoring are column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed as X
from ..functions import regex as R

ENTRY = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("original", T.StringType())]))
MASKED = T.StructType([T.StructField("text", T.StringType()), T.StructField("placeholders", ENTRY)])
_STYLE = re.compile(r"</?(?:b|i|sup|sub)\d*>")


def _compiled(pattern: str) -> re.Pattern:
    """With ASCII digits and word boundaries, as everywhere here."""
    out, inside = "", False
    for part in re.findall(r"\\.|.", pattern, re.S):
        inside = part == "[" or inside and part != "]"
        out += "0-9" if part == r"\d" and inside else "[0-9]" if part == r"\d" else X.EDGE if part == r"\b" else "\\[" if part == "[" and inside and out.endswith("[") else part
    return re.compile(out)


_DELIMITED, _STATISTIC = [_compiled(p) for p in X.DELIMITED], [_compiled(p) for p in X.CITATION_OR_STATISTIC]
_EQUATION, _TOKEN, _VARIANT = _compiled(X.EQUATION), re.compile(r"⟦PM([0-9]+)⟧"), _compiled(X.TOKEN_VARIANT)
_MATH, _MARK = re.compile(X.MATH_SYMBOL), re.compile(r"[=+\-*/^_(){}\[\]|<>~]")


def is_formula(run: str) -> bool:
    """F25 for one string, with the fixed values of the column's rule."""
    t = run.strip()
    marks, letters, words = len(_MARK.findall(t)), len(re.findall("[a-zA-Z一-鿿]", t)), sum(w.isascii() and w.isalpha() and len(w) > 2 for w in t.split())
    return len(t) > 2 and bool(_MATH.search(t) or (marks > 2 and 2 * marks >= letters and words < 2))


@dataclass
class Masker:
    """X01 for one text: tokens already there come first, and numbering goes on after them."""

    text: str
    next: int = 0

    def __post_init__(self):
        self.found: list[tuple[str, str]] = []

    def token(self, original: str) -> str:
        t = f"⟦PM{self.next}⟧"
        self.next += 1
        self.found.append((t, original))
        return t

    def literal(self, x: str) -> None:
        self.text = "".join(part if i == 0 else self.token(x) + part for i, part in enumerate(self.text.split(x)))

    def pattern(self, p: re.Pattern, test=lambda m: True) -> None:
        self.text = p.sub(lambda m: self.token(m[0]) if test(m[0]) else m[0], self.text)


def protect(text: str, literals: list[str] | None = None) -> tuple[str, list[tuple[str, str]]]:
    """Order matters: earlier tokens, delimited mathematics, given literals (longest first), citations and statistics, equations."""
    m = Masker(text)
    there = list(dict.fromkeys(x[0] for x in _TOKEN.finditer(text)))
    m.next = max((int(_TOKEN.match(t)[1]) + 1 for t in there), default=0)
    for t in there:
        m.literal(t)
    for p in _DELIMITED:
        m.pattern(p)
    for x in sorted(literals or [], key=lambda x: -len(x)):  # L04
        if len(x.strip()) >= 2:
            m.literal(x.strip())
    for p in _STATISTIC:
        m.pattern(p)
    m.pattern(_EQUATION, is_formula)
    return m.text, m.found


def normalize_variants(text: str, issued: set[str]) -> str:
    """Bracket, space and full-width variants of an issued token that isn't there itself, once each."""
    done: set[str] = set()

    def turn(m: re.Match) -> str:
        t = f"⟦PM{int(m[1])}⟧"  # int() reads full-width digits
        if m[0] == t or t not in issued or t in text or t in done:
            return m[0]
        done.add(t)
        return t

    return _VARIANT.sub(turn, text) if issued else text


def restore(text: str, placeholders: list[tuple[str, str]]) -> str:
    """Tokens, then bare names without brackets where the original is still missing. The last comes first, as a late original may hold
    an earlier token."""
    text = normalize_variants(text, {t for t, _ in placeholders})
    for token, original in reversed(placeholders):
        text = text.replace(token, original)
        bare = re.compile(re.escape(token.strip("⟦⟧")) + "(?![0-9])")
        if original not in text:
            text = bare.sub(lambda _: original, text)
    return text


def verify(text: str, placeholders: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """(missing, unexpected) tokens; order doesn't matter and a bare name counts as there."""
    issued = {t for t, _ in placeholders}
    text = normalize_variants(text, issued)
    missing = [t for t, _ in placeholders if t not in text and not re.search(re.escape(t.strip("⟦⟧")) + "(?![0-9])", text)]
    return missing, [t for t in dict.fromkeys(m[0] for m in _TOKEN.finditer(text)) if t not in issued]


def prose(text: str) -> str:
    """Without style marks and anything protected."""
    return _TOKEN.sub(" ", protect(_STYLE.sub("", text))[0])


#: What every protected run has one of, and style marks as well: a text without is as it was.
_TRIGGER = r"[$\\\[(<>=≈≠≤≥±%⟦]"


def _view(text: str, masked: str) -> str:
    """X05 of a text that has been masked already: only style marks make another pass necessary."""
    bare = _STYLE.sub("", text)
    return _TOKEN.sub(" ", masked if bare == text else protect(bare)[0])


@F.pandas_udf(T.StructType([*MASKED.fields, T.StructField("prose", T.StringType())]))
def _protect_batch(text: pd.Series) -> pd.DataFrame:
    found = [protect(t) if t is not None else (None, []) for t in text]
    return pd.DataFrame({"text": [t for t, _ in found], "placeholders": [[{"token": a, "original": b} for a, b in p] for _, p in found], "prose": [None if t is None else _view(t, m[0]) for t, m in zip(text, found)]})


@F.pandas_udf(T.StringType())
def _restore_batch(text: pd.Series, placeholders: pd.Series) -> pd.Series:
    return pd.Series([None if ps is None else restore(t or "", [(p["token"], p["original"]) for p in ps]) for t, ps in zip(text, placeholders)], dtype=object)


@F.pandas_udf(T.StringType())
def _prose_batch(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else prose(t) for t in text], dtype=object)


def _worth(text: Column) -> Column:
    """Only texts that can hold a protected run go to Python."""
    return F.when(text.rlike(_TRIGGER), text)


def protect_udf(text: Column | str) -> Column:
    """Struct of masked text, placeholders, and the prose view."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.coalesce(text, F.lit(""))
    found = _protect_batch(_worth(text))
    none = F.array().cast(ENTRY)
    return F.struct(F.coalesce(found["text"], plain).alias("text"), F.coalesce(found["placeholders"], none).alias("placeholders"), F.coalesce(found["prose"], plain).alias("prose"))


def restore_udf(text: Column, placeholders: Column) -> Column:
    """X02."""
    return F.coalesce(_restore_batch(text, F.when(F.size(placeholders) > 0, placeholders)), F.coalesce(text, F.lit("")))


def prose_udf(text: Column) -> Column:
    """X05."""
    return F.coalesce(_prose_batch(_worth(text)), F.coalesce(text, F.lit("")))


def restore_exact(text: Column, placeholders: Column) -> Column:
    """X02 without variants: a fold over the placeholders, all in the JVM."""
    return F.aggregate(F.reverse(placeholders), text, lambda t, p: F.replace(t, p["token"], p["original"]))


def inventory(text: Column, placeholders: Column) -> Column:
    """X03 for canonical tokens, in the JVM: struct of missing and unexpected."""
    there, issued = F.array_distinct(R.find_all(text, X.TOKEN)), F.transform(placeholders, lambda p: p["token"])
    return F.struct(F.array_except(issued, there).alias("missing"), F.array_except(there, issued).alias("unexpected"))


def intact(text: Column, placeholders: Column) -> Column:
    """Every issued token is literally there."""
    return F.forall(placeholders, lambda p: text.contains(p["token"]))


def registry(df, text: str, answer: str):
    """Protect, verify and restore one column pair: accepted answers restored, others null."""
    out = df.withColumn("_m", protect_udf(F.col(text))).withColumn("_r", inventory(F.col(answer), F.col("_m.placeholders")))
    ok = (F.size("_r.missing") == 0) & (F.size("_r.unexpected") == 0)
    return out.withColumn("accepted", ok).withColumn("restored", F.when(ok, restore_exact(F.col(answer), F.col("_m.placeholders")))).drop("_m", "_r")


def style_runs(runs: list[tuple[str, str]], share: float = 0.6, most: int = 6, longest: int = 60) -> list[tuple[str, str]]:
    """The styled stretches of a block whose dominant style covers over ``share`` of its text; first occurrences only."""
    total: dict[str, int] = {}
    for text, style in runs:
        total[style] = total.get(style, 0) + len(text)
    if not total:
        return []
    main = max(total, key=lambda s: total[s])
    if total[main] <= share * sum(total.values()):
        return []
    out: dict[str, str] = {}
    for text, style in runs:
        t = text.strip()
        if style != main and len(t) <= longest and len(re.findall(r"[^\W\d_]", t)) >= 2:
            out.setdefault(t, style)
    return list(out.items())[:most]


def mark_styles(text: str, runs: list[tuple[str, str]]) -> str:
    """Numbered tags around the first occurrence of each run."""
    for i, (run, style) in enumerate(runs):
        tag = {"bold": "b", "italic": "i", "superscript": "sup", "subscript": "sub"}.get(style, "b")
        text = text.replace(run, f"<{tag}{i}>{run}</{tag}{i}>", 1)
    return text


def parse_styles(text: str) -> tuple[str, list[tuple[str, str]]]:
    """Plain text and the (run, tag) pairs whose tags close properly."""
    found = [(m[3], m[1]) for m in re.finditer(r"<(b|i|sup|sub)(\d+)>(.*?)</\1\2>", text, re.S)]
    return _STYLE.sub("", text), found

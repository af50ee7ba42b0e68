"""Similarity and translated-or-not rules."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from . import fixed as X
from . import regex as R
from . import text as T


def multiset_dice(a: str, b: str) -> float:
    """X17 for two strings: Dice coefficient of their bigram multisets."""
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    if len(a) + len(b) > 500 and a.isascii() and b.isascii():  # the same counts as arrays of 128 x 128 bigrams
        x, y = (np.frombuffer(s.encode(), np.uint8).astype(np.intp) for s in (a, b))
        x, y = (np.bincount(s[:-1] * 128 + s[1:], minlength=128 * 128) for s in (x, y))
        return 2 * int(np.minimum(x, y).sum()) / (len(a) + len(b) - 2)
    x, y = (Counter(map("".join, zip(s, s[1:]))) for s in (a, b))
    return 2 * (x & y).total() / (len(a) + len(b) - 2)


@F.pandas_udf(DoubleType())
def dice(a: pd.Series, b: pd.Series) -> pd.Series:
    """X17. Counting a multiset has no built-in that is linear in the length, so it runs in Arrow batches."""
    return pd.Series([None if x is None or y is None else multiset_dice(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(BooleanType())
def _copied(source: pd.Series, spans: pd.Series) -> pd.Series:
    near = lambda a, b: len(b) >= X.COPY_LEAST and (b in a or multiset_dice(a, b) >= X.COPY_SIMILARITY)
    return pd.Series([any(near(a or "", b) for b in found) for a, found in zip(source, spans)], dtype="bool")


def at_least(a: Column, b: Column, share: float) -> Column:
    """Whether :func:`dice` reaches ``share``; lengths that differ too much settle it without looking at the texts."""
    n, m = F.length(a) - 1, F.length(b) - 1
    return F.when(a == b, share <= 1).when(2 * F.least(n, m) < share * (n + m), False).otherwise(dice(a, b) >= share)


def copy_dominant(source: Column, text: Column) -> Column:
    """F32: the same surface, or nearly."""
    return copied_surface(T.surface(source), T.surface(text))


def copied_surface(a: Column, b: Column) -> Column:
    """F32 for two surfaces."""
    return (a != "") & (b != "") & ((a == b) | ((F.least(F.length(a), F.length(b)) >= X.COPY_LEAST) & at_least(a, b, X.COPY_SIMILARITY)))


def residue_spans(text: Column, least: int = 10) -> Column:
    """long stretches of English prose."""
    spans = F.transform(R.find_all(text, X.RESIDUE_SEGMENT), lambda s: R.replace(s, r"\s+", " "))
    return F.filter(spans, lambda s: ~T.data_dense(s) & (T.english_words(s) >= least) & T.english_prose(s, min(least, 8)))


def copied_residue(source: Column, text: Column) -> Column:
    """Han text with a stretch copied from its source."""
    a, spans = T.surface(source), F.transform(residue_spans(text, 12), T.surface)
    return (T.han_chars(text) > 0) & (a != "") & _copied(a, spans)


_OTHER = rf"[^A-Za-z{R.SPACE}]*+"
#: Six words in a row that are lower-case letters but for marks around them.
_PLAIN_RUN = rf"(?:^|[{R.SPACE}])(?:{_OTHER}[a-z]{{2,}}+{_OTHER}[{R.SPACE}]++){{{X.RESIDUE_RUN - 1}}}{_OTHER}[a-z]{{2,}}+{_OTHER}(?:\z|[{R.SPACE}])"


def english_residue(text: Column, prose: Column | None = None) -> Column:
    """a run of six lower-case words, or a long span in the prose view."""
    cleaned = F.when(R.like(text, "@|https?://|www", True), R.replace(text, r"https?://\S+|www\.\S+|\S+@\S+", " ", True)).otherwise(text)
    spans = lambda c: F.size(residue_spans(c if prose is None else prose, 10)) > 0
    return R.let(cleaned, lambda c: c.rlike(_PLAIN_RUN) | spans(c))


def target_share(text: Column) -> Column:
    """Han characters against Latin words."""
    han, latin = R.count(text, X.HAN_WIDE), R.count(text, "[A-Za-z]{2,}")
    return F.when(han + latin == 0, 0.0).otherwise(han / (han + latin))


def plain_words(text: Column) -> Column:
    """Lower-case Latin words."""
    return F.size(F.filter(R.find_all(text, "[A-Za-z][A-Za-z'-]+"), lambda w: R.like(w, "^[a-z]")))


def looks_translated(source: Column, text: Column, target: Column, prose_source: Column | None = None, prose: Column | None = None) -> Column:
    """F35. The prose views (without protected runs) default to the texts themselves."""
    t = R.trim(text)
    ps, pt = source if prose_source is None else prose_source, t if prose is None else prose
    han, left = R.count(pt, X.HAN_WIDE), plain_words(pt)
    short = (plain_words(ps) == 0) | ((han + left > 0) & (han / F.greatest(han + left, F.lit(1)) >= X.TARGET_SHARE))
    return (
        F.when(t == "", False)
        .when(~target.ilike("zh%"), True)
        .when(R.count(ps, "[A-Za-z]{2,}") < X.PROSE_WORDS, True)
        .when(T.name_list(ps), True)
        .when(T.truncated(ps, pt), False)
        .when(F.length(ps) <= X.SHORT_SOURCE, short & ~copied_residue(source, t))
        .when(target_share(pt) < X.TARGET_SHARE, False)
        .otherwise(~copied_residue(source, t))
    )


def term_pairs(source: Column, text: Column) -> Column:
    """(source abbreviation, target term) for every "term (ABBR)" whose abbreviation the source has."""
    pairs = F.arrays_zip(R.find_all(text, X.TERM_PAIR, 2).alias("source"), R.find_all(text, X.TERM_PAIR, 1).alias("target"))
    return F.filter(pairs, lambda p: ~F.upper(p["source"]).isin(*X.STOP_ABBREVIATIONS) & (R.count(p["source"], "[A-Z]") >= 2) & source.contains(p["source"]))

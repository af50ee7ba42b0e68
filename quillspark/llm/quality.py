"""Quality rules: base counts and distribution divergence from language references.

Base: fewer than 20 words, or over 30 % of the words in 8-word windows that occur twice in the text. The method's verdict: the
Jensen-Shannon distance (square root of the divergence, base 2) between a document's histograms and those of its nearest
language reference. Two histograms: character classes of the whole text, and common words (the ``COMMON`` most frequent words of the
reference, all others one class). A document of n words is rejected when its nearest reference is further than ``FAR`` +
``FAR_SHORT`` / sqrt(n) for characters, or than ``FAR_WORDS`` + ``FAR_WORDS_SHORT`` / sqrt(n) for words, as distances of short texts are
noisy; nothing is rejected under ``LEAST_CHARS`` characters or ``LEAST_WORDS`` words.

References come from all documents that pass the base rules, by their lang (null lang: none): character counts and word counts are summed
by Spark. The word counts shuffle once, combined in each task; ``COMMON`` words of every language reach the driver and the tasks, so these grow with the number of
languages alone.

Defined cases: null text has no words and fails; equal rows get equal results; of words of equal count the first by bytes are common; without any reference (empty
table, no lang) the verdict is the base rules'; texts of any length count whole; extra columns of any name pass through :func:`keep` unchanged."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEAST, WINDOW, PERCENT = 20, 8, 30
COMMON = 200
#: A histogram of n words strays from its reference by about 1 / sqrt(n): distance allowed at length, plus that for short texts.
FAR, FAR_SHORT, FAR_WORDS, FAR_WORDS_SHORT, LEAST_CHARS, LEAST_WORDS = 0.15, 0.8, 0.40, 1.0, 100, 40
P = "__ql_"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _classes() -> np.ndarray:
    """Class of each byte: vowels, other small letters, capitals, digits, sentence marks, other ASCII marks, space, line feed, other
    control characters, and bytes of characters beyond ASCII (first bytes count, the rest don't)."""
    of = np.full(256, 9, np.int8)
    for i in range(128):
        c = chr(i)
        of[i] = 0 if c in "aeiou" else 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3 if c.isdigit() else 4 if c in ".,;:!?'\"-()" else 6 if c == " " else 7 if c == "\n" else 8 if i < 32 or i == 127 else 5
    of[128:192] = 10
    return of


CLASS, CLASSES = _classes(), 10


def char_histogram(text: bytes) -> np.ndarray:
    return np.bincount(CLASS[np.frombuffer(text, np.uint8)], minlength=11)[:CLASSES]


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in ``words``, exactly: windows compare by the numbers of their words."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    if len(number) == len(words):
        return 0
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (code[j : j + n] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    for j in range(width):  # equal hashes of different windows (never seen) would be split here
        if (code[a + j] != code[b + j]).any():
            seen = Counter(tuple(code[i : i + width].tolist()) for i in range(n))
            starts = np.array([seen[tuple(code[i : i + width].tolist())] > 1 for i in range(n)])
            break
    else:
        starts = np.zeros(n, bool)
        starts[a] = starts[b] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(starts), 1)
    np.add.at(edge, np.flatnonzero(starts) + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    b = np.frombuffer(text, np.uint8)
    white = len(text) - sum(map(len, words))
    chars = int(((b & 0xC0) != 0x80).sum()) - white
    dup = 0
    if b"\n" in text:
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            if line.strip(b" \t\n\r\x0b\x0c"):
                dup += line in seen
                seen.add(line)
    return len(words), chars, int(_SYMBOL[b].sum()), dup, repeated_words(words)


def failed(n_words: int, n_repeat: int) -> bool:
    return n_words < LEAST or 100 * n_repeat > PERCENT * n_words


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two count vectors, 0 to 1."""
    p, q = p / max(p.sum(), 1), q / max(q.sum(), 1)
    m = (p + q) / 2
    part = lambda x: float(np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])))
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, np.ndarray, dict[bytes, int], np.ndarray]]:
    """(language, character counts, number of each common word, word counts with all others last), by language."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")

    def count(batches):
        chars: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def out():
            for lang, c in chars.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * CLASSES), pa.array([str(i).encode() for i in range(CLASSES)], pa.binary()), pa.array(c, pa.int64()), pa.array([True] * CLASSES)], ["lang", "item", "n", "is_char"])
            for lang, c in words.items():
                items = list(c.items())
                for i in range(0, len(items), 50_000):
                    k, v = zip(*items[i : i + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k, pa.binary()), pa.array(v, pa.int64()), pa.array([False] * len(k))], ["lang", "item", "n", "is_char"])

        for b in batches:
            for text, lang in zip(common.text_bytes(b.column(0)), b.column(1).to_pylist()):
                w = text.split()
                if failed(len(w), repeated_words(w)):
                    continue
                chars[lang] = chars.get(lang, 0) + char_histogram(text)
                words.setdefault(lang, Counter()).update(w)
            if sum(map(len, words.values())) > 1_000_000:  # bounded memory; Spark sums what comes in parts
                yield from out()
                chars, words = {}, {}
        yield from out()

    counts = common.materialize(rows.mapInArrow(count, "lang string, item binary, n long, is_char boolean").groupBy("lang", "is_char", "item").agg(F.sum("n").alias("n")))
    total = counts.groupBy("lang", "is_char").agg(F.sum("n").alias("total"))
    totals = {(r["lang"], r["is_char"]): r["total"] for r in total.collect()}
    # First the best of every hash part, so that no language's words meet in one task.
    part = Window.partitionBy("lang", "part").orderBy(F.desc("n"), "item")
    best = counts.filter("not is_char").withColumn("part", F.pmod(F.xxhash64("item"), F.lit(64)))
    best = best.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= COMMON)
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "item"))).filter(F.col("r") <= COMMON)
    chars = {lang: np.zeros(CLASSES) for lang, is_char in totals if not is_char}
    words: dict[str, list] = {lang: [] for lang in chars}
    for r in best.select("lang", "item", "n").collect():
        words[r["lang"]].append((-r["n"], bytes(r["item"])))
    for r in counts.filter("is_char").collect():
        if r["lang"] in chars:
            chars[r["lang"]][int(bytes(r["item"]))] = r["n"]
    out = []
    for lang in sorted(chars):
        mine = sorted(words[lang])
        n = np.array([-x[0] for x in mine], float)
        out.append((lang, chars[lang], {w: i for i, (_, w) in enumerate(mine)}, np.append(n, totals[lang, False] - n.sum())))
    common.drop(counts)
    return out


def divergence(text: bytes, words: list[bytes], refs: list) -> tuple[float, float]:
    """Least distance to a reference's characters and to a reference's common words (1.0 without references)."""
    chars, counted = char_histogram(text), Counter(words)
    far = far_words = 1.0
    for _, c, number, n in refs:
        far = min(far, distance(chars, c))
        mine = np.zeros(len(n))
        small, large = (counted, number) if len(counted) < len(number) else (number, counted)
        for w in small:
            if w in large:
                mine[number[w]] = counted[w]
        mine[-1] = len(words) - mine.sum()
        far_words = min(far_words, distance(mine, n))
    return far, far_words


def strays(n_words: int, n_chars: int, far: float, far_words: float) -> bool:
    """The method's verdict against a document."""
    if n_chars < LEAST_CHARS or n_words < LEAST_WORDS:
        return False
    return far > FAR + FAR_SHORT * n_words**-0.5 or far_words > FAR_WORDS + FAR_WORDS_SHORT * n_words**-0.5


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def judge(docs: DataFrame, carry: list[str], text_col: str = "text", lang_col: str = "lang", refs: list | None = None) -> DataFrame:
    """``carry`` columns of ``docs`` and the columns of :data:`SCHEMA`, in one pass after the references."""
    refs = references(docs, text_col, lang_col) if refs is None else refs
    at = carry.index(text_col) if text_col in carry else len(carry)
    rows = docs.select(*carry, *([text_col] if at == len(carry) else []))
    shared = docs.sparkSession.sparkContext.broadcast(refs)  # COMMON words a language
    names = SCHEMA.replace(",", "").split()[::2]

    def run(batches):
        refs = shared.value
        for b in batches:
            found = []
            for text in common.text_bytes(b.column(at)):
                w = text.split()
                n = base(text, w)
                bad = failed(n[0], n[4])
                far, far_words = divergence(text, w, refs) if refs and not bad else (None, None)
                keep = not bad and not (refs and strays(n[0], n[1], far, far_words))
                found.append((*n, bad, keep, far, far_words))
            cols = list(zip(*found)) if found else [()] * 9
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], *[pa.array(c, t) for c, t in zip(cols, types)]], [*b.schema.names[: len(carry)], *names])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(carry)])
    return rows.mapInArrow(run, f"{head}, {SCHEMA}")


def report(docs: DataFrame) -> DataFrame:
    """One row a document with all figures."""
    return judge(docs, ["doc_id"])


def keep(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that pass, with the columns of ``docs``."""
    names = [f"{P}c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    of = dict(zip(docs.columns, names))
    refs = references(plain, of[text_col], of[lang_col])
    judged = judge(plain, names, of[text_col], of[lang_col], refs)
    return judged.filter("kept").select(*names).toDF(*docs.columns)

"""Boxes as columns. A box is a struct x1, y1, x2, y2; pages say in which direction y grows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from . import regex as R


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def x_overlap(a: Column, b: Column) -> Column:
    """Negative when apart."""
    return F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])


def y_overlap(a: Column, b: Column) -> Column:
    return F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])


def intersection(a: Column, b: Column) -> Column:
    """Shared area."""
    w, h = x_overlap(a, b), y_overlap(a, b)
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def coverage(a: Column, b: Column) -> Column:
    """The share of ``a`` inside ``b``."""
    return intersection(a, b) / F.greatest(area(a), F.lit(1e-6))


def flip(b: Column, page_height: Column) -> Column:
    """From y-up to y-down and back."""
    return box(b["x1"], page_height - b["y2"], b["x2"], page_height - b["y1"])


def affine(m: Column, n: Column) -> Column:
    """Product of two matrices a b c d e f, ``n`` applied first."""
    return F.array(
        m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3], m[1] * n[2] + m[3] * n[3],
        m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5],
    )


def apply_affine(m: Column, x: Column, y: Column) -> Column:
    """M03."""
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))


def vertical_sliver(b: Column) -> Column:
    """F05."""
    w, h = width(b), height(b)
    return (w > 0) & (h > 0) & (h > w * 6) & (w < 30)


def margin_sidebar(b: Column, page_width: Column, font: Column, body: Column) -> Column:
    """narrow, tall and at an outer edge, unless set as large as the body."""
    w = width(b)
    as_body = (font > 0) & (body > 0) & (font >= body * 0.9)
    return (w > 0) & (page_width > 0) & ~F.coalesce(as_body, F.lit(False)) & (w < page_width * 0.24) & (height(b) >= 30) & ((b["x2"] < page_width * 0.34) | (b["x1"] > page_width * 0.66))


def running_head_or_foot(b: Column, page_height: Column, lines: Column, text: Column) -> Column:
    """F09 (y up): page numbers and short runs in the outer 8 %; a lower-case continuation is body text."""
    t = R.trim(text)
    band = page_height * 0.08
    number = R.like(t, r"^\d{1,4}$") | R.like(t, r"^\d{1,3}\s*[/／|]\s*\d{1,3}$")
    foot = R.like(t, X.JOURNAL_FOOT, True) | R.like(t, r"\d+\s*;\s*\d+")
    return (page_height > 0) & ((b["y1"] > page_height - band) | (b["y2"] < band)) & (number | (~(R.like(t, "^[a-z]") & ~foot) & (lines <= 2) & (F.length(t) <= 140)))


def header_or_footer(b: Column, page_height: Column, lines: Column, text: Column) -> Column:
    """F12 (y up): a bare number or one short line in the outer band."""
    t = R.trim(text)
    band = page_height * 0.08
    return (page_height > 0) & ((b["y1"] > page_height - band) | (b["y2"] < band)) & (R.like(t, r"^\d{1,4}$") | ((lines <= 1) & (F.length(t) <= 120)))


def reaches_right_margin(x2: Column, column_right: Column, font: Column) -> Column:
    """F17."""
    return x2 >= column_right - F.greatest(font * 1.6, F.lit(6.0))


def share_column(a: Column, b: Column) -> Column:
    """they overlap by half of the narrower."""
    over, narrow = x_overlap(a, b), F.least(width(a), width(b))
    return (over > 0) & ((narrow <= 0) | (over / narrow >= 0.5))


def paragraph_break(size: Column, gap: Column, wrapped: Column, new_column: Column, indented: Column, font_jump: Column, list_start: Column, short: Column, dots: Column) -> Column:
    """F19."""
    em = F.when(size > 0, size).otherwise(10.0)
    return (
        F.when(new_column | list_start | dots, True)
        .when(short & ~wrapped, True)
        .when(gap > em * 1.7, True)
        .when(indented | font_jump, True)
        .when(wrapped, False)
        .otherwise(gap > em * 0.75)
    )


def classify(text: Column, lines: Column, font: Column, body: Column, bold: Column) -> Column:
    """type of a block."""
    from . import text as T

    t = R.trim(text)
    n, ratio = F.length(t), F.when((body > 0) & (font > 0), font / body).otherwise(1.0)
    return (
        F.when(R.like(t, X.FIGURE_OR_TABLE, True), F.when(R.like(t, "^(?:table|表)", True), "table").otherwise("caption"))
        .when(R.like(t, X.BULLET) | (T.ordered_list_start(t) & (ratio < 1.1)), "list")
        .when((lines <= 2) & (ratio >= 1.35) & (n < 250), "title")
        .when((lines <= 2) & (n < 160) & ((ratio >= 1.1) | T.section_number(t) | (bold & (ratio >= 0.98) & (n < 90) & ~T.ends_sentence(t)) | R.like(t, X.SECTION_WORD, True)), "heading")
        .otherwise("paragraph")
    )


def classify_span(text: Column, lines: Column, font: Column, body: Column) -> Column:
    """as F20 for spans: a title may have four lines, what goes on from the line before is prose, and bold type says nothing."""
    from . import text as T

    t = R.trim(text)
    n, ratio = F.length(t), F.when((body > 0) & (font > 0), font / body).otherwise(1.0)
    return (
        F.when(R.like(t, X.FIGURE_OR_TABLE, True), F.when(R.like(t, "^(?:table|表)", True), "table").otherwise("caption"))
        .when(R.like(t, X.BULLET) | (T.ordered_list_start(t) & (ratio < 1.1)), "list")
        .when(T.starts_continuation(t), "paragraph")
        .when((lines <= 4) & (ratio >= 1.35) & (n < 250), "title")
        .when((lines <= 2) & (n < 160) & ((ratio >= 1.1) | T.section_number(t) | R.like(t, X.SECTION_WORD, True)), "heading")
        .otherwise("paragraph")
    )


def math_glyph(font: Column, c: Column) -> Column:
    """a mathematical font, symbol, or an undecoded glyph."""
    return R.like(F.lower(F.coalesce(font, F.lit(""))), X.MATH_FONT) | R.like(c, "^" + X.MATH_SYMBOL) | c.startswith("(cid:")


def span_text(items: Column, font: Column) -> Column:
    """Text of a line's items (structs x1, x2, text, in order): a space where the gap is over 0.18 em, none between ideographs; white space in the result is single spaces."""
    def step(a: Column, i: Column) -> Column:
        last = F.right(a["t"], F.lit(1))
        cjk = R.like(last, X.IDEOGRAPH) & R.like(i["text"], "^" + X.IDEOGRAPH)
        space = (a["t"] != "") & (i["x1"] - a["x"] > 0.18 * font) & ~cjk & ~R.like(last, r"\s")
        return F.struct(F.concat(a["t"], F.when(space, " ").otherwise(""), i["text"]).alias("t"), i["x2"].alias("x"))

    return F.aggregate(items, F.struct(F.lit("").alias("t"), F.lit(0.0).alias("x")), step, lambda a: R.trim(R.replace(a["t"], r"\s+", " ")))


def column_of(b: Column, bands: Column, page_width: Column) -> Column:
    """Index of the band (array of structs left, right) with the largest overlap; -1 for full width, 0 for none."""
    over = F.transform(bands, lambda k, i: F.struct((F.least(b["x2"], k["right"]) - F.greatest(b["x1"], k["left"])).alias("o"), (-i).alias("i")))
    best = F.array_max(F.filter(over, lambda x: x["o"] > 0))
    return F.when(F.size(bands) == 0, 0).when((F.size(bands) > 1) & (width(b) >= page_width * 0.62), -1).otherwise(F.coalesce(-best["i"], F.lit(0)))


def char_budget(lines: Column, font: Column, kind: Column, target: Column) -> Column:
    """Room for Chinese characters in the line boxes of a body block, or null."""
    columns = F.aggregate(lines, F.lit(0.0), lambda a, r: a + F.when(width(r) > 0, width(r) / font).otherwise(0.0))
    room = F.floor(columns * 0.9)
    return F.when(target.ilike("zh%") & kind.isin("paragraph", "list") & (font > 0) & (room >= 24), room)


def capacity(w: Column, h: Column, font: Column) -> Column:
    """Characters that a rectangle holds at a line height of 1.18, less 5 %; 8 at least."""
    room = F.floor(F.floor(w / font) * F.floor(h / (font * 1.18)) * 0.95)
    return F.when((w > 0) & (h > 0) & (font > 0), F.greatest(F.lit(8), room)).otherwise(8)


def translated_size(points: Column, pixels: Column, body: Column) -> Column:
    """Size on screen, within 5 and 48; a block without a size has the body's, else 10."""
    pt = F.when(points > 0, points).when(body > 0, body).otherwise(10.0)
    return F.greatest(F.lit(5.0), F.least(F.lit(48.0), pt * pixels))


def factor(value: Column) -> Column:
    """A chosen scale within 0.7 and 1.4; 1 for none."""
    v = value.cast("double")
    return F.when(v.isNull() | F.isnan(v) | (v <= 0), 1.0).otherwise(F.greatest(F.lit(0.7), F.least(F.lit(1.4), v)))


def font_bounds(box_height: Column, lines: Column, least: float = 4.0) -> Column:
    """Struct least, most."""
    return F.struct(F.lit(least).alias("least"), F.greatest(F.lit(least), F.least(F.lit(30.0), box_height / F.greatest(lines, F.lit(1)) * 0.82)).alias("most"))


#: Line height and letter spacing of each step.
TYPE_LADDER = ((1.42, 0.0), (1.32, 0.0), (1.32, -0.01), (1.24, -0.01), (1.18, -0.02))


def estimated_height(chars: Column, font: Column, w: Column, step: int) -> Column:
    """Height of so many characters at a step of the type ladder."""
    line, spacing = TYPE_LADDER[step]
    per_line = F.greatest(F.lit(1), F.floor(w / F.greatest(F.lit(1.0), font * (1 + spacing))))
    return F.ceil(chars / per_line) * font * line


def fitting_step(chars: Column, font: Column, w: Column, h: Column) -> Column:
    """First step of the ladder whose height fits, or null."""
    out = F.lit(None).cast("int")
    for step in reversed(range(len(TYPE_LADDER))):
        out = F.when(estimated_height(chars, font, w, step) <= h, step).otherwise(out)
    return out


def expansion(b: Column, blockers: Column, page_width: float, page_height: float, font: Column) -> Column:
    """M08 (y down): room to the right and down until the page's edge or the nearest blocker, within limits."""
    right0, down0 = F.greatest(F.lit(0.0), page_width * 0.9 - b["x2"]), F.greatest(F.lit(0.0), page_height * 0.95 - b["y2"])
    right = F.aggregate(F.filter(blockers, lambda o: (y_overlap(b, o) > 2) & (o["x2"] > b["x2"] - 1)), right0, lambda a, o: F.least(a, o["x1"] - b["x2"] - 3))
    down = F.aggregate(F.filter(blockers, lambda o: (x_overlap(b, o) > 2) & (o["y2"] > b["y2"] - 1)), down0, lambda a, o: F.least(a, o["y1"] - b["y2"] - 3))
    return F.struct(F.greatest(F.lit(0.0), F.least(right, width(b) * 0.6)).alias("right"), F.greatest(F.lit(0.0), F.least(down, F.greatest(font * 2.8, height(b) * 0.5))).alias("down"))


def over_ink(b: Column, images: Column) -> Column:
    """More than 2 % of a box lies on an image."""
    return (area(b) > 0) & F.exists(images, lambda i: intersection(b, i) > area(b) * 0.02)


def penetrates(a: Column, b: Column, slack: float = 4.0) -> Column:
    """Boxes that really run into each other: over the slack both ways and over 12 % of the narrower."""
    w, h = x_overlap(a, b), y_overlap(a, b)
    return (w > slack) & (h > slack) & (w > F.least(width(a), width(b)) * 0.12 + slack)


def obstacle_between(a: Column, b: Column, obstacles: Column) -> Column:
    """J09 (y up): a figure stands in the vertical gap of two boxes."""
    upper = F.when(a["y1"] >= b["y1"], a).otherwise(b)
    lower = F.when(a["y1"] >= b["y1"], b).otherwise(a)
    top, bottom = upper["y1"], lower["y2"]
    gap = top - bottom
    return (gap >= 2) & F.exists(obstacles, lambda o: (x_overlap(o, a) >= 6) & (x_overlap(o, b) >= 6) & (F.least(top, o["y2"]) - F.greatest(bottom, o["y1"]) >= F.least(F.lit(4.0), gap * 0.5)))


def gap_x(a: Column, b: Column) -> Column:
    """Horizontal gap; negative where they overlap."""
    return F.greatest(a["x1"] - b["x2"], b["x1"] - a["x2"])


def gap_y(a: Column, b: Column) -> Column:
    """Vertical gap; 0 where they share a height."""
    return F.greatest(F.lit(0.0), a["y1"] - b["y2"], b["y1"] - a["y2"])


def share_x(a: Column, b: Column) -> Column:
    """Horizontal overlap as a share of the narrower, negative when apart."""
    narrow = F.least(width(a), width(b))
    return F.when(narrow > 0, x_overlap(a, b) / narrow).otherwise(0.0)


def in_gutter(a: Column, b: Column, others: Column, slack: float = 0.0) -> Column:
    """Something stands between two boxes that lie side by side, at a height they share (``slack`` wider for cells)."""
    left, right = F.least(a["x2"], b["x2"]), F.greatest(a["x1"], b["x1"])
    top, bottom = F.greatest(a["y1"], b["y1"]) - slack, F.least(a["y2"], b["y2"]) + slack
    return (right > left) & (bottom > top) & F.exists(others, lambda o: (o["x1"] < right) & (o["x2"] > left) & (o["y1"] < bottom) & (o["y2"] > top))

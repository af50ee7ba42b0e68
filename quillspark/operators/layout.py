"""Page layout in DataFrame windows: lines, paragraphs, reading order, sizes. Rows are keyed by (doc_id, page) and ordered by ``ord``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import geometry as G
from ..functions import regex as R
from ..functions import text as T

PAGE = ("doc_id", "page")


def _page(*order) -> Window:
    return Window.partitionBy(*PAGE).orderBy(*(order or ("ord",)))


def islands(df: DataFrame, starts: Column, name: str, keys: tuple = PAGE, order: tuple = ("ord",)) -> DataFrame:
    """Number of the island each row is in; ``starts`` is true where a new one begins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, (F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(w) - F.first(F.coalesce(starts, F.lit(True)).cast("int")).over(w)).cast("int"))


def line_groups(chars: DataFrame) -> DataFrame:
    """A line ends after a glyph with the flag ``line_break_after``."""
    before = F.coalesce(F.lag("line_break_after").over(_page("pos")), F.lit(False))
    return islands(chars, before, "line", order=("pos",))


def lines_from_rows(items: DataFrame, gutter: Column) -> DataFrame:
    """Items of a row, left to right, cut where they cross a gutter or leave more than max(1.6 em, 12)."""
    w = Window.partitionBy(*PAGE, "row").orderBy("x1", "ord")
    gap = F.col("x1") - F.lag("x2").over(w)
    slack = F.least(F.lit(6.0), F.col("font") * 0.6)
    crosses = (F.lag("x2").over(w) <= gutter + slack) & (F.col("x1") >= gutter - slack)
    return islands(items, crosses | (gap > F.greatest(F.col("font") * 1.6, F.lit(12.0))), "part", (*PAGE, "row"), ("x1", "ord"))


def paragraphs(lines: DataFrame, column_right: Column) -> DataFrame:
    """F19 between each line and the one before (y down)."""
    w = _page()
    prev = lambda c: F.lag(c).over(w)
    size = F.greatest(prev("font"), F.col("font"))
    brk = G.paragraph_break(
        size,
        F.col("y1") - prev("y2"),
        G.reaches_right_margin(prev("x2"), column_right, prev("font")),
        prev("column") != F.col("column"),
        F.col("x1") - prev("x1") > size,
        F.abs(F.col("font") - prev("font")) > size * 0.2,
        T.list_start(F.col("text")),
        prev("x2") - prev("x1") < (column_right - prev("x1")) * 0.6,
        T.leader_dots(prev("text")),
    )
    return islands(lines, brk, "paragraph")


def repair_merges(paragraphs_: DataFrame) -> DataFrame:
    """Neighbouring body blocks that one sentence runs through become one group; only the last member matters, so lag is enough."""
    w = _page()
    prev = lambda c: F.lag(c).over(w)
    size = F.when(prev("font") > 0, prev("font")).otherwise(10.0)
    merge = (
        (F.least(F.col("x2"), prev("x2")) - F.greatest(F.col("x1"), prev("x1")) >= 0.5 * F.least(F.col("x2") - F.col("x1"), prev("x2") - prev("x1")))
        & (F.least(F.col("x2"), prev("x2")) - F.greatest(F.col("x1"), prev("x1")) > 0)
        & (prev("type") == "paragraph")
        & (F.col("type") == "paragraph")
        & (prev("gap_after").isNull() | (prev("gap_after") <= size * 1.2))
        & ~T.ends_sentence(prev("text"))
        & ~T.list_start(F.col("text"))
        & (T.starts_continuation(F.col("text")) | R.like(R.trim(prev("text")), "[,，、;；:：]$"))
    )
    return islands(paragraphs_, ~F.coalesce(merge, F.lit(False)), "group")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Dense reading_index within a page.

    Bands are set by full-width blocks (column -1): a block's band is the number of these that end above it (2 points of slack). That count is
    an array search over the page's few full-width blocks, not a join. Pages with under four blocks, missing geometry or fewer than two
    columns keep the order they have."""
    page = Window.partitionBy(*PAGE)
    ready = (F.count("*").over(page) >= 4) & (F.sum((F.col("y1").isNull() | F.col("column").isNull()).cast("int")).over(page) == 0)
    columns = F.size(F.array_distinct(F.filter(F.collect_list("column").over(page), lambda c: c >= 0)))
    wides = F.array_sort(F.filter(F.collect_list(F.struct(F.col("y1").alias("y"), F.col("ord").alias("o"), F.col("y2").alias("e"), F.col("column").alias("c"))).over(page), lambda s: s["c"] == -1))
    band = F.size(F.filter("_wides", lambda s: s["e"] <= F.col("y1") + 2))
    mine = F.size(F.filter("_wides", lambda s: (s["y"] < F.col("y1")) | ((s["y"] == F.col("y1")) & (s["o"] < F.col("ord")))))
    out = blocks.withColumn("_ready", ready & (columns >= 2)).withColumn("_wides", wides)
    key = F.when(~F.col("_ready"), 0).when(F.col("column") == -1, 2 * mine + 1).otherwise(2 * band)
    out = out.withColumn("_k", key).withColumn("_c", F.when(F.col("_ready"), F.col("column")).otherwise(0)).withColumn("_y", F.when(F.col("_ready"), F.col("y1")).otherwise(0.0))
    return out.withColumn("reading_index", (F.row_number().over(_page("_k", "_c", "_y", "ord")) - 1).cast("int")).drop("_ready", "_wides", "_k", "_c", "_y")


def two_column_order(blocks: DataFrame) -> DataFrame:
    """W06 (y down): on pages whose stream jumps back from the right column (1) to the left (0): full-width blocks above the columns, left, right,
    full-width blocks below; other pages keep their order. (``place`` is dense.)"""
    page = Window.partitionBy(*PAGE)
    right = F.min(F.when(F.col("column") == 1, F.col("ord"))).over(page)
    mixed = F.coalesce(F.max(F.when(F.col("column") == 0, F.col("ord"))).over(page) > right, F.lit(False))
    top = F.min(F.when(F.col("column") >= 0, F.col("y1"))).over(page)
    part = F.when(F.col("column") >= 0, F.col("column") + 1).when(F.col("y1") < top, 0).otherwise(3)
    out = blocks.withColumn("_p", F.when(mixed, part).otherwise(0)).withColumn("_y", F.when(mixed, F.col("y1")).otherwise(0.0))
    return out.withColumn("place", (F.row_number().over(_page("_p", "_y", "ord")) - 1).cast("int")).drop("_p", "_y")  # L01: ties by stream order


def list_ended(lines: DataFrame) -> DataFrame:
    """Pages of three lines or more, 80 % of which end like list items."""
    ends = R.like(R.trim(F.col("text")), "[.。;；]$").cast("int")
    return lines.filter(R.trim(F.col("text")) != "").groupBy(*PAGE).agg(F.count("*").alias("n"), F.avg(ends).alias("share")).select(*PAGE, ((F.col("n") >= 3) & (F.col("share") >= 0.8)).alias("list"))


def ordered_union(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct runs of merged blocks, in the order of first occurrence."""
    rows = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "runs"))).alias("r"))
    return rows.select(*keys, F.array_distinct(F.flatten(F.transform("r", lambda x: x["runs"]))).alias("runs"))


def order_reversed(lines: DataFrame) -> DataFrame:
    """Pages on which more moves go up than down, by at least 30 % of a line (y down)."""
    move = F.col("y1") - F.lag("y1").over(_page())
    dead = 0.3 * F.greatest(F.col("y2") - F.col("y1"), F.lag(F.col("y2") - F.col("y1")).over(_page()))
    moves = lines.select(*PAGE, (move < -dead).cast("int").alias("up"), (move > dead).cast("int").alias("down"))
    return moves.groupBy(*PAGE).agg((F.coalesce(F.sum("up"), F.lit(0)) > F.coalesce(F.sum("down"), F.lit(0))).alias("reversed"))


def reference_cut(blocks: DataFrame) -> DataFrame:
    """without what follows a references heading, on its page or a later one; the heading stays."""
    w = Window.partitionBy("doc_id").orderBy("page", "ord")
    heading = R.like(R.trim(F.col("text")), X.REFERENCES, True).cast("int")
    seen = F.coalesce(F.max(heading).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("_seen", seen).filter("_seen = 0").drop("_seen")


def dominant_size(rows: DataFrame, size: Column, weight: Column | None = None) -> DataFrame:
    """The half-point bucket with the largest count (or weight) on each page; the larger size wins ties."""
    buckets = rows.filter(size > 0).groupBy(*PAGE, (F.round(size * 2) / 2).alias("bucket")).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    return buckets.groupBy(*PAGE).agg(F.max(F.struct("n", "bucket"))["bucket"].alias("dominant"))


def longest_first(literals: Column) -> Column:
    """Texts of an array of structs (place, text), the longest first, then by place."""
    key = F.transform(literals, lambda x: F.struct((-F.length(x["text"])).alias("n"), x["place"].alias("place"), x["text"].alias("text")))
    return F.transform(F.array_sort(key), lambda x: x["text"])


def upper_median(values: Column) -> Column:
    """Of an array: the element at floor(n / 2) in order."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def page_sizes(blocks: DataFrame) -> DataFrame:
    """A03-A06 of a page: upper median, least size near it, anchor size, and the body size from long paragraphs."""
    sizes = blocks.filter(F.col("font") > 0).groupBy(*PAGE).agg(F.collect_list("font").alias("all"), F.collect_list(F.when(F.length("text") > 100, F.col("font"))).alias("long"))
    m = upper_median(F.col("all"))
    near = lambda lo: F.array_min(F.filter("all", lambda s: (s >= m * lo) & (s <= m * 1.25)))
    return sizes.select(*PAGE, m.alias("median"), near(0.75).alias("cluster_least"), near(0.8).alias("anchor"), F.when(F.size("long") > 0, upper_median(F.col("long"))).otherwise(m).alias("body"))


def union_box(blocks: DataFrame, *keys: str) -> DataFrame:
    """A07."""
    return blocks.groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def outside_figures(lines: DataFrame, figures: DataFrame, share: float = 0.6) -> DataFrame:
    """Lines less than ``share`` inside any figure of their page. Figures of a page are few: they meet their lines as one array."""
    boxes = figures.groupBy(*PAGE).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_f"))
    me = F.struct("x1", "y1", "x2", "y2")
    out = lines.join(boxes, list(PAGE), "left")
    return out.filter(~F.exists(F.coalesce("_f", F.array().cast("array<struct<x1: double, y1: double, x2: double, y2: double>>")), lambda o: G.coverage(me, o) >= share)).drop("_f")


def inside_regions(blocks: DataFrame, regions: DataFrame, share: float = 0.5) -> DataFrame:
    """(block, region) pairs of a page where at least ``share`` of the block lies in the region."""
    r = regions.select(*PAGE, F.col("region"), F.struct("x1", "y1", "x2", "y2").alias("_r"))
    return blocks.join(r, list(PAGE)).filter(G.coverage(F.struct("x1", "y1", "x2", "y2"), F.col("_r")) >= share).drop("_r")


def overlapping_pairs(boxes: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Pairs a < b of one page that share more than ``tolerance`` area. A page has a bounded number of boxes."""
    a, b = (boxes.select(*PAGE, F.col("ord").alias(n), F.struct("x1", "y1", "x2", "y2").alias(f"_{n}")) for n in ("a", "b"))
    return a.join(b, list(PAGE)).filter("a < b").withColumn("area", G.intersection(F.col("_a"), F.col("_b"))).filter(F.col("area") > tolerance).select(*PAGE, "a", "b", "area")


def audit(boxes: DataFrame, images: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """What moving boxes (x1.. now, o1.. before) has added: overlaps, hidden images, room outside the page; largest first by ``area``."""
    now, was = F.struct("x1", "y1", "x2", "y2"), F.struct(F.col("ox1").alias("x1"), F.col("oy1").alias("y1"), F.col("ox2").alias("x2"), F.col("oy2").alias("y2"))
    rows = boxes.select(*PAGE, "ord", now.alias("now"), was.alias("was"))
    tol = lambda p, q: F.greatest(F.lit(12.0), 0.02 * F.least(G.area(p), G.area(q)))
    a = rows.select(*PAGE, F.col("ord").alias("a"), F.col("now").alias("na"), F.col("was").alias("wa"))
    b = rows.select(*PAGE, F.col("ord").alias("b"), F.col("now").alias("nb"), F.col("was").alias("wb"))
    pairs = a.join(b, list(PAGE)).filter("a < b").withColumn("area", G.intersection(F.col("na"), F.col("nb")) - G.intersection(F.col("wa"), F.col("wb")))
    pairs = pairs.filter(F.col("area") > tol(F.col("na"), F.col("nb")))
    first = G.area(F.col("na")) - G.area(F.col("wa")) >= G.area(F.col("nb")) - G.area(F.col("wb"))
    overlap = pairs.select(*PAGE, F.lit("overlap").alias("kind"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("id"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"), "area")
    img = images.select(*PAGE, F.struct("x1", "y1", "x2", "y2").alias("i"))
    hidden = rows.join(img, list(PAGE)).withColumn("area", G.intersection(F.col("now"), F.col("i")) - G.intersection(F.col("was"), F.col("i"))).filter(F.col("area") > tol(F.col("now"), F.col("i")))
    hidden = hidden.select(*PAGE, F.lit("occludes-image").alias("kind"), F.col("ord").alias("id"), F.lit(None).cast("int").alias("other"), "area")
    page = G.box(F.lit(0), F.lit(0), F.lit(page_width), F.lit(page_height))
    out = lambda c: F.greatest(F.lit(0.0), G.area(c) - G.intersection(c, page))
    outside = rows.withColumn("area", out(F.col("now")) - out(F.col("was"))).filter("area > 12").select(*PAGE, F.lit("out-of-page").alias("kind"), F.col("ord").alias("id"), F.lit(None).cast("int").alias("other"), "area")
    return overlap.unionByName(hidden).unionByName(outside)


def grouping_health(pages: DataFrame) -> DataFrame:
    """pages with 40 fragments or more that hardly grouped."""
    return pages.filter((F.col("fragments") >= 40) & (F.col("units") / F.col("fragments") > 0.85))


def contract(blocks: DataFrame) -> DataFrame:
    """Contract of section 1.4: one row a violation: (doc_id, page, id, rule)."""
    w, page = Window.partitionBy("doc_id", "page", "id"), _page()
    flags = blocks.withColumn("_dup", F.count("*").over(w) > 1).withColumn("_rank", F.row_number().over(page) - 1)
    rules = F.filter(
        F.array(
            F.when(F.col("_dup"), "duplicate id"),
            F.when(~F.col("reading_index").eqNullSafe(F.col("_rank")), "reading index not dense"),
            F.when(F.col("table_row").isNull() != F.col("table_col").isNull(), "half a table cell"),
            F.when((F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1")), "empty box"),
            F.when(F.size("member_ids") == 0, "no members"),
            F.when((F.col("mode") == "preserve") & (F.size("placeholders") > 0), "preserved block with placeholders"),
        ),
        lambda r: r.isNotNull(),
    )
    return flags.select("doc_id", "page", "id", F.explode(rules).alias("rule"))

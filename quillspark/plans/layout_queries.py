"""Queries for page layout, packing and planning, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import geometry as G
from ..functions import hashing, similarity
from ..functions import text as T
from ..functions.regex import SPACE, re2
from ..operators import chunks, layout
from . import pages, snippets

W, H = pages.PAGE_WIDTH, pages.PAGE_HEIGHT


def BOX():
    return F.struct("x1", "y1", "x2", "y2")


_TRIM = rf"regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def _like(t: str, p: str, i: bool = False) -> str:
    return f"regexp_matches({t}, {re2(p, i)})"


def _block_query(value):
    return lambda spark, d: pages.blocks(spark, d).select("doc_id", "page", "ord", value().alias("value"))


def _block_sql(value: str) -> str:
    return f"{pages.sql()}, t AS (SELECT *, {_TRIM} AS t FROM b)\nSELECT doc_id, page, ord, {value} AS value FROM t"


_BAND = f"({H} > 0 AND (y1 > {H} - {H} * 0.08 OR y2 < {H} * 0.08))"
_FOOT = f"({_like('t', X.JOURNAL_FOOT, True)} OR regexp_matches(t, '\\d+[{SPACE}]*;[{SPACE}]*\\d+'))"
_NUMBER = f"(regexp_matches(t, '^\\d{{1,4}}$') OR regexp_matches(t, '^\\d{{1,3}}[{SPACE}]*[/／|][{SPACE}]*\\d{{1,3}}$'))"
_BOLD = f"(regexp_matches(lower(font_name), {re2(X.BOLD_FONT)}) AND NOT (regexp_matches(lower(font_name), {re2(X.LIGHT_FONT)}) AND NOT regexp_matches(lower(font_name), 'bold|black|heavy')))"
_RATIO = "(CASE WHEN font > 0 THEN font / 10.0::DOUBLE ELSE 1 END)"
_ORDERED = f"(NOT {_like('t', X.SECTION_PREFIX)} AND {_like('t', X.ORDERED_LIST)})"
_CLASS = f"""CASE WHEN {_like('t', X.FIGURE_OR_TABLE, True)} THEN CASE WHEN regexp_matches(t, '(?i)^(?:table|表)') THEN 'table' ELSE 'caption' END
  WHEN {_like('t', X.BULLET)} OR ({_ORDERED} AND {_RATIO} < 1.1) THEN 'list'
  WHEN lines <= 2 AND {_RATIO} >= 1.35 AND length(t) < 250 THEN 'title'
  WHEN lines <= 2 AND length(t) < 160 AND ({_RATIO} >= 1.1 OR {_like('t', X.SECTION_NUMBER)} OR ({_BOLD} AND {_RATIO} >= 0.98 AND length(t) < 90 AND NOT {_like('t', X.ENDS_SENTENCE)}) OR {_like('t', X.SECTION_WORD, True)}) THEN 'heading' ELSE 'paragraph' END"""
_CLASS_SPAN = f"""CASE WHEN {_like('t', X.FIGURE_OR_TABLE, True)} THEN CASE WHEN regexp_matches(t, '(?i)^(?:table|表)') THEN 'table' ELSE 'caption' END
  WHEN {_like('t', X.BULLET)} OR ({_ORDERED} AND {_RATIO} < 1.1) THEN 'list' WHEN {_like('t', X.STARTS_CONTINUATION)} THEN 'paragraph' WHEN lines <= 4 AND {_RATIO} >= 1.35 AND length(t) < 250 THEN 'title'
  WHEN lines <= 2 AND length(t) < 160 AND ({_RATIO} >= 1.1 OR {_like('t', X.SECTION_NUMBER)} OR {_like('t', X.SECTION_WORD, True)}) THEN 'heading' ELSE 'paragraph' END"""
_BANDS = "[{'l': 50.0::DOUBLE, 'r': 290.0::DOUBLE}, {'l': 300.0::DOUBLE, 'r': 560.0::DOUBLE}]"

BLOCKS = {
    "f05_vertical_sliver": (lambda: G.vertical_sliver(G.box(F.col("x1"), F.col("y1"), F.col("x1") + F.pmod("k", F.lit(9)), F.col("y2"))), "k % 9 > 0 AND y2 - y1 > 0 AND y2 - y1 > (k % 9) * 6 AND k % 9 < 30"),
    "f09_running_head": (lambda: G.running_head_or_foot(BOX(), F.lit(H), F.col("lines"), F.col("text")), f"{_BAND} AND ({_NUMBER} OR (NOT (regexp_matches(t, '^[a-z]') AND NOT {_FOOT}) AND lines <= 2 AND length(t) <= 140))"),
    "f10_margin_sidebar": (lambda: G.margin_sidebar(G.box(F.col("x1"), F.col("y1"), F.col("x1") + F.pmod("k", F.lit(200)), F.col("y2")), F.lit(W), F.col("font"), F.lit(10.0)), f"k % 200 > 0 AND NOT font >= 9.0 AND k % 200 < {W} * 0.24 AND y2 - y1 >= 30 AND (x1 + k % 200 < {W} * 0.34 OR x1 > {W} * 0.66)"),
    "f12_header_footer": (lambda: G.header_or_footer(BOX(), F.lit(H), F.col("lines"), F.col("text")), f"{_BAND} AND (regexp_matches(t, '^\\d{{1,4}}$') OR (lines <= 1 AND length(t) <= 120))"),
    "f16_bold_font": (lambda: T.bold_font(F.col("font_name")), _BOLD),
    "f17_right_margin": (lambda: G.reaches_right_margin(F.col("x2"), F.lit(560.0), F.col("font")), "x2 >= 560.0 - greatest(font * 1.6, 6.0)"),
    "f20_classify": (lambda: G.classify(F.col("text"), F.col("lines"), F.col("font"), F.lit(10.0), T.bold_font(F.col("font_name"))), _CLASS),
    "f21_classify_span": (lambda: G.classify_span(F.col("text"), F.col("lines"), F.col("font"), F.lit(10.0)), _CLASS_SPAN),
    "f26_math_glyph": (lambda: G.math_glyph(F.col("font_name"), F.col("text")), f"regexp_matches(lower(font_name), {re2(X.MATH_FONT)}) OR regexp_matches(text, {re2('^' + X.MATH_SYMBOL)}) OR starts_with(text, '(cid:')"),
    "j12_column_of": (lambda: G.column_of(BOX(), F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in ((50.0, 290.0), (300.0, 560.0))]), F.lit(W)), f"CASE WHEN x2 - x1 >= {W} * 0.62 THEN -1 WHEN greatest(least(x2, 290.0) - greatest(x1, 50.0), 0) >= greatest(least(x2, 560.0) - greatest(x1, 300.0), 0) THEN 0 ELSE 1 END"),
    "m02_coverage": (lambda: G.coverage(BOX(), G.box(F.lit(100), F.lit(100), F.lit(400), F.lit(500))), "(CASE WHEN least(x2, 400.0) - greatest(x1, 100.0) > 0 AND least(y2, 500.0) - greatest(y1, 100.0) > 0 THEN (least(x2, 400.0) - greatest(x1, 100.0)) * (least(y2, 500.0) - greatest(y1, 100.0)) ELSE 0.0 END::DOUBLE) / greatest((x2 - x1) * (y2 - y1), 1e-6::DOUBLE)"),
    "m05_char_budget": (lambda: G.char_budget(F.array_repeat(BOX(), F.col("lines")), F.col("font"), F.col("type"), F.lit("zh-CN")), "CASE WHEN type IN ('paragraph', 'list') AND floor(lines * ((x2 - x1) / font) * 0.9::DOUBLE) >= 24 THEN floor(lines * ((x2 - x1) / font) * 0.9::DOUBLE)::BIGINT END"),
    "m06_capacity": (lambda: G.capacity(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("font")), "greatest(8, floor(floor((x2 - x1) / font) * floor((y2 - y1) / (font * 1.18::DOUBLE)) * 0.95::DOUBLE))::BIGINT"),
    "m07_fitting_step": (lambda: G.fitting_step(F.length("text"), F.col("font"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), "CASE " + " ".join(f"WHEN ceil(length(text) / greatest(1, floor((x2 - x1) / greatest(1.0, font * {1 + s}::DOUBLE)))) * font * {lh}::DOUBLE <= y2 - y1 THEN {i}" for i, (lh, s) in enumerate(G.TYPE_LADDER)) + " END::INT"),
    "m07_font_bounds": (lambda: G.font_bounds(F.col("y2") - F.col("y1"), F.col("lines"))["most"], "greatest(4.0, least(30.0, (y2 - y1) / greatest(lines, 1) * 0.82::DOUBLE))::DOUBLE"),
    "m12_over_ink": (lambda: G.over_ink(BOX(), F.array(G.box(F.lit(100), F.lit(100), F.lit(200), F.lit(300)))), "greatest(0, least(x2, 200) - greatest(x1, 100)) * greatest(0, least(y2, 300) - greatest(y1, 100)) > (x2 - x1) * (y2 - y1) * 0.02"),
    "m13_translated_size": (lambda: G.translated_size(F.col("font") - 9, G.factor(F.pmod("k", F.lit(20)) / 10), F.lit(9.5)), "greatest(5.0, least(48.0, (CASE WHEN font - 9 > 0 THEN font - 9 ELSE 9.5::DOUBLE END) * (CASE WHEN k % 20 = 0 THEN 1.0::DOUBLE ELSE greatest(0.7::DOUBLE, least(1.4::DOUBLE, (k % 20)::DOUBLE / 10)) END)))::DOUBLE"),
    "f39_slow_lane": (lambda: T.slow_lane(F.col("type"), F.length("text"), F.pmod("k", F.lit(7)), F.pmod("k", F.lit(23)) == 0), "type = 'table' OR length(text) > 2400 OR k % 7 >= 5 OR k % 23 = 0"),
}


def reading_order(spark, d):
    return layout.reading_order(pages.blocks(spark, d)).select("doc_id", "page", "ord", "reading_index")


_ORDER = f"""{pages.sql()},
p AS (SELECT doc_id, page, count(*) AS n, count(DISTINCT "column") FILTER ("column" >= 0) AS c FROM b GROUP BY ALL),
q AS (SELECT b.*, p.n >= 4 AND p.c >= 2 AS ready,
  (SELECT count(*) FROM b w WHERE w.doc_id = b.doc_id AND w.page = b.page AND w."column" = -1 AND w.y2 <= b.y1 + 2) AS band,
  (SELECT count(*) FROM b w WHERE w.doc_id = b.doc_id AND w.page = b.page AND w."column" = -1 AND (w.y1 < b.y1 OR (w.y1 = b.y1 AND w.ord < b.ord))) AS mine
  FROM b JOIN p USING (doc_id, page))
SELECT doc_id, page, ord, (row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN NOT ready THEN 0 WHEN "column" = -1 THEN 2 * mine + 1 ELSE 2 * band END,
  CASE WHEN ready THEN "column" ELSE 0 END, CASE WHEN ready THEN y1 ELSE 0 END, ord) - 1)::INT AS reading_index FROM q"""


def sizes(spark, d):
    b = pages.blocks(spark, d)
    return layout.page_sizes(b).join(layout.dominant_size(b, F.col("font")), ["doc_id", "page"]).join(layout.dominant_size(b, F.col("font"), F.greatest(F.lit(1), F.length(F.trim("text")))).withColumnRenamed("dominant", "weighted"), ["doc_id", "page"])


_SIZES = f"""{pages.sql()},
m AS (SELECT doc_id, page, list(font ORDER BY font) AS l, list(font ORDER BY font) FILTER (length(text) > 100) AS g FROM b GROUP BY ALL),
n AS (SELECT *, l[len(l) // 2 + 1] AS median FROM m),
c AS (SELECT doc_id, page, round(font * 2) / 2 AS bucket, count(*) AS n, sum(greatest(1, length(trim(text, ' ')))) AS w FROM b GROUP BY ALL)
SELECT doc_id, page, median, list_min(list_filter(l, lambda s: s >= median * 0.75 AND s <= median * 1.25)) AS cluster_least,
  list_min(list_filter(l, lambda s: s >= median * 0.8 AND s <= median * 1.25)) AS anchor, CASE WHEN len(g) > 0 THEN g[len(g) // 2 + 1] ELSE median END AS body,
  (SELECT bucket FROM c WHERE c.doc_id = n.doc_id AND c.page = n.page ORDER BY c.n DESC, bucket DESC LIMIT 1) AS dominant,
  (SELECT bucket FROM c WHERE c.doc_id = n.doc_id AND c.page = n.page ORDER BY c.w DESC, bucket DESC LIMIT 1) AS weighted FROM n"""


def union_boxes(spark, d):
    return layout.union_box(pages.blocks(spark, d), "doc_id", "page", "column")


def pairs(spark, d):
    return layout.overlapping_pairs(pages.blocks(spark, d), 12.0)


_INTER = "CASE WHEN least(p.x2, q.x2) > greatest(p.x1, q.x1) AND least(p.y2, q.y2) > greatest(p.y1, q.y1) THEN (least(p.x2, q.x2) - greatest(p.x1, q.x1)) * (least(p.y2, q.y2) - greatest(p.y1, q.y1)) ELSE 0 END"
_PAIRS = f"{pages.sql()}\nSELECT p.doc_id, p.page, p.ord AS a, q.ord AS b, {_INTER} AS area FROM b p JOIN b q ON p.doc_id = q.doc_id AND p.page = q.page AND p.ord < q.ord WHERE {_INTER} > 12"


def figures(spark, d):
    b = pages.blocks(spark, d)
    return layout.outside_figures(b.filter("column <> -1"), b.filter("column = -1")).select("doc_id", "page", "ord")


_FIGURES = f"{pages.sql()}\nSELECT doc_id, page, ord FROM b p WHERE \"column\" <> -1 AND NOT EXISTS (SELECT 1 FROM b q WHERE q.doc_id = p.doc_id AND q.page = p.page AND q.\"column\" = -1 AND {_INTER} / greatest((p.x2 - p.x1) * (p.y2 - p.y1), 1e-6) >= 0.6)"


def contained(spark, d):
    b = pages.blocks(spark, d)
    return layout.inside_regions(b.filter("column <> -1"), b.filter("column = -1").withColumn("region", F.col("ord"))).select("doc_id", "page", "ord", "region")


_CONTAINED = f"{pages.sql()}\nSELECT p.doc_id, p.page, p.ord, q.ord AS region FROM b p JOIN b q ON q.doc_id = p.doc_id AND q.page = p.page WHERE p.\"column\" <> -1 AND q.\"column\" = -1 AND {_INTER} / greatest((p.x2 - p.x1) * (p.y2 - p.y1), 1e-6) >= 0.5"


def repair(spark, d):
    b = pages.blocks(spark, d).withColumn("gap_after", F.when(F.pmod("k", F.lit(3)) > 0, F.pmod("k", F.lit(20)).cast("double")))
    return layout.repair_merges(b).select("doc_id", "page", "ord", "group")


_REPAIR = f"""{pages.sql()},
g AS (SELECT *, CASE WHEN k % 3 > 0 THEN (k % 20)::DOUBLE END AS gap, {_TRIM} AS t FROM b),
l AS (SELECT *, lag(x1) OVER w AS px1, lag(x2) OVER w AS px2, lag(type) OVER w AS ptype, lag(gap) OVER w AS pgap, lag(font) OVER w AS pfont, lag(t) OVER w AS pt FROM g WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord)),
m AS (SELECT *, coalesce(least(x2, px2) - greatest(x1, px1) > 0 AND least(x2, px2) - greatest(x1, px1) >= 0.5 * least(x2 - x1, px2 - px1) AND ptype = 'paragraph' AND type = 'paragraph' AND (pgap IS NULL OR pgap <= pfont * 1.2)
  AND NOT {_like('pt', X.ENDS_SENTENCE)} AND NOT {_like('t', X.LIST_START)} AND ({_like('t', X.STARTS_CONTINUATION)} OR regexp_matches(pt, '[,，、;；:：]$')), false) AS joined FROM l)
SELECT doc_id, page, ord, (sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY ord) - 1)::INT AS "group" FROM m"""


def paragraph_groups(spark, d):
    return layout.paragraphs(pages.blocks(spark, d), F.lit(560.0)).select("doc_id", "page", "ord", "paragraph")


_PARAGRAPHS = f"""{pages.sql()},
l AS (SELECT *, {_TRIM} AS t, lag(x1) OVER w AS px1, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2, lag(font) OVER w AS pf, lag("column") OVER w AS pc, lag(text) OVER w AS pt FROM b WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord)),
m AS (SELECT *, CASE WHEN pc IS NULL THEN true WHEN pc <> "column" OR {_like('t', X.LIST_START)} OR {_like('pt', X.LEADER_DOTS)} THEN true
  WHEN px2 - px1 < (560.0 - px1) * 0.6 AND NOT px2 >= 560.0 - greatest(pf * 1.6, 6.0) THEN true WHEN y1 - py2 > greatest(pf, font) * 1.7 THEN true
  WHEN x1 - px1 > greatest(pf, font) OR abs(font - pf) > greatest(pf, font) * 0.2 THEN true WHEN px2 >= 560.0 - greatest(pf * 1.6, 6.0) THEN false ELSE y1 - py2 > greatest(pf, font) * 0.75 END AS cut FROM l)
SELECT doc_id, page, ord, (sum(cut::INT) OVER (PARTITION BY doc_id, page ORDER BY ord) - 1)::INT AS paragraph FROM m"""


def cut_references(spark, d):
    return layout.reference_cut(pages.blocks(spark, d)).select("doc_id", "page", "ord")


_CUT = f"{pages.sql()}, f AS (SELECT *, max(({_like(_TRIM, X.REFERENCES, True)})::INT) OVER (PARTITION BY doc_id ORDER BY page, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM b)\nSELECT doc_id, page, ord FROM f WHERE coalesce(seen, 0) = 0"


def reversal(spark, d):
    return layout.order_reversed(pages.blocks(spark, d))


_REVERSAL = f"""{pages.sql()}, l AS (SELECT doc_id, page, y1 - lag(y1) OVER w AS m, 0.3 * greatest(y2 - y1, lag(y2 - y1) OVER w) AS dead FROM b WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord))
SELECT doc_id, page, coalesce(sum((m < -dead)::INT), 0) > coalesce(sum((m > dead)::INT), 0) AS reversed FROM l GROUP BY ALL"""


def audited(spark, d):
    b = pages.blocks(spark, d)
    moved = b.select("doc_id", "page", "ord", "x1", (F.col("y1") + 25).alias("y1"), "x2", (F.col("y2") + 40).alias("y2"), F.col("x1").alias("ox1"), F.col("y1").alias("oy1"), F.col("x2").alias("ox2"), F.col("y2").alias("oy2"))
    return layout.audit(moved.filter("ord % 4 <> 0"), b.filter("ord % 4 = 0"), W, H - 60)


def _inter(a: str, b: str) -> str:
    w, h = f"(least({a}x2, {b}x2) - greatest({a}x1, {b}x1))", f"(least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    return f"(CASE WHEN {w} > 0 AND {h} > 0 THEN {w} * {h} ELSE 0 END)"


_AUDIT = f"""{pages.sql()}, img AS (SELECT doc_id, page, x1 AS ix1, y1 AS iy1, x2 AS ix2, y2 AS iy2 FROM b WHERE ord % 4 = 0),
m AS (SELECT doc_id, page, ord, x1, y1 + 25 AS y1, x2, y2 + 40 AS y2, x1 AS ox1, y1 AS oy1, x2 AS ox2, y2 AS oy2 FROM b WHERE ord % 4 <> 0),
o AS (SELECT p.doc_id, p.page, p.ord AS a, q.ord AS b, {_inter('p.', 'q.')} - {_inter('p.o', 'q.o')} AS area, (p.x2 - p.x1) * (p.y2 - p.y1) AS sa, (q.x2 - q.x1) * (q.y2 - q.y1) AS sb,
  (p.ox2 - p.ox1) * (p.oy2 - p.oy1) AS oa, (q.ox2 - q.ox1) * (q.oy2 - q.oy1) AS ob FROM m p JOIN m q ON p.doc_id = q.doc_id AND p.page = q.page AND p.ord < q.ord),
i AS (SELECT p.doc_id, p.page, p.ord, {_inter('p.', 'q.i')} - {_inter('p.o', 'q.i')} AS area, (p.x2 - p.x1) * (p.y2 - p.y1) AS sa, (ix2 - ix1) * (iy2 - iy1) AS sb FROM m p JOIN img q USING (doc_id, page)),
pg AS (SELECT doc_id, page, ord, greatest(0, (x2 - x1) * (y2 - y1) - greatest(least(x2, {W}) - greatest(x1, 0), 0) * greatest(least(y2, {H - 60}) - greatest(y1, 0), 0))
  - greatest(0, (ox2 - ox1) * (oy2 - oy1) - greatest(least(ox2, {W}) - greatest(ox1, 0), 0) * greatest(least(oy2, {H - 60}) - greatest(oy1, 0), 0)) AS area FROM m)
SELECT doc_id, page, 'overlap' AS kind, CASE WHEN sa - oa >= sb - ob THEN a ELSE b END AS id, CASE WHEN sa - oa >= sb - ob THEN b ELSE a END AS other, area::DOUBLE AS area FROM o WHERE area > greatest(12, 0.02 * least(sa, sb))
UNION ALL SELECT doc_id, page, 'occludes-image', ord, NULL, area::DOUBLE FROM i WHERE area > greatest(12, 0.02 * least(sa, sb))
UNION ALL SELECT doc_id, page, 'out-of-page', ord, NULL, area::DOUBLE FROM pg WHERE area > 12"""


def packed(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.pmod("doc_id", F.lit(40)).alias("batch"), "text")
    return chunks.greedy(docs, ["batch"], ["doc_id"], F.length("text"))


_PACKED = f"""WITH RECURSIVE d AS (SELECT doc_id, doc_id % 40 AS batch, length(text) AS n, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS r FROM documents),
f AS (SELECT batch, doc_id, r, 0 AS chunk, n AS s, 1 AS k FROM d WHERE r = 1
  UNION ALL SELECT d.batch, d.doc_id, d.r, f.chunk + (f.s + d.n > {X.CHUNK_CHARS} OR f.k >= {X.CHUNK_BLOCKS})::INT, CASE WHEN f.s + d.n > {X.CHUNK_CHARS} OR f.k >= {X.CHUNK_BLOCKS} THEN d.n ELSE f.s + d.n END,
  CASE WHEN f.s + d.n > {X.CHUNK_CHARS} OR f.k >= {X.CHUNK_BLOCKS} THEN 1 ELSE f.k + 1 END FROM f JOIN d ON d.batch = f.batch AND d.r = f.r + 1)
SELECT batch, doc_id, chunk FROM f"""


def planned(spark, d):
    b = _plan_blocks(spark, d)
    return chunks.plan(b, 3000, 6)


def _plan_blocks(spark, d):
    from pyspark.sql import Window

    b = pages.blocks(spark, d).select("doc_id", (F.col("page") * 12 + F.col("ord")).alias("ord"), "text", "k", (F.col("type") == "heading").alias("is_heading"))
    w = Window.partitionBy("doc_id").orderBy("ord")
    b = b.withColumn("module", F.sum(F.col("is_heading").cast("int")).over(w).cast("int"))
    b = b.withColumn("heading", F.when(F.col("module") > 0, F.first("text").over(Window.partitionBy("doc_id", "module").orderBy("ord"))))
    return b.withColumn("risky", F.pmod("k", F.lit(9)) == 0)


_PLAN = f"""{pages.sql().replace('WITH lines', 'WITH RECURSIVE lines', 1)},
u AS (SELECT doc_id, page * 12 + ord AS ord, text, type = 'heading' AS is_heading, k % 9 = 0 AS risky, sum((type = 'heading')::INT) OVER (PARTITION BY doc_id ORDER BY page, ord) AS module FROM b),
v AS (SELECT *, CASE WHEN module > 0 THEN first_value(text) OVER (PARTITION BY doc_id, module ORDER BY ord) END AS heading FROM u),
f AS (SELECT *, length(text) AS n, row_number() OVER w AS r, coalesce(lag(module) OVER w <> module, false) AS starts FROM v WHERE NOT risky WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
g AS (SELECT doc_id, ord, r, 0 AS chunk, n AS s, 1 AS c FROM f WHERE r = 1
  UNION ALL SELECT f.doc_id, f.ord, f.r, g.chunk + ((f.starts AND g.s >= 2550) OR g.s + f.n > 3000 OR g.c >= 6)::INT, CASE WHEN (f.starts AND g.s >= 2550) OR g.s + f.n > 3000 OR g.c >= 6 THEN f.n ELSE g.s + f.n END,
  CASE WHEN (f.starts AND g.s >= 2550) OR g.s + f.n > 3000 OR g.c >= 6 THEN 1 ELSE g.c + 1 END FROM g JOIN f ON f.doc_id = g.doc_id AND f.r = g.r + 1),
h AS (SELECT g.doc_id, g.ord, g.chunk, f.module, f.heading, f.is_heading, first_value(f.module) OVER w AS m0, first_value(f.heading) OVER w AS h0 FROM g JOIN f USING (doc_id, ord) WINDOW w AS (PARTITION BY g.doc_id, g.chunk ORDER BY g.ord)),
a AS (SELECT doc_id, ord, 'fast' AS lane, chunk, CASE WHEN max((is_heading AND module = m0)::INT) OVER (PARTITION BY doc_id, chunk) = 1 THEN '' ELSE coalesce(h0, '') END AS context FROM h)
SELECT * FROM a UNION ALL
SELECT v.doc_id, v.ord, 'slow', (coalesce((SELECT max(chunk) FROM a WHERE a.doc_id = v.doc_id), -1) + row_number() OVER (PARTITION BY v.doc_id ORDER BY v.ord))::INT, coalesce(v.heading, '') FROM v WHERE risky"""


def dice_of_neighbours(spark, d):
    """X17 / F32 between the whole surfaces of each document and the next."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.surface(F.col("text")).alias("s"))
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("n"))
    both = docs.join(nxt, "doc_id")
    return both.select("doc_id", similarity.dice(F.col("s"), F.col("n")).alias("dice"), similarity.copied_surface(F.col("s"), F.col("n")).alias("copied"))


_GRAMS = "(SELECT doc_id, substr(s, i, 2) AS g, count(*) AS n FROM (SELECT doc_id, {c} AS s, unnest(range(1, length({c}))) AS i FROM p) GROUP BY ALL)"
_DICE = f"""WITH s AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS s FROM documents),
p AS (SELECT a.doc_id, a.s, b.s AS n FROM s a JOIN s b ON b.doc_id = a.doc_id + 1),
q AS (SELECT x.doc_id, sum(least(x.n, y.n)) AS shared FROM {_GRAMS.format(c='s')} x JOIN {_GRAMS.format(c='n')} y USING (doc_id, g) GROUP BY ALL),
r AS (SELECT p.*, CASE WHEN s = n THEN 1.0::DOUBLE WHEN length(s) < 2 OR length(n) < 2 THEN 0.0 ELSE (2 * coalesce(shared, 0))::DOUBLE / (length(s) + length(n) - 2) END AS dice FROM p LEFT JOIN q USING (doc_id))
SELECT doc_id, dice, s <> '' AND n <> '' AND (s = n OR (least(length(s), length(n)) >= 32 AND
  (CASE WHEN trim(s) = trim(n) THEN 1 ELSE dice END) >= 0.82)) AS copied FROM r"""


def hashes(spark, d):
    """M01 over whole snippets."""
    return snippets.table(spark, d).select("doc_id", "pos", hashing.two_lane(F.col("text")).alias("value"))


def residue(spark, d):
    """F34 / F36 over snippets."""
    s = snippets.table(spark, d)
    return s.select("doc_id", "pos", similarity.english_residue(F.col("text")).alias("residue"), F.size(similarity.residue_spans(F.col("text"))).alias("spans"))


_SPANS = f"list_filter(list_transform(regexp_extract_all(@t, {re2(X.RESIDUE_SEGMENT)}), lambda x: regexp_replace(x, '[{SPACE}]+', ' ', 'g')), lambda x: NOT (len(regexp_extract_all(x, '[A-Za-z]')) = 0 OR len(regexp_extract_all(x, '[0-9]')) >= greatest(6, floor(len(regexp_extract_all(x, '[A-Za-z]')) * 0.35))) AND len(regexp_extract_all(x, {re2(X.ENGLISH_WORD)})) >= 10 AND x <> '' AND NOT regexp_matches(x, '@|https?://') AND len(regexp_extract_all(x, '[A-Za-z]')) >= 30)"
_RESIDUE = f"""{snippets.sql()},
c AS (SELECT *, regexp_replace(text, {re2(chr(104) + 'ttps?://' + chr(92) + 'S+|www' + chr(92) + '.' + chr(92) + 'S+|' + chr(92) + 'S+@' + chr(92) + 'S+', True)}, ' ', 'g') AS cleaned FROM s),
w AS (SELECT *, array_to_string(list_transform(regexp_split_to_array(cleaned, '[{SPACE}]+'), lambda x: CASE WHEN regexp_matches(regexp_replace(x, '^[^A-Za-z]+|[^A-Za-z]+$', '', 'g'), '^[a-z]{{2,}}$') THEN 'x' ELSE '-' END), '') AS runs FROM c)
SELECT doc_id, pos, contains(runs, 'xxxxxx') OR len({_SPANS.replace('@t', 'cleaned')}) > 0 AS residue, len({_SPANS.replace('@t', 'text')})::INT AS spans FROM w"""


def two_columns(spark, d):
    return layout.two_column_order(pages.blocks(spark, d)).select("doc_id", "page", "ord", "place")


_TWO = f"""{pages.sql()}, m AS (SELECT *, min(ord) FILTER ("column" = 1) OVER p AS r, max(ord) FILTER ("column" = 0) OVER p AS l, min(y1) FILTER ("column" >= 0) OVER p AS top FROM b WINDOW p AS (PARTITION BY doc_id, page)),
n AS (SELECT *, coalesce(l > r, false) AS mixed FROM m)
SELECT doc_id, page, ord, (row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN NOT mixed THEN 0 WHEN "column" >= 0 THEN "column" + 1 WHEN y1 < top THEN 0 ELSE 3 END, CASE WHEN mixed THEN y1 ELSE 0 END, ord) - 1)::INT AS place FROM n"""


def ended(spark, d):
    """A11 over pages of blocks."""
    return layout.list_ended(pages.blocks(spark, d))


_ENDED = f"{pages.sql()}, t AS (SELECT doc_id, page, {_TRIM} AS t FROM b)\nSELECT doc_id, page, count(*) >= 3 AND avg(regexp_matches(t, '[.。;；]$')::INT) >= 0.8 AS list FROM t WHERE t <> '' GROUP BY ALL"


def unions(spark, d):
    """The types of a page's blocks as runs, distinct in order."""
    return layout.ordered_union(pages.blocks(spark, d).select("doc_id", "page", "ord", F.array("type", "font_name").alias("runs")), ["doc_id", "page"]).select("doc_id", "page", F.array_join("runs", "|").alias("runs"))


_UNIONS = f"{pages.sql()}, u AS (SELECT doc_id, page, unnest([type, font_name]) AS r, unnest([ord * 2, ord * 2 + 1]) AS k FROM b), f AS (SELECT doc_id, page, r, min(k) AS k FROM u GROUP BY ALL)\nSELECT doc_id, page, string_agg(r, '|' ORDER BY k) AS runs FROM f GROUP BY ALL"


def line_texts(spark, d):
    """The whole texts of a page's blocks as items of a line."""
    item = F.struct(F.col("x1"), (F.col("x1") + F.pmod("k", F.lit(90))).alias("x2"), F.col("text"))
    rows = pages.blocks(spark, d).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("x1", "ord", item.alias("i")))).alias("r"))
    return rows.select("doc_id", "page", G.span_text(F.transform("r", lambda x: x["i"]), F.lit(10.0)).alias("value"))


_QUERIES = {
    "w06_two_column_order": (two_columns, _TWO),
    "a11_list_ended": (ended, _ENDED),
    "a14_ordered_union": (unions, _UNIONS),
    "x10_span_text": (line_texts, None),
    "w07_reading_order": (reading_order, _ORDER),
    "a01_page_sizes": (sizes, _SIZES),
    "a07_union_box": (union_boxes, f'{pages.sql()}\nSELECT doc_id, page, "column", min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM b GROUP BY ALL'),
    "j08_outside_figures": (figures, _FIGURES),
    "j10_inside_regions": (contained, _CONTAINED),
    "j11_overlapping_pairs": (pairs, _PAIRS),
    "w04_paragraphs": (paragraph_groups, _PARAGRAPHS),
    "w05_repair_merges": (repair, _REPAIR),
    "w08_order_reversed": (reversal, _REVERSAL),
    "f41_reference_cut": (cut_references, _CUT),
    "m09_layout_audit": (audited, _AUDIT),
    "w11_greedy_chunks": (packed, _PACKED),
    "w13_chunk_plan": (planned, _PLAN),
    "x17_dice": (dice_of_neighbours, _DICE),
    "f34_english_residue": (residue, _RESIDUE),
}


def queries() -> dict:
    return {n: _block_query(v) for n, (v, _) in BLOCKS.items()} | {n: q for n, (q, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: _block_sql(s) for n, (_, s) in BLOCKS.items()} | {n: s for n, (_, s) in _QUERIES.items() if s}

"""Queries for scans, joins, caches, configuration, hashes and page geometry, one an operator, each with a SQL twin that says the same on its own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import geometry as G
from ..functions import hashing, similarity
from ..functions import regex as R
from ..functions import text as T
from ..functions.regex import SPACE, re2
from ..operators import exchange, layout, pagewise, policies
from ..sources import readers
from . import layout_queries, pages, snippets, state_queries, text_queries


def _read(spark, d, table):
    return spark.read.parquet(f"{d}/{table}.parquet")


def _pick(values, k) -> F.Column:
    """The k-th of some constants, counted around."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))


def _pick_sql(values, k: str) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"([{', '.join(map(quote, values))}])[{k} % {len(values)} + 1]"


# --- glyphs, spans, whole texts ------------------------------------------------------------------------------------------


def _glyphs(spark, d):
    """Every character of the parts' types and names as a glyph, spaces partly as flags of the glyph before, partly ignorable."""
    p = _read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.pmod("p_partkey", F.lit(3)).cast("int").alias("page"), F.concat_ws(" ", "p_name", "p_type").alias("t"))
    g = p.select("doc_id", "page", F.posexplode(F.filter(F.split("t", ""), lambda c: c != "")).alias("pos", "c"), "t")
    x = F.col("pos") * 5.0
    rect = G.box(x, F.lit(700.0), x + 5, F.lit(710.0)).alias("rect")
    after = F.substring("t", F.col("pos") + 2, F.lit(1)) == " "
    return g.select(
        "doc_id", "page", "pos", "c", rect, F.lit("Body").alias("font_name"), F.when(F.pmod("pos", F.lit(4)) > 0, 10.0).alias("font_size"), F.when(F.col("c") == " ", True).when(F.pmod("pos", F.lit(2)) == 0, False).alias("ignorable"),
        (after & (F.pmod("pos", F.lit(5)) > 0)).alias("space_after"), (after & (F.pmod("pos", F.lit(5)) == 0)).alias("line_break_after"), F.lit(False).alias("paragraph_break_after"),
    )


def glyph_scan(spark, d):
    """S01."""
    return readers.glyphs(_glyphs(spark, d)).select("doc_id", "page", "pos", "c", F.col("rect.x1").alias("x1"), F.col("rect.x2").alias("x2"), "font_size")


_GLYPHS = "t AS (SELECT p_partkey::VARCHAR AS doc_id, (p_partkey % 3)::INT AS page, p_name || ' ' || p_type AS t FROM part), g AS (SELECT *, unnest(range(length(t)))::INT AS pos FROM t)"
_GLYPH_SCAN = f"WITH {_GLYPHS} SELECT doc_id, page, pos, t[pos + 1] AS c, (pos * 5)::DOUBLE AS x1, (pos * 5 + 5)::DOUBLE AS x2, CASE WHEN pos % 4 > 0 THEN 10.0::DOUBLE END AS font_size FROM g WHERE t[pos + 1] <> ' '"


def glyph_text(spark, d):
    """The text of each page of glyphs."""
    return readers.page_text(readers.glyphs(_glyphs(spark, d)))


def whole_text(spark, d):
    """Turns as pages: one text a conversation, no mark between pages."""
    return readers.whole_text(_read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"))


def span_scan(spark, d):
    """Span files written as JSON and parsed again; every third span has no size of its own."""
    b = pages.blocks(spark, d)
    item = F.struct("ord", "text", F.array("x1", "y1", "x2", "y2").alias("rect"), F.when(F.pmod("k", F.lit(3)) > 0, F.col("font")).alias("fontSize"))
    files = b.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(item)).alias("i"))
    items = F.transform("i", lambda x: F.struct(x["text"].alias("text"), x["rect"].alias("rect"), x["fontSize"].alias("fontSize")))
    json = F.to_json(F.struct(F.col("doc_id").cast("string").alias("source"), "page", F.lit(612.0).alias("pageWidth"), F.lit(792.0).alias("pageHeight"), items.alias("items")))
    parsed = files.select(F.from_json(json, readers.SPAN_FILE).alias("f")).select("f.*")
    return readers.span_rows(parsed).select("doc_id", "page", "pos", "text", F.col("rect.x1").alias("x1"), F.col("rect.y2").alias("y2"), "font_size", "page_height")


_SPAN_SCAN = f"""{pages.sql()} SELECT doc_id::VARCHAR AS doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) - 1)::INT AS pos, text, x1, y2::DOUBLE AS y2,
  CASE WHEN k % 3 > 0 THEN font ELSE y2 - y1 END::DOUBLE AS font_size, 792.0::DOUBLE AS page_height FROM b"""


def image_rects(spark, d):
    """Images painted under nested matrices, one page an order."""
    o = _read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.pmod("o_custkey", F.lit(40)).cast("double").alias("w"), F.pmod("o_orderkey", F.lit(30)).cast("double").alias("h"))

    def run(rows):
        for r in rows:
            scale = {"op": "transform", "m": (r["w"], 0.0, 0.0, -r["h"], 100.0, 200.0)}  # upside down
            ops = [{"op": "save"}, {"op": "transform", "m": (2.0, 0.0, 0.0, 1.0, 10.0, 20.0)}, {"op": "save"}, scale, {"op": "paint"}, {"op": "restore"}, {"op": "restore"}, {"op": "restore"}, {"op": "transform", "m": (0.0, r["w"], r["h"], 0.0, 5.0, 6.0)}, {"op": "paint"}]
            for n, b in enumerate(pagewise.image_boxes(ops)):
                yield {"n": n, "x1": b.x1, "y1": b.y1, "x2": b.x2, "y2": b.y2}

    return pagewise.run(o.withColumn("page", F.lit(0)), run, "doc_id long, page int, n int, x1 double, y1 double, x2 double, y2 double", ("doc_id",))


_IMAGES = """WITH o AS (SELECT o_orderkey AS doc_id, (o_custkey % 40)::DOUBLE AS w, (o_orderkey % 30)::DOUBLE AS h FROM orders),
i AS (SELECT doc_id, 0 AS k, 210.0::DOUBLE AS x1, 220.0::DOUBLE - h AS y1, 210.0::DOUBLE + 2 * w AS x2, 220.0::DOUBLE AS y2 FROM o UNION ALL SELECT doc_id, 1, 5.0::DOUBLE, 6.0::DOUBLE, 5.0::DOUBLE + h, 6.0::DOUBLE + w FROM o)
SELECT doc_id, 0 AS page, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS n, x1, y1, x2, y2 FROM i WHERE x2 - x1 >= 12 AND y2 - y1 >= 12"""


# --- predicates of blocks ---------------------------------------------------------------------------------------------------


def _pairs(spark, d):
    """Each block with the next of its page as boxes, and the page's headings as figures."""
    b = pages.blocks(spark, d)
    w = Window.partitionBy("doc_id", "page").orderBy("ord")
    box = F.struct("x1", "y1", "x2", "y2")
    every = F.collect_list(F.when(F.col("type") == "heading", box)).over(Window.partitionBy("doc_id", "page"))
    return b.select("doc_id", "page", "ord", "font", "k", box.alias("a"), F.lead(box).over(w).alias("b"), every.alias("figures")).filter("b is not null")


_PAIRS = f"""{pages.sql()}, n AS (SELECT *, lead(x1) OVER w AS u1, lead(y1) OVER w AS v1, lead(x2) OVER w AS u2, lead(y2) OVER w AS v2 FROM b WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord)),
p AS (SELECT *, least(x2, u2) - greatest(x1, u1) AS wide, least(x2 - x1, u2 - u1) AS narrow FROM n WHERE u1 IS NOT NULL)"""


def shared_column(spark, d):
    """F18."""
    return _pairs(spark, d).select("doc_id", "page", "ord", G.share_column(F.col("a"), F.col("b")).alias("value"))


def paragraph_breaks(spark, d):
    """every combination of the eight facts, by event number."""
    e, n = _read(spark, d, "events"), F.col("event_id")
    bit = lambda i: F.shiftright(n, i).bitwiseAND(1) == 1
    return e.select("event_id", G.paragraph_break(F.pmod(n, F.lit(13)) - 1, F.pmod(n, F.lit(31)).cast("double"), bit(0), bit(1) & bit(7), bit(2) & bit(8), bit(3) & bit(9), bit(4) & bit(10), bit(5), bit(6) & bit(11)).alias("value"))


_BREAKS = """WITH e AS (SELECT event_id, event_id AS n, CASE WHEN event_id % 13 - 1 > 0 THEN event_id % 13 - 1 ELSE 10 END AS em, event_id % 31 AS gap FROM events),
f AS (SELECT *, n & 1 > 0 AS wrapped, n & 2 > 0 AND n & 128 > 0 AS fresh, n & 4 > 0 AND n & 256 > 0 AS indented, n & 8 > 0 AND n & 512 > 0 AS jump, n & 16 > 0 AND n & 1024 > 0 AS item, n & 32 > 0 AS short, n & 64 > 0 AND n & 2048 > 0 AS dots FROM e)
SELECT event_id, fresh OR item OR dots OR (short AND NOT wrapped) OR gap > em * 1.7 OR indented OR jump OR (NOT wrapped AND gap > em * 0.75) AS value FROM f"""


def shards(spark, d):
    """F23."""
    return pages.blocks(spark, d).select("doc_id", "page", "ord", T.shard(F.col("text"), F.col("type")).alias("value"))


_TRIM = rf"regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
_SHARDS = f"""{pages.sql()}, t AS (SELECT *, {_TRIM} AS t FROM b)
SELECT doc_id, page, ord, type = 'paragraph' AND t <> '' AND (length(t) <= 12 OR regexp_matches(t, '^[a-z]') OR regexp_matches(t, {re2('^' + X.BARE_CITATION + '$')})) AS value FROM t"""


def replaceable(spark, d):
    """What an overlay covers, and what a typeset copy replaces."""
    b = pages.blocks(spark, d).withColumn("is_reference", F.pmod("k", F.lit(6)) == 0).withColumn("type", F.when(F.pmod("k", F.lit(7)) == 0, "caption").otherwise(F.col("type")))
    return readers.exportable(b).select("doc_id", "page", "ord", T.overlayable(F.col("type")).alias("overlay"))


_REPLACEABLE = f"""{pages.sql()}, q AS (SELECT doc_id, page, ord, CASE WHEN k % 7 = 0 THEN 'caption' ELSE type END AS type, k % 6 = 0 AS is_reference, x2 - x1 AS w, y2 - y1 AS h, text, {_TRIM} AS t FROM b),
v AS (SELECT *, length(t) AS n, {text_queries._authors('t')} AS authors, {text_queries._affiliation('t')} AS affiliation FROM q)
SELECT doc_id, page, ord, type = 'paragraph' OR type = 'heading' AS overlay FROM v WHERE type IN ('paragraph', 'caption', 'list') AND NOT is_reference AND (CASE {text_queries._CASES} END) IS NULL AND w >= 36 AND h >= 7 AND n >= 6"""


def context_bleeds(spark, d):
    """texts of Han characters against the words of their source."""
    e = _read(spark, d, "events")
    return e.select("event_id", T.context_bleed((F.pmod("event_id", F.lit(60))).cast("int"), F.concat(F.repeat(F.lit("译"), F.pmod("event_id", F.lit(170)).cast("int")), F.lit("ab c")), F.pmod("event_id", F.lit(7)) > 0).alias("value"))


_BLEEDS = "SELECT event_id, event_id % 7 > 0 AND event_id % 60 >= 8 AND event_id % 170 > greatest(80.0, 2.4 * (event_id % 60)) AS value FROM events"


_HAN = "译文说明该方法在对照组中明显有效"


def translations(spark, d):
    """F33 / F35 / F36 / F37's counts for zh targets: lines against copies, stubs, Han texts, and Han texts with a copied or a short Latin tail."""
    s = snippets.table(spark, d).withColumn("k", F.pmod(F.col("doc_id") + F.col("pos"), F.lit(8)))
    han = lambda n: F.repeat(F.lit(_HAN), n)
    made = F.when(F.col("k") == 0, F.col("text")).when(F.col("k") == 1, " ").when(F.col("k") == 2, han(4)).when(F.col("k") == 3, F.concat(han(60), F.lit(" "), "text")).when(F.col("k") == 4, "患").when(F.col("k") == 5, F.concat(han(3), F.lit(" left as it was before"))).when(F.col("k") == 6, F.lower("text")).otherwise(han(1))
    s = s.withColumn("t", made)
    return s.select("doc_id", "pos", similarity.looks_translated(F.col("text"), F.col("t"), F.lit("zh-CN")).alias("translated"), similarity.copied_residue(F.col("text"), F.col("t")).alias("mixed"), F.size(similarity.residue_spans(F.col("t"), 12)).alias("spans"))


def _spans_sql(text: str) -> str:
    n = lambda p: f"len(regexp_extract_all(x, {p}))"
    letters, words = n("'[A-Za-z]'"), n(re2(X.ENGLISH_WORD))
    dense = f"({letters} = 0 OR {n(chr(39) + '[0-9]' + chr(39))} >= greatest(6, floor({letters} * 0.35)))"
    return f"list_filter(list_transform(regexp_extract_all({text}, {re2(X.RESIDUE_SEGMENT)}), lambda x: regexp_replace(x, '[{SPACE}]+', ' ', 'g')), lambda x: NOT {dense} AND {words} >= 12 AND NOT regexp_matches(x, '@|https?://') AND {letters} >= 30)"


# Copied tails are copied exactly here, so that a stretch is either in the source or far from it.
_TRANSLATIONS = f"""{snippets.sql()}, a AS (SELECT doc_id, pos, text AS s, CASE (doc_id + pos) % 8 WHEN 0 THEN text WHEN 1 THEN ' ' WHEN 2 THEN repeat('{_HAN}', 4) WHEN 3 THEN repeat('{_HAN}', 60) || ' ' || text WHEN 4 THEN '患' WHEN 5 THEN repeat('{_HAN}', 3) || ' left as it was before' WHEN 6 THEN lower(text) ELSE '{_HAN}' END AS raw FROM s),
b AS (SELECT *, regexp_replace(raw, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS t, regexp_replace(s, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS st, {_spans_sql('raw')} AS spans, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS surface FROM a),
c AS (SELECT *, len(regexp_extract_all(raw, {re2(X.HAN)})) > 0 AND surface <> '' AND len(list_filter(list_transform(spans, lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: length(x) >= 32 AND contains(surface, x))) > 0 AS mixed,
  len(regexp_extract_all(t, {re2(X.HAN_WIDE)})) AS han, len(regexp_extract_all(t, '[A-Za-z]{{2,}}')) AS latin, len(list_filter(regexp_extract_all(t, '[A-Za-z][A-Za-z''-]+'), lambda w: regexp_matches(w, '^[a-z]'))) AS plain,
  len(list_filter(regexp_extract_all(s, '[A-Za-z][A-Za-z''-]+'), lambda w: regexp_matches(w, '^[a-z]'))) AS plain_s FROM b),
v AS (SELECT * RENAME (t AS answer, st AS t), length(st) AS n FROM c)
SELECT doc_id, pos, CASE WHEN answer = '' THEN false WHEN len(regexp_extract_all(s, '[A-Za-z]{{2,}}')) < 6 THEN true WHEN {text_queries.PREDICATES['f30_name_list'][1]} THEN true
  WHEN length(t) >= 200 AND length(answer) / length(t) < 0.15 THEN false
  WHEN length(s) <= 80 THEN (plain_s = 0 OR (han + plain > 0 AND han / greatest(han + plain, 1) >= 0.45)) AND NOT mixed
  WHEN han + latin = 0 OR han / (han + latin) < 0.45 THEN false ELSE NOT mixed END AS translated, mixed, len(spans)::INT AS spans FROM v"""


def formula_risk(spark, d):
    """texts with up to eleven tokens among their words."""
    s = snippets.table(spark, d)
    n = F.pmod(F.col("doc_id") + F.col("pos"), F.lit(12)).cast("int")
    tokens = F.array_join(F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.when(i <= n, F.concat(F.lit("⟦PM"), i - 1, F.lit("⟧"))).otherwise("")), " x ")
    early = F.pmod("pos", F.lit(2)) == 0
    masked = F.when(early, F.concat(tokens, "text")).otherwise(F.concat("text", tokens))
    prose = F.concat(F.when(F.pmod("doc_id", F.lit(3)) == 0, "It is Defined  as ").otherwise(""), F.col("text"))
    s = s.select("doc_id", "pos", masked.alias("m"), prose.alias("p"), n.alias("n"))
    score = T.risk_score(F.col("m"), F.col("p"), F.col("n"))
    return s.select("doc_id", "pos", score.alias("score"), T.formula_dense(score, F.col("n")).alias("dense"))


_PHRASES = " OR ".join(f"contains(low, '{p}')" for p in X.RISK_PHRASES)
_RISK = f"""{snippets.sql()}, a AS (SELECT doc_id, pos, text, ((doc_id + pos) % 12)::INT AS n FROM s),
b AS (SELECT *, array_to_string(list_transform(range(1, n + 2), lambda i: CASE WHEN i <= n THEN '⟦PM' || (i - 1) || '⟧' ELSE '' END), ' x ') AS tokens FROM a),
c AS (SELECT doc_id, pos, n, CASE WHEN pos % 2 = 0 THEN tokens || text ELSE text || tokens END AS m,
  regexp_replace(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN 'It is Defined  as ' ELSE '' END || text, '[{SPACE}]+', ' ', 'g'), '^ | $', '', 'g') AS p FROM b),
e AS (SELECT *, lower(p) AS low, length(m) AS len, instr(m, '⟦PM') - 1 AS a, length(m) - instr(reverse(m), 'MP⟦') - 2 AS z, n::DOUBLE / greatest(length(m), 1) AS share FROM c),
f AS (SELECT *, (CASE WHEN {_PHRASES} THEN 3 ELSE 0 END + CASE WHEN n >= 4 THEN 2 ELSE 0 END + CASE WHEN n >= 8 THEN 2 ELSE 0 END + CASE WHEN length(p) >= 180 THEN 1 ELSE 0 END
  + CASE WHEN share >= 0.015 THEN 1 ELSE 0 END + CASE WHEN share >= 0.03 THEN 1 ELSE 0 END + CASE WHEN a >= 0 AND a <= len * 0.15 THEN 1 ELSE 0 END + CASE WHEN a >= 0 AND z < len - 24 THEN 1 ELSE 0 END)::INT AS score FROM e)
SELECT doc_id, pos, score, n >= 4 AND score >= 6 AS dense FROM f"""


# --- joins -------------------------------------------------------------------------------------------------------------------


def cached_blocks(spark, d):
    """Cached texts by block id, valid where longer than ten characters; one id in five isn't cached, one in seven twice."""
    b = pages.blocks(spark, d).select("doc_id", F.concat_ws("-", "doc_id", "page", "ord").alias("id"), "text", "k")
    entry = F.struct("id", F.substring("text", 1, 40).alias("text"))
    hits = b.filter("k % 5 <> 0").groupBy("doc_id").agg(F.concat(F.collect_list(entry), F.collect_list(F.when(F.pmod("k", F.lit(7)) == 0, entry))).alias("translations"))
    return exchange.cached_by_id(b.select("id", "text"), hits, F.length("cached") > 10).select("id", "cached")


_CACHED = f"{pages.sql()} SELECT doc_id || '-' || page || '-' || ord AS id, CASE WHEN k % 5 <> 0 AND length(left(text, 40)) > 10 THEN left(text, 40) END AS cached FROM b"


def figures_between(spark, d):
    """A heading stands in the gap between a block and the next."""
    return _pairs(spark, d).select("doc_id", "page", "ord", G.obstacle_between(F.col("a"), F.col("b"), F.col("figures")).alias("value"))


_BETWEEN = f"""{_PAIRS}, q AS (SELECT *, CASE WHEN y1 >= v1 THEN y1 ELSE v1 END AS top, CASE WHEN y1 >= v1 THEN v2 ELSE y2 END AS low FROM p)
SELECT doc_id, page, ord, top - low >= 2 AND EXISTS (SELECT 1 FROM b AS o WHERE o.doc_id = q.doc_id AND o.page = q.page AND o.type = 'heading' AND least(o.x2, q.x2) - greatest(o.x1, q.x1) >= 6 AND least(o.x2, q.u2) - greatest(o.x1, q.u1) >= 6
  AND least(q.top, o.y2) - greatest(q.low, o.y1) >= least(4.0, (q.top - q.low) * 0.5)) AS value FROM q"""


def shared_rows(spark, d):
    """Columns of a page as clusters of cells in eight rows, moved by more or less than the tolerance."""
    return policies.shared_rows(_cells(spark, d), 10.0)


def _cells(spark, d):
    b = pages.blocks(spark, d).select("doc_id", "page", F.col("column").alias("cluster"), "k", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    y = (F.pmod(F.col("k") + F.col("j"), F.lit(8)) * 40 + F.pmod(F.col("k") * (F.col("j") + 1), F.lit(23))).cast("double")
    return b.select("doc_id", "page", "cluster", y.alias("y1"), (y + 8).alias("y2"))


_CELLS = f"""{pages.sql().replace('WITH lines', 'WITH RECURSIVE lines')}, c AS (SELECT DISTINCT doc_id, page, "column" AS cluster, (k + j) % 8 * 40 + k * (j + 1) % 23 + 4 AS y FROM b, range(4) r(j))"""
_BANDS = """n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, cluster ORDER BY y) AS r FROM c),
f AS (SELECT doc_id, page, cluster, r, y, y AS first FROM n WHERE r = 1 UNION ALL SELECT n.doc_id, n.page, n.cluster, n.r, n.y, CASE WHEN n.y > f.first + 10 THEN n.y ELSE f.first END FROM f JOIN n ON n.doc_id = f.doc_id AND n.page = f.page AND n.cluster = f.cluster AND n.r = f.r + 1),
g AS (SELECT DISTINCT doc_id, page, cluster, first AS y FROM f)"""
_SHARED = f"""{_CELLS}, {_BANDS}, h AS (SELECT DISTINCT a.doc_id, a.page, a.cluster AS a, b.cluster AS b, a.y FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.page = b.page AND a.cluster < b.cluster AND abs(a.y - b.y) <= 10)
SELECT doc_id, page, a, b, count(*)::INT AS rows FROM h GROUP BY doc_id, page, a, b HAVING count(*) >= 3"""


def row_bands(spark, d):
    """First members of the row bands of each column."""
    c = _cells(spark, d).groupBy("doc_id", "page", "cluster").agg(F.collect_list((F.col("y1") + F.col("y2")) / 2).alias("y"))
    return c.select("doc_id", "page", "cluster", F.explode(policies.bands(F.col("y"), 10.0)).alias("band"))


# --- sizes, hashes, matrices ------------------------------------------------------------------------------------------------------


def weighted_size(spark, d):
    """The page's size by characters, the box's height where there is none."""
    b = pages.blocks(spark, d)
    size = F.coalesce(F.when(F.pmod("k", F.lit(4)) > 0, F.col("font")), F.col("y2") - F.col("y1"))
    return layout.dominant_size(b, size, F.greatest(F.lit(1), F.length(R.trim(F.col("text")))))


_WEIGHTED = f"""{pages.sql()}, z AS (SELECT doc_id, page, CASE WHEN k % 4 > 0 THEN font ELSE y2 - y1 END::DOUBLE AS size, greatest(1, length({_TRIM})) AS n FROM b),
g AS (SELECT doc_id, page, round(size * 2) / 2 AS bucket, sum(n) AS n FROM z WHERE size > 0 GROUP BY ALL)
SELECT doc_id, page, bucket AS dominant FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, bucket DESC) = 1"""


def _hash_sql(text: str) -> str:
    """Two lanes as a fold over UTF-16 units; the state comes first in the list."""
    units = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN c = '' THEN []::BIGINT[] WHEN unicode(c) < 65536 THEN [unicode(c)::BIGINT] ELSE [55296::BIGINT + ((unicode(c) - 65536) >> 10), 56320::BIGINT + ((unicode(c) - 65536) & 1023)] END))"
    a = f"list_reduce(list_concat([{X.HASH_SEEDS[0]}::BIGINT], u), lambda s, c: (xor(s, c) * {X.HASH_PRIMES[0]}) & 4294967295)"
    b = f"list_reduce(list_concat([{X.HASH_SEEDS[1]}::BIGINT], list_transform(u, lambda c, i: xor((c * 31 + i - 1) & 65535, c >> 8))), lambda s, c: (xor(s, c) * {X.HASH_PRIMES[1]}) & 4294967295)"
    return units, f"lower(lpad(to_hex({a}), 8, '0')) || lower(lpad(to_hex({b}), 8, '0'))"


_U, _H = _hash_sql("text")
_CONTENT_HASH = f"{snippets.sql()}, u AS (SELECT doc_id, pos, {_U} AS u FROM s) SELECT doc_id, pos, {_H} AS value FROM u"


def list_hash(spark, d):
    """Hash of a part's names as an ordered list."""
    return _read(spark, d, "part").select("p_partkey", hashing.of_list(F.array("p_name", "p_brand", F.lit(""), "p_type")).alias("hash"))


_LU, _LH = _hash_sql("p_name || chr(0) || p_brand || chr(0) || chr(0) || p_type")
_LIST_HASH = f"WITH u AS (SELECT p_partkey, {_LU} AS u FROM part) SELECT p_partkey, {_LH} AS hash FROM u"


def affine(spark, d):
    """A point under the product of two matrices."""
    e = _read(spark, d, "events")
    n = lambda k: F.pmod("event_id", F.lit(k)).cast("double")
    m = G.affine(F.array(n(3), n(5), n(7), F.lit(2.0), F.lit(1.0), n(11)), F.array(F.lit(1.5), n(2), F.lit(0.0), n(13), n(4), F.lit(-3.0)))
    p = G.apply_affine(m, n(17), n(19))
    return e.select("event_id", p["x"].alias("x"), p["y"].alias("y"))


_AFFINE = """WITH e AS (SELECT event_id, event_id % 17 AS x, event_id % 19 AS y FROM events),
n AS (SELECT event_id, 1.5 * x + event_id % 4 AS x, (event_id % 2) * x + (event_id % 13) * y - 3.0 AS y FROM e)
SELECT event_id, ((event_id % 3) * x + (event_id % 7) * y + 1)::DOUBLE AS x, ((event_id % 5) * x + 2 * y + event_id % 11)::DOUBLE AS y FROM n"""


def flipped(spark, d):
    """Boxes of the page turned up, and back."""
    b = pages.blocks(spark, d).withColumn("f", G.flip(F.struct("x1", "y1", "x2", "y2"), F.lit(792.0)))
    return b.select("doc_id", "page", "ord", "f.*", (G.flip(F.col("f"), F.lit(792.0))["y1"] == F.col("y1")).alias("back"))


_FLIPPED = f"{pages.sql()} SELECT doc_id, page, ord, x1, (792 - y2)::DOUBLE AS y1, x2, (792 - y1)::DOUBLE AS y2, true AS back FROM b"


def ink(spark, d):
    """Rows of ink of a page, one grid row a block: ink in columns that depend on the block."""

    def run(rows):
        grid = [[(r["k"] + c) % 5 < 2 and r["k"] % 3 > 0 for c in range(12)] for r in rows]
        for n, (top, bottom, left, right) in enumerate(pagewise.ink_spans(grid, 4.0, 2, 6)):
            yield {"n": n, "top": top, "bottom": bottom, "left": left, "right": right}

    return pagewise.run(pages.blocks(spark, d).select("doc_id", "page", "ord", "k"), run, "doc_id long, page int, n int, top double, bottom double, left double, right double")


_INK = f"""{pages.sql()}, g AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) - 1 AS r, CASE WHEN k % 3 > 0 THEN list_filter([2, 3, 4, 5, 6], lambda c: (k + c) % 5 < 2) ELSE []::INT[] END AS hit FROM b),
h AS (SELECT *, r - row_number() OVER (PARTITION BY doc_id, page ORDER BY r) AS island FROM g WHERE len(hit) > 0),
i AS (SELECT doc_id, page, min(r) AS lo, max(r) AS hi, min(list_min(hit)) AS l, max(list_max(hit)) AS z, count(*) AS n FROM h GROUP BY doc_id, page, island HAVING count(*) >= 2)
SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY lo) - 1)::INT AS n, (lo * 4)::DOUBLE AS top, ((hi + 1) * 4)::DOUBLE AS bottom, (l * 4)::DOUBLE AS "left", ((z + 1) * 4)::DOUBLE AS "right" FROM i"""


def pushed_down(spark, d):
    """A page's blocks from the top, each below the one before."""

    def run(rows):
        for p in pagewise.push_down([{"id": r["ord"], "top": r["y1"], "height": r["y2"] - r["y1"]} for r in rows], 4):
            yield {"ord": p["id"], "top": float(p["top"])}

    return pagewise.run(pages.blocks(spark, d).select("doc_id", "page", "ord", "y1", "y2"), run, "doc_id long, page int, ord int, top double")


# A block's top is the largest of: an earlier block's own top, and all heights and gaps from there on.
_PUSHED = f"""{pages.sql()}, n AS (SELECT doc_id, page, ord, y1, sum(y2 - y1 + 4) OVER w - (y2 - y1 + 4) AS above FROM b WINDOW w AS (PARTITION BY doc_id, page ORDER BY y1, ord))
SELECT doc_id, page, ord, (above + max(y1 - above) OVER (PARTITION BY doc_id, page ORDER BY y1, ord))::DOUBLE AS top FROM n"""


# --- tables' helpers, obstacles ---------------------------------------------------------------------------------------------------


def region_gaps(spark, d):
    """P04."""
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, d).select("doc_id", "page", "ord", G.gap_x(a, b).alias("across"), G.gap_y(a, b).alias("down"), G.share_x(a, b).alias("share"))


_GAPS = f"""{_PAIRS} SELECT doc_id, page, ord, greatest(x1 - u2, u1 - x2)::DOUBLE AS across, CASE WHEN v1 >= y2 THEN v1 - y2 WHEN y1 >= v2 THEN y1 - v2 ELSE 0 END::DOUBLE AS down, CASE WHEN narrow > 0 THEN wide / narrow ELSE 0 END::DOUBLE AS share FROM p"""


def gutters_taken(spark, d):
    """A heading stands in the gutter of two neighbours."""
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, d).select("doc_id", "page", "ord", G.in_gutter(a, b, F.col("figures")).alias("value"), G.in_gutter(a, b, F.col("figures"), 10.0).alias("wider"))


def _taken(slack: int) -> str:
    return f"-p.wide > 0 AND least(p.y2, p.v2) + {slack} > greatest(p.y1, p.v1) - {slack} AND EXISTS (SELECT 1 FROM b o WHERE o.doc_id = p.doc_id AND o.page = p.page AND o.type = 'heading' AND o.x1 < greatest(p.x1, p.u1) AND o.x2 > least(p.x2, p.u2) AND o.y1 < least(p.y2, p.v2) + {slack} AND o.y2 > greatest(p.y1, p.v1) - {slack})"


_TAKEN = f"{_PAIRS} SELECT doc_id, page, ord, {_taken(0)} AS value, {_taken(10)} AS wider FROM p"


def obstacle_boxes(spark, d):
    """References and tables with ink, by their own extent or their column's band."""
    b = pages.blocks(spark, d)
    own = F.pmod("k", F.lit(3)) == 0
    rects = F.when(F.pmod("k", F.lit(4)) > 0, F.array(F.col("x1"))).otherwise(F.array().cast("array<double>"))
    chosen = policies.ink_obstacles(b.withColumn("is_reference", F.when(F.pmod("k", F.lit(5)) < 2, F.lit(True))).withColumn("type", F.when(F.pmod("k", F.lit(8)) == 0, "table").otherwise(F.col("type"))).withColumn("line_rects", rects))
    bands = b.filter("column >= 0").groupBy("doc_id", "page", "column").agg(F.min("x1").alias("left"), F.max("x2").alias("right"))
    rows = chosen.select("doc_id", "page", "column", "ord", F.when(own, F.col("x1")).alias("left"), F.when(own, F.col("x2")).alias("right"))
    return policies.obstacle_boxes(rows, bands).select("doc_id", "page", "ord", "left", "right")


_OBSTACLES = f"""{pages.sql()}, d AS (SELECT doc_id, page, "column" AS c, min(x1) AS l, max(x2) AS r FROM b WHERE "column" >= 0 GROUP BY ALL),
e AS (SELECT b.doc_id, b.page, ord, CASE WHEN k % 3 = 0 THEN x1 ELSE l END AS "left", CASE WHEN k % 3 = 0 THEN x2 ELSE r END AS "right" FROM b LEFT JOIN d ON b.doc_id = d.doc_id AND b.page = d.page AND b."column" = d.c WHERE (k % 5 < 2 OR k % 8 = 0) AND k % 4 > 0)
SELECT * FROM e WHERE "left" IS NOT NULL AND "right" IS NOT NULL"""


def ranked_problems(spark, d):
    """A page's overlaps, largest first."""
    found = layout.overlapping_pairs(pages.blocks(spark, d))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("area"), "a", "b")))


_RANKED = f"""{pages.sql()}, p AS (SELECT a.doc_id, a.page, a.ord AS a, c.ord AS b, greatest(least(a.x2, c.x2) - greatest(a.x1, c.x1), 0) * greatest(least(a.y2, c.y2) - greatest(a.y1, c.y1), 0) AS area FROM b a JOIN b c ON a.doc_id = c.doc_id AND a.page = c.page AND a.ord < c.ord)
SELECT doc_id, page, a, b, area::DOUBLE AS area, row_number() OVER (PARTITION BY doc_id, page ORDER BY area DESC, a, b)::INT AS place FROM p WHERE area > 12"""


# --- configuration and services ----------------------------------------------------------------------------------------------------

_PROVIDERS = ("alpha", "beta", "gamma", "delta")


def stored_profiles(spark, d):
    """Profile lists, the old single form, broken JSON, and neither."""
    c = _read(spark, d, "customer")
    k = F.col("c_custkey").cast("string")
    raw = _pick(['{"profiles":[{"provider":"alpha","model":"m#"},{"provider":"beta","baseUrl":"u#"}]}', '{"provider":"gamma","model":"m#","other":1}', '{"provider":', '{"model":"x"}', '{"profiles":[{"model":"none"}]}'], F.col("c_custkey"))
    return policies.profiles(c.select("c_custkey", F.replace(raw, F.lit("#"), k).alias("json"))).select("c_custkey", "provider", "model", "baseUrl")


_STORED = """SELECT c_custkey, 'alpha' AS provider, 'm' || c_custkey AS model, NULL::VARCHAR AS "baseUrl" FROM customer WHERE c_custkey % 5 = 0 UNION ALL
SELECT c_custkey, 'beta', NULL, 'u' || c_custkey FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'gamma', 'm' || c_custkey, NULL FROM customer WHERE c_custkey % 5 = 1"""


def effective_config(spark, d):
    """Settings of each request: its provider's own where not blank, else the defaults."""
    own = spark.createDataFrame([("alpha", "a-1", None), ("beta", " ", "http://b"), ("gamma", None, "")], "provider string, model string, base string")
    r = _read(spark, d, "customer").select("c_custkey", _pick(_PROVIDERS, F.col("c_custkey")).alias("provider"))
    return policies.effective_config(r, own, {"model": "m-0", "base": "http://0"}).select("c_custkey", "provider", "model", "base")


_CONFIG = f"""WITH r AS (SELECT c_custkey, {_pick_sql(_PROVIDERS, 'c_custkey')} AS provider FROM customer)
SELECT c_custkey, provider, CASE provider WHEN 'alpha' THEN 'a-1' ELSE 'm-0' END AS model, CASE provider WHEN 'beta' THEN 'http://b' ELSE 'http://0' END AS base FROM r"""


def catalogue(spark, d):
    """A known model stays, an unknown one becomes its provider's recommended, if it has any."""
    models = spark.createDataFrame([("alpha", "a-1", True), ("alpha", "a-2", False), ("beta", "b-9", True), ("beta", "b-1", True), ("gamma", "c-1", False)], "provider string, model string, recommended boolean")
    r = _read(spark, d, "customer").select("c_custkey", _pick(_PROVIDERS, F.col("c_custkey")).alias("provider"), _pick(["a-1", "a-2", "b-9", "c-1", "zzz"], F.col("c_custkey")).alias("model"))
    return policies.catalogue(r, models).select("c_custkey", "provider", "model")


_CATALOGUE = f"""WITH r AS (SELECT c_custkey, {_pick_sql(_PROVIDERS, 'c_custkey')} AS provider, {_pick_sql(['a-1', 'a-2', 'b-9', 'c-1', 'zzz'], 'c_custkey')} AS model FROM customer)
SELECT c_custkey, provider, CASE WHEN provider || model IN ('alphaa-1', 'alphaa-2', 'betab-9', 'gammac-1') THEN model WHEN provider = 'alpha' THEN 'a-1' WHEN provider = 'beta' THEN 'b-1' ELSE model END AS model FROM r"""


def kept_parameters(spark, d):
    """Parameters a provider and model have rejected before aren't sent again."""
    o = _read(spark, d, "orders").select("o_orderkey", _pick(_PROVIDERS, F.col("o_custkey")).alias("provider"), F.concat(F.lit("m"), F.pmod("o_orderkey", F.lit(3))).alias("model"), _pick(["temperature", "top_p", "reasoning"], F.col("o_orderkey") + F.col("o_custkey")).alias("param"))
    errors = ["Unsupported parameter: 'temperature' is not supported with this model.", "Unknown parameter: 'top_p'.", "internal error", "Unrecognized request argument supplied: reasoning"]
    told = o.filter("o_orderkey % 7 < 4 and model <> 'm2' and provider <> 'delta' and (param <> 'top_p' or model = 'm1')").select("provider", "model", policies.rejected_parameter(_pick(errors, F.pmod("o_orderkey", F.lit(7)))).alias("param")).filter("param is not null")
    return policies.drop_rejected(o, told).select("o_orderkey", "provider", "model", "param")


_KEPT = f"""WITH o AS (SELECT o_orderkey, {_pick_sql(_PROVIDERS, 'o_custkey')} AS provider, 'm' || o_orderkey % 3 AS model, {_pick_sql(['temperature', 'top_p', 'reasoning'], '(o_orderkey + o_custkey)')} AS param FROM orders),
t AS (SELECT provider, model, CASE o_orderkey % 7 WHEN 0 THEN 'temperature' WHEN 1 THEN 'top_p' WHEN 3 THEN 'reasoning' END AS param FROM o WHERE o_orderkey % 7 < 4 AND model <> 'm2' AND provider <> 'delta' AND (param <> 'top_p' OR model = 'm1'))
SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.provider = o.provider AND t.model = o.model AND t.param = o.param)"""

_URLS = ["https://api.example.org/v1", "http://api.example.org", "http://localhost:8080/x", "HTTP://127.0.0.1", "not an address", "ftp://example.org/a", "https://localhost.example.org", "http://localhost.example.org:80/"]


def endpoints(spark, d):
    """Allowed by default, with insecure ones, and on this machine only."""
    e, url = _read(spark, d, "events"), _pick(_URLS, F.col("event_id"))
    no, yes = F.lit(False), F.lit(True)
    return e.select("event_id", T.endpoint_allowed(url, no, no).alias("secure"), T.endpoint_allowed(url, yes, no).alias("any"), T.endpoint_allowed(url, yes, yes).alias("here"))


_ENDPOINTS = "SELECT event_id, event_id % 8 IN (0, 2, 3, 6) AS secure, event_id % 8 IN (0, 1, 2, 3, 6, 7) AS \"any\", event_id % 8 IN (2, 3) AS here FROM events"


def registered_secrets(spark, d):
    """Literals known at run time go before the patterns do; those under four characters don't count."""
    p = _read(spark, d, "part").select("p_partkey", F.concat(F.lit("key "), "p_brand", F.lit(" and abc, api_key=abcdefgh1234")).alias("text"))
    return p.select("p_partkey", T.redact(F.col("text"), ["Brand#13", "abc", "Brand#2"]).alias("text"))


_REGISTERED = f"SELECT p_partkey, 'key ' || replace(replace(p_brand, 'Brand#13', '{X.REDACTED}'), 'Brand#2', '{X.REDACTED}') || ' and abc, api_key={X.REDACTED}' AS text FROM part"


def payloads(spark, d):
    """A request as JSON; glossary and context only where there are any."""
    p = _read(spark, d, "part")
    k = F.col("p_partkey")
    blocks = F.array(F.struct(F.concat(F.lit("b"), k).alias("id"), F.col("p_name").alias("text")))
    rules = F.when(F.pmod(k, F.lit(2)) == 0, F.array(F.col("p_type"))).otherwise(F.array().cast("array<string>"))
    return p.select("p_partkey", policies.prompt(F.lit("Translate."), blocks, rules, F.when(F.pmod(k, F.lit(3)) == 0, F.col("p_brand")).otherwise(""), F.when(F.pmod(k, F.lit(5)) == 0, F.col("p_size"))).alias("payload"))


_PAYLOADS = """SELECT p_partkey, '{"system":"Translate.","blocks":[{"id":"b' || p_partkey || '","text":"' || p_name || '"}]' || CASE WHEN p_partkey % 2 = 0 THEN ',"glossary":["' || p_type || '"]' ELSE '' END
  || CASE WHEN p_partkey % 3 = 0 THEN ',"previousContext":"' || p_brand || '"' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN ',"charBudget":' || p_size ELSE '' END || '}' AS payload FROM part"""


def batch_answers(spark, d):
    """The three shapes of a batch answer, a wrong count, and no JSON."""
    p = _read(spark, d, "part")
    k, name = F.pmod("p_partkey", F.lit(5)), F.col("p_name")
    raw = F.when(k == 0, F.to_json(F.array(name, F.col("p_type")))).when(k == 1, F.concat(F.lit("["), F.to_json(F.array(name, F.lit("en"))), F.lit("]"))).when(k == 2, F.concat(F.lit('"'), name, F.lit('"'))).when(k == 3, F.to_json(F.array(name))).otherwise("<html>")
    return p.select("p_partkey", F.array_join(exchange.batch_answers_udf(raw, F.when(k.isin(0, 3), 2).otherwise(1)), "|").alias("answers"))


_BATCH = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || '|' || p_type WHEN 1 THEN p_name WHEN 2 THEN p_name END AS answers FROM part"


# --- refresh, repair, queue ---------------------------------------------------------------------------------------------------------


def refreshed(spark, d):
    """What each level of a refresh finds in the caches, and what the failure memory keeps."""
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("hash"))
    page = docs.filter("id % 3 = 0").select("id", F.lit("page").alias("text"))
    segment = docs.filter("id % 2 = 0").groupBy("hash").agg(F.lit("segment").alias("text"))
    failures = docs.filter("id % 5 = 0").select("hash").distinct()
    out = docs.select("id", "hash")
    for level in ("none", "normal", "force"):
        cached = policies.refresh(docs, page, segment, level).select("id", F.col("cached").alias(level))
        kept = policies.refreshed_failures(failures, docs.filter("id % 10 = 0"), level).select("hash", F.lit(True).alias(f"f_{level}"))
        out = out.join(cached, "id").join(kept, "hash", "left").withColumn(f"f_{level}", F.coalesce(f"f_{level}", F.lit(False)))
    return out.drop("hash")


_REFRESHED = """WITH d AS (SELECT doc_id AS id, md5(text) AS hash FROM documents), s AS (SELECT DISTINCT hash FROM d WHERE id % 2 = 0), f AS (SELECT DISTINCT hash FROM d WHERE id % 5 = 0), g AS (SELECT DISTINCT hash FROM d WHERE id % 10 = 0)
SELECT id, CASE WHEN id % 3 = 0 THEN 'page' WHEN hash IN (FROM s) THEN 'segment' END AS "none", CASE WHEN hash IN (FROM s) THEN 'segment' END AS normal, NULL::VARCHAR AS force,
  hash IN (FROM f) AS f_none, hash IN (FROM f) AND hash NOT IN (FROM g) AS f_normal, false AS f_force FROM d"""


def repaired(spark, d):
    """A redone turn replaces the old one if it is valid (not empty) and its residue has gone."""
    c = _read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "turn", "text")
    k = F.pmod(F.length("text") + F.col("turn"), F.lit(4))
    new = c.filter("turn % 3 <> 0").select("id", F.when(k == 0, "").when(k == 1, F.concat(F.lit("still the same six plain words here "), "text")).otherwise("结果").alias("text"))
    plain = ~R.like(F.col("new"), "still the same six plain words")
    return policies.accept_repair(c, new, F.col("new") != "", plain).select("id", "text")


_REPAIRED = "SELECT conv_id || '-' || turn AS id, CASE WHEN turn % 3 <> 0 AND (length(text) + turn) % 4 >= 2 AND NOT contains(text, 'still the same six') THEN '结果' ELSE text END AS text FROM conversations"


#: What waits after enqueue (ignored while the key waits), promote and cancel, most urgent first.
_QUEUE = f"""WITH e AS (SELECT user_id % 20 AS queue, event_id AS seq, {_pick_sql(["enqueue", "enqueue", "promote", "enqueue", "cancel", "enqueue"], 'event_id')} AS verb, 'k' || event_id % 37 AS key, (event_id % 5)::INT AS priority FROM events),
c AS (SELECT *, coalesce(max(CASE WHEN verb = 'cancel' THEN seq END) OVER (PARTITION BY queue, key), -1) AS gone FROM e),
q AS (SELECT queue, key, min(seq) AS seq, min_by(priority, seq) AS own FROM c WHERE verb = 'enqueue' AND seq > gone GROUP BY queue, key),
p AS (SELECT q.queue, q.key, q.seq, greatest(own, coalesce(max(c.priority), own)) AS priority FROM q LEFT JOIN c ON c.queue = q.queue AND c.key = q.key AND c.verb = 'promote' AND c.seq > q.seq GROUP BY q.queue, q.key, q.seq, own)
SELECT queue, key, priority, seq, row_number() OVER (PARTITION BY queue ORDER BY priority DESC, seq)::INT AS place FROM p"""


def extractions(spark, d):
    """Two slots a supplier; a slot stays busy past the limit, a result after it is late."""
    li = _read(spark, d, "supplier").select((F.col("s_suppkey") % 3).alias("lane"), F.col("s_suppkey").alias("seq"), (F.col("s_suppkey") * 2).alias("asked"), F.pmod(F.col("s_suppkey") * 7, F.lit(31)).alias("seconds"))
    return policies.finished(li)


_EXTRACTIONS = """WITH RECURSIVE e AS (SELECT s_suppkey % 3 AS lane, s_suppkey AS seq, (s_suppkey * 2)::DOUBLE AS asked, (s_suppkey * 7 % 31)::DOUBLE AS seconds, row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey) AS r FROM supplier),
f AS (SELECT lane, 0::BIGINT AS r, NULL::BIGINT AS seq, 0.0::DOUBLE AS start, 0.0::DOUBLE AS "end", 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS seconds FROM e GROUP BY lane
  UNION ALL SELECT e.lane, e.r, e.seq, greatest(e.asked, least(f.a, f.b)), greatest(e.asked, least(f.a, f.b)) + e.seconds, greatest(f.a, f.b), greatest(e.asked, least(f.a, f.b)) + e.seconds, e.seconds FROM f JOIN e ON e.lane = f.lane AND e.r = f.r + 1)
SELECT lane, seq, start, "end", seconds > 20 AS late FROM f WHERE r > 0"""


def longest_first(spark, d):
    """Literals to protect, the longest first, then as they came."""
    return _read(spark, d, "part").groupBy("p_brand").agg(layout.longest_first(F.collect_list(F.struct(F.col("p_partkey").alias("place"), F.col("p_type").alias("text")))).alias("types")).select("p_brand", F.array_join("types", "|").alias("types"))


_LONGEST = "SELECT p_brand, string_agg(p_type, '|' ORDER BY length(p_type) DESC, p_partkey) AS types FROM part GROUP BY p_brand"

_QUERIES = {
    "s01_glyph_scan": (glyph_scan, _GLYPH_SCAN),
    "s02_span_scan": (span_scan, _SPAN_SCAN),
    "s03_whole_text": (whole_text, "SELECT conv_id AS doc_id, string_agg(coalesce(text, ''), '' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id"),
    "x09_glyph_text": (glyph_text, f"WITH {_GLYPHS} SELECT doc_id, page, p_name || ' ' || p_type AS text FROM t JOIN part ON p_partkey::VARCHAR = doc_id"),
    "s07_image_rects": (image_rects, _IMAGES),
    "s17_batch_answers": (batch_answers, _BATCH),
    "s19_endpoints": (endpoints, _ENDPOINTS),
    "f18_shared_column": (shared_column, f"{_PAIRS} SELECT doc_id, page, ord, wide > 0 AND (narrow <= 0 OR wide / narrow >= 0.5) AS value FROM p"),
    "f19_paragraph_break": (paragraph_breaks, _BREAKS),
    "f23_shard": (shards, _SHARDS),
    "f24_replaceable": (replaceable, _REPLACEABLE),
    "f35_translated": (translations, _TRANSLATIONS),
    "f37_context_bleed": (context_bleeds, _BLEEDS),
    "f38_formula_risk": (formula_risk, _RISK),
    "j01_cached_blocks": (cached_blocks, _CACHED),
    "j09_figure_between": (figures_between, _BETWEEN),
    "j16_shared_rows": (shared_rows, _SHARED),
    "a02_weighted_size": (weighted_size, _WEIGHTED),
    "a08_row_bands": (row_bands, f"{_CELLS}, {_BANDS} SELECT doc_id, page, cluster, y::DOUBLE AS band FROM g"),
    "a18_list_hash": (list_hash, _LIST_HASH),
    "m01_content_hash": (layout_queries.hashes, _CONTENT_HASH),
    "m03_affine": (affine, _AFFINE),
    "m04_flip": (flipped, _FLIPPED),
    "m11_ink_spans": (ink, _INK),
    "w25_push_down": (pushed_down, _PUSHED),
    "l02_ranked_problems": (ranked_problems, _RANKED),
    "l04_longest_first": (longest_first, _LONGEST),
    "p03_gutter_taken": (gutters_taken, _TAKEN),
    "p04_region_gaps": (region_gaps, _GAPS),
    "p07_obstacle_boxes": (obstacle_boxes, _OBSTACLES),
    "p17_effective_config": (effective_config, _CONFIG),
    "p18_catalogue": (catalogue, _CATALOGUE),
    "p20_registered_secrets": (registered_secrets, _REGISTERED),
    "e09_kept_parameters": (kept_parameters, _KEPT),
    "v05_profiles": (stored_profiles, _STORED),
    "x24_payloads": (payloads, _PAYLOADS),
    "r18_queue_verbs": (state_queries.queued, _QUEUE),
    "r07_extractions": (extractions, _EXTRACTIONS),
    "r14_refresh": (refreshed, _REFRESHED),
    "r17_repaired": (repaired, _REPAIRED),
}


def queries() -> dict:
    return {n: q for n, (q, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _QUERIES.items()}

"""Queries for policies and the remaining page rules, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import layout, policies
from . import pages, snippets


def _read(spark, d, table):
    return spark.read.parquet(f"{d}/{table}.parquet")


def codes(spark, d):
    """X22 / X26."""
    docs = _read(spark, d, "documents")
    code = F.element_at(F.array(*[F.lit(x) for x in ("auto", "zh", "zh-TW", "no", "en", "de")]), (F.pmod("doc_id", F.lit(6)) + 1).cast("int"))
    url = F.element_at(F.array(*[F.lit(x) for x in ("https://a.example/v1/", "https://a.example", "", "https://a.example/v3beta", "https://a.example/v1/messages")]), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    return docs.select("doc_id", policies.language_code(code, "auto-detecting").alias("a"), policies.language_code(code, "plain").alias("b"), policies.versioned_base(url, "https://d.example").alias("base"), policies.messages_url(url).alias("messages"))


_CODES = """WITH d AS (SELECT doc_id, (['auto', 'zh', 'zh-TW', 'no', 'en', 'de'])[doc_id % 6 + 1] AS c, (['https://a.example/v1/', 'https://a.example', '', 'https://a.example/v3beta', 'https://a.example/v1/messages'])[doc_id % 5 + 1] AS u FROM documents),
e AS (SELECT *, regexp_replace(CASE WHEN u = '' THEN 'https://d.example' ELSE u END, '/+$', '') AS b, regexp_replace(u, '/+$', '') AS m FROM d)
SELECT doc_id, CASE c WHEN 'auto' THEN 'auto-detect' WHEN 'zh' THEN 'zh-Hans' WHEN 'zh-TW' THEN 'zh-Hant' WHEN 'no' THEN 'nb' ELSE c END AS a, CASE c WHEN 'zh' THEN 'zh-CN' ELSE c END AS b,
  CASE WHEN regexp_matches(b, '/v\\d+[a-z]*$') THEN b ELSE b || '/v1' END AS base, CASE WHEN m LIKE '%/v1/messages' THEN m ELSE regexp_replace(m, '/v1$', '') || '/v1/messages' END AS messages FROM e"""


def annotations(spark, d):
    """X21 over snippets dressed as annotated answers."""
    s = snippets.table(spark, d)
    return s.select("doc_id", "pos", policies.cleaned_annotations(F.concat(F.lit("<pre x>"), F.lit("<i>src</i> <b>"), F.regexp_replace("text", "[<>&]", ""), F.lit("</b> &amp; <i>more</i><b>end</b></pre>"))).alias("value"))


_ANNOTATIONS = f"{snippets.sql()}\nSELECT doc_id, pos, trim(regexp_replace(regexp_replace(text, '[<>&]', '', 'g') || ' &  end', '[\\s\\x{{a0}}]+', ' ', 'g')) AS value FROM s"


def spanning(spark, d):
    """Full-width blocks in every column, collapsed again, and the height that pages need."""
    b = pages.blocks(spark, d).select("doc_id", "page", F.col("ord").alias("id"), "column", F.col("y1").alias("top"), (F.col("y2") - F.col("y1")).alias("height"))
    wide = policies.spanning_expanded(b, 2).withColumn("top", F.col("top") + F.col("column") * 9)
    low = policies.spanning_collapsed(wide).join(b.select("doc_id", "page", "id", "height"), ["doc_id", "page", "id"])
    return policies.required_height(low, 700.0)


_SPANNING = f"""{pages.sql()}\nSELECT doc_id, page, greatest(700.0, max(y2 + CASE WHEN "column" = -1 THEN 9 ELSE "column" * 9 END))::DOUBLE AS height FROM b GROUP BY ALL"""


def below(spark, d):
    """J13."""
    b = pages.blocks(spark, d)
    return policies.nearest_below(b.filter("k % 5 = 0"), b.filter("k % 5 <> 0").select("doc_id", "page", "ord", "x1", "x2", "y1", "y2"))


_BELOW = f"""{pages.sql()}\nSELECT c.doc_id, c.page, c.ord AS caption, arg_min(b.ord, (b.y1, b.ord)) AS ord FROM b c JOIN b ON b.doc_id = c.doc_id AND b.page = c.page AND b.y1 >= c.y2 AND least(b.x2, c.x2) > greatest(b.x1, c.x1)
WHERE c.k % 5 = 0 AND b.k % 5 <> 0 GROUP BY ALL"""


def coerced(spark, d):
    """A12 over a grid made of blocks."""
    b = pages.blocks(spark, d).select("doc_id", "page", F.lit(0).alias("table"), F.floor(F.col("ord") / 3).cast("int").alias("row"), F.pmod("ord", F.lit(3)).alias("col"), F.when(F.pmod("k", F.lit(4)) == 0, "text").otherwise("data").alias("kind"))
    return policies.numeric_columns(b).select("doc_id", "page", "row", "col", "kind")


_COERCED = f"""{pages.sql()}, c AS (SELECT doc_id, page, (ord // 3)::INT AS row, ord % 3 AS col, CASE WHEN k % 4 = 0 THEN 'text' ELSE 'data' END AS kind FROM b),
w AS (SELECT *, count(*) FILTER (row > 0) OVER p AS n, count(*) FILTER (row > 0 AND kind = 'data') OVER p AS d FROM c WINDOW p AS (PARTITION BY doc_id, page, col))
SELECT doc_id, page, row, col, CASE WHEN row > 0 AND n >= 3 AND d::DOUBLE / n >= 0.7 THEN 'data' ELSE kind END AS kind FROM w"""


def tally(spark, d):
    """A16 / P08."""
    b = pages.blocks(spark, d).withColumn("status", F.element_at(F.array(*[F.lit(x) for x in ("placed", "placed", "abandoned", "untranslated", "placed")]), (F.pmod("k", F.lit(5)) + 1).cast("int")))
    return policies.placement_tally(b)


_TALLY = f"""{pages.sql()}, st AS (SELECT doc_id, page, count(*) FILTER (k % 5 NOT IN (2, 3)) AS placed, count(*) FILTER (k % 5 IN (2, 3)) AS kept FROM b GROUP BY ALL)
SELECT *, CASE WHEN kept = 0 THEN 'complete' WHEN placed = 0 THEN 'original' ELSE 'partial' END AS phase FROM st"""


def budgeted(spark, d):
    """Events as requests of pages, and each user's most urgent task."""
    e = _read(spark, d, "events").select(F.lit(0).alias("doc_id"), F.col("user_id").alias("page"), F.col("event_id").alias("seq"))
    return policies.request_budget(e, F.lit(1), F.pmod("page", F.lit(2)) == 0).select("page", "seq")


def urgent(spark, d):
    e = _read(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("task"), F.col("event_id").alias("seq"), F.element_at(F.array(*[F.lit(x) for x in ("done", "waiting", "failed", "done", "running", "done", "done")]), (F.pmod("event_id", F.lit(7)) + 1).cast("int")).alias("state"))
    return policies.most_urgent(e)


def expansion(spark, d):
    """Room around each block against the page's full-width blocks, if it has any, and real collisions with them."""
    b = pages.blocks(spark, d)
    wide = b.filter('column = -1').groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("x1", "y1", "x2", "y2"))).alias("o"))
    me = F.struct("x1", "y1", "x2", "y2")
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    rows = b.filter("column <> -1").join(wide, ["doc_id", "page"], "left").withColumn("o", F.coalesce("o", none))
    e = G.expansion(me, F.col("o"), pages.PAGE_WIDTH, pages.PAGE_HEIGHT, F.col("font"))
    return rows.select("doc_id", "page", "ord", e["right"].alias("right"), e["down"].alias("down"), F.exists("o", lambda o: G.penetrates(me, o)).alias("hit"))


_EXPANSION = f"""{pages.sql()}, p AS (SELECT a.*, b.x1 AS ox1, b.y1 AS oy1, b.x2 AS ox2, b.y2 AS oy2, least(a.x2, b.x2) - greatest(a.x1, b.x1) AS h, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS v FROM b a LEFT JOIN b ON b.doc_id = a.doc_id AND b.page = a.page AND b."column" = -1 WHERE a."column" <> -1)
SELECT doc_id, page, ord, greatest(0, least(greatest(0, {pages.PAGE_WIDTH} * 0.9::DOUBLE - any_value(x2)), coalesce(min(ox1 - x2 - 3) FILTER (v > 2 AND ox2 > x2 - 1), 1e9), (any_value(x2) - any_value(x1)) * 0.6::DOUBLE))::DOUBLE AS "right",
  greatest(0, least(greatest(0, {pages.PAGE_HEIGHT} * 0.95::DOUBLE - any_value(y2)), coalesce(min(oy1 - y2 - 3) FILTER (h > 2 AND oy2 > y2 - 1), 1e9), greatest(any_value(font) * 2.8::DOUBLE, (any_value(y2) - any_value(y1)) * 0.5::DOUBLE)))::DOUBLE AS down,
  coalesce(bool_or(ox1 IS NOT NULL AND h > 4 AND v > 4 AND h > least(x2 - x1, ox2 - ox1) * 0.12 + 4), false) AS hit FROM p GROUP BY doc_id, page, ord"""


def health(spark, d):
    """documents as pages: lines are fragments, blocks units."""
    b = pages.blocks(spark, d).groupBy("doc_id").agg(F.sum("lines").alias("fragments"), (F.count("*") * 2).alias("units"))
    return layout.grouping_health(b)


_QUERIES = {
    "x22_language_codes": (codes, _CODES),
    "x21_annotations": (annotations, _ANNOTATIONS),
    "p05_spanning_blocks": (spanning, _SPANNING),
    "j13_nearest_below": (below, _BELOW),
    "a12_numeric_columns": (coerced, _COERCED),
    "a16_placement_tally": (tally, _TALLY),
    "l06_request_budget": (budgeted, "SELECT user_id AS page, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= CASE WHEN user_id % 2 = 0 THEN 8 ELSE 4 END"),
    "l07_most_urgent": (urgent, "SELECT user_id AS session, arg_max(event_id, (CASE event_id % 7 WHEN 4 THEN 4 WHEN 2 THEN 3 WHEN 1 THEN 2 ELSE 1 END, event_id)) AS task FROM events GROUP BY user_id"),
    "m08_expansion": (expansion, _EXPANSION),
    "f40_grouping_health": (health, f"{pages.sql()}, g AS (SELECT doc_id, sum(lines)::BIGINT AS fragments, count(*) * 2 AS units FROM b GROUP BY ALL)\nSELECT * FROM g WHERE fragments >= 40 AND units / fragments > 0.85"),
}


def queries() -> dict:
    return {n: q for n, (q, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _QUERIES.items() if s}

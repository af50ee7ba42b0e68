"""Queries for joins, set operations, caches, policies, ordered state, sources and page-wise algorithms, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import regex as R
from ..functions import similarity
from ..functions import text as T
from ..functions.regex import SPACE, re2
from ..operators import exchange, lanes, layout, masking, pagewise
from ..sources import readers
from . import pages, snippets


def _read(spark, d, table):
    return spark.read.parquet(f"{d}/{table}.parquet")


# --- joins and sets --------------------------------------------------------------------------------------------------


def validated(spark, d):
    """V03 / J03-J05 over conversations: every turn is expected; the answers are turns moved on by one, some twice."""
    c = _read(spark, d, "conversations").select(F.col("conv_id").alias("req"), "turn", "text")
    requests = c.select("req", F.concat(F.lit("b"), F.col("turn")).alias("id"))
    answers = c.select("req", F.explode(F.array(F.col("turn"), F.col("turn") + 1)).alias("k"), F.col("turn").alias("pos"), "text").filter("k % 4 <> 3")
    return exchange.validate(requests, answers.select("req", "pos", F.concat(F.lit("b"), F.col("k")).alias("id"), "text"))


_VALIDATED = """WITH r AS (SELECT conv_id AS req, 'b' || turn AS id FROM conversations),
a AS (SELECT conv_id AS req, unnest([turn, turn + 1]) AS k, turn AS pos, text FROM conversations),
f AS (SELECT req, 'b' || k AS id, text, row_number() OVER (PARTITION BY req, k ORDER BY pos) AS n FROM a WHERE k % 4 <> 3),
g AS (SELECT * FROM f WHERE n = 1)
SELECT coalesce(r.req, g.req) AS req, coalesce(r.id, g.id) AS id, CASE WHEN g.id IS NULL THEN 'missing' WHEN r.id IS NULL THEN 'unexpected' ELSE 'ok' END AS status,
  CASE WHEN g.id IS NOT NULL AND r.id IS NOT NULL THEN g.text END AS text FROM r FULL JOIN g ON r.req = g.req AND r.id = g.id"""


def replaced(spark, d):
    """Every third block is replaced by two cells, the rest stays."""
    b = pages.blocks(spark, d).select("doc_id", "page", "ord", "text")
    members = b.filter("ord % 3 = 0").select("doc_id", "page", "ord")
    cells = b.filter("ord % 3 = 0").select("doc_id", "page", "ord", F.explode(F.array(F.lit(0), F.lit(1))).alias("table_col"))
    return exchange.replace_members(b, cells, members)


_REPLACED = f"{pages.sql()}\nSELECT doc_id, page, ord, text, NULL::INT AS table_col FROM b WHERE ord % 3 <> 0 UNION ALL SELECT doc_id, page, ord, NULL, unnest([0, 1]) FROM b WHERE ord % 3 = 0"


def requested(spark, d):
    """The requested subset: blocks of documents that have labels."""
    return _read(spark, d, "documents").join(_read(spark, d, "labels").filter("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


def merged_layers(spark, d):
    """Glossary layers (by language) over lower-cased first words; the first layer wins."""
    rules = _read(spark, d, "documents").select(F.regexp_extract("text", r"^(\S+)", 1).alias("term"), F.pmod("doc_id", F.lit(3)).alias("layer"), F.col("doc_id").alias("pos"), "lang")
    return exchange.merge_layers(rules, F.lower("term")).select(F.lower("term").alias("term"), "layer", "pos", "lang")


_MERGED = "WITH r AS (SELECT lower(regexp_extract(text, '^(\\S+)', 1)) AS term, doc_id % 3 AS layer, doc_id AS pos, lang FROM documents)\nSELECT term, layer, pos, lang FROM r QUALIFY row_number() OVER (PARTITION BY term ORDER BY layer, pos) = 1"


def glossary_matches(spark, d):
    """Benchmark items' first three words looked for in all documents."""
    rules = _read(spark, d, "benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("source")).distinct()
    return readers.matching_rules(rules, _read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


_MATCHES = "WITH r AS (SELECT DISTINCT array_to_string(string_split(text, ' ')[1:3], ' ') AS source FROM benchmark)\nSELECT doc_id AS id, r.source AS source FROM documents d, r WHERE r.source <> '' AND contains(lower(d.text), lower(r.source))"


def providers(spark, d):
    """Page modulo a pool without repeats."""
    pool = F.array_distinct(F.array(*[F.lit(x) for x in ("alpha", "beta", "alpha", "gamma")]))
    return _read(spark, d, "pages").select("page_id", exchange.pool_provider(pool, F.col("page_id") - 3).alias("provider"))


def previous_context(spark, d):
    """The tail of the turn before."""
    c = _read(spark, d, "conversations")
    return c.select("conv_id", "turn", F.lag(T.trailing_context(F.col("text"))).over(Window.partitionBy("conv_id").orderBy("turn")).alias("context"))


def source_fallback(spark, d):
    """Pages from the first source that has them; S05: documents with any text."""
    b = pages.blocks(spark, d).select("doc_id", "page", "ord", "text")
    a, c = b.filter("(doc_id + page) % 3 = 0").withColumn("kind", F.lit("glyphs")), b.filter("(doc_id + page) % 2 = 0").withColumn("kind", F.lit("spans"))
    return readers.first_source(a, c, b.withColumn("kind", F.lit("text"))).select("doc_id", "page", "ord", "kind")


_FALLBACK = f"{pages.sql()}\nSELECT doc_id, page, ord, CASE WHEN (doc_id + page) % 3 = 0 THEN 'glyphs' WHEN (doc_id + page) % 2 = 0 THEN 'spans' ELSE 'text' END AS kind FROM b"


def has_text(spark, d):
    b = pages.blocks(spark, d).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("text"))
    return readers.has_text(b)


_HAS_TEXT = f"""{pages.sql()}, p AS (SELECT doc_id, page, string_agg(text, ' ' ORDER BY ord) AS text FROM b GROUP BY ALL), m AS (SELECT *, max(page) OVER (PARTITION BY doc_id) AS z FROM p)
SELECT doc_id, max(length(regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'))) > 10 AS has_text FROM m WHERE page = 0 OR page = z // 2 OR page = z GROUP BY doc_id"""


def plain_blocks(spark, d):
    """S06 over documents whose full stops before a space become blank lines, with a references heading in every seventh."""
    text = F.concat(F.replace("text", F.lit(". "), F.lit(".\n\n")), F.when(F.pmod("doc_id", F.lit(7)) == 0, "\n\nReferences\n\nA. Nobody, 1999").otherwise(""))
    return readers.text_blocks(_read(spark, d, "documents").select("doc_id", text.alias("text")))


_PLAIN = f"""WITH d AS (SELECT doc_id, replace(text, '. ', '.' || chr(10) || chr(10)) || CASE WHEN doc_id % 7 = 0 THEN chr(10) || chr(10) || 'References' || chr(10) || chr(10) || 'A. Nobody, 1999' ELSE '' END AS text FROM documents),
p AS (SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(text, '\\n[{SPACE}]*\\n', chr(1), 'g'), '\\n([A-Z0-9一-鿿•▪◦‣·*–—-])', chr(1) || '\\1', 'g'), chr(1)) AS l FROM d),
u AS (SELECT doc_id, unnest(range(len(l)))::INT AS ord, regexp_replace(unnest(l), '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS text FROM p),
f AS (SELECT * FROM u WHERE length(text) >= 2), g AS (SELECT *, max(regexp_matches(text, {re2(X.REFERENCES, True)})::INT) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM f)
SELECT doc_id, ord, text FROM g WHERE coalesce(seen, 0) = 0"""


def glossary_parsed(spark, d):
    """Lines made of parts' names; round trip through the line format."""
    p = _read(spark, d, "part")
    k = F.pmod("p_partkey", F.lit(5))
    line = F.when(k == 0, F.concat(F.lit("# "), F.col("p_name"))).when(k == 1, F.concat_ws(" -> ", "p_brand", "p_name")).when(k == 2, F.concat_ws("\t", "p_brand", "p_type")).when(k == 3, F.concat(F.col("p_brand"), F.lit(" → "), F.col("p_type"), F.lit(" ?"))).otherwise(F.col("p_brand"))
    out = readers.glossary_lines(p.select("p_partkey", line.alias("line")))
    return out.select("p_partkey", "source", "target", "mode", readers.glossary_out(out).alias("line"))


_GLOSSARY = """WITH a AS (SELECT p_partkey, p_partkey % 5 AS k, p_brand, p_name, p_type FROM part WHERE p_partkey % 5 IN (1, 2, 3)),
b AS (SELECT p_partkey, trim(p_brand) AS source, trim(CASE WHEN k = 1 THEN p_name ELSE p_type END) AS target, CASE WHEN k = 3 THEN 'suggested' ELSE 'required' END AS mode FROM a)
SELECT *, source || ' → ' || target || CASE WHEN mode = 'suggested' THEN ' ?' ELSE '' END AS line FROM b"""


def notes(spark, d):
    """S22 over conversations."""
    return _read(spark, d, "conversations").select("conv_id", "turn", readers.note(F.col("role"), F.col("text")).alias("note"))


_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_NOTES = f"SELECT conv_id, turn, '<h1>' || {_ESC.format('role')} || '</h1>' || array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> ''), lambda p: '<p>' || {_ESC.format('p')} || '</p>'), '') AS note FROM conversations"


def diagnosed(spark, d):
    """S23 / A15."""
    b = pages.blocks(spark, d).withColumn("status", F.when(F.pmod("k", F.lit(4)) == 0, "missing").otherwise("ok"))
    return readers.diagnostics(b)


_DIAGNOSED = f"""{pages.sql()}\nSELECT doc_id, page, '{{"blocks":' || count(*) || ',"ok":' || count(*) FILTER (k % 4 <> 0) || ',"missing":' || count(*) FILTER (k % 4 = 0) || ',"chars":' || sum(length(text)) || '}}' AS report FROM b GROUP BY ALL"""


def top_residues(spark, d):
    """At most eight blocks a page, the longest first."""
    b = pages.blocks(spark, d)
    return b.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc(F.length("text")), "ord"))).filter("r <= 8").select("doc_id", "page", "ord", "r")


def term_pairs(spark, d):
    """Terms with abbreviations, first meaning in each document, at most 200."""
    s = snippets.table(spark, d).select("doc_id", "pos", F.explode(similarity.term_pairs(F.lit("RCT HF CI"), F.col("text"))).alias("p")).select("doc_id", "pos", "p.source", "p.target")
    return lanes.first_terms(s)


_TERMS = f"""{snippets.sql()}, t AS (SELECT doc_id, pos, unnest(regexp_extract_all(text, {re2(X.TERM_PAIR)}, 2)) AS source, unnest(regexp_extract_all(text, {re2(X.TERM_PAIR)}, 1)) AS target FROM s),
f AS (SELECT doc_id, source, min_by(target, pos) AS target, min(pos) AS pos FROM t WHERE source IN ('RCT', 'HF') GROUP BY ALL)
SELECT doc_id, source, target, pos FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos, source) <= 200"""


# --- caches ------------------------------------------------------------------------------------------------------------


def _cache(spark, d):
    docs = _read(spark, d, "documents")
    key = {c: F.lit("x") for c in exchange.KEY} | {"attachment": F.col("source"), "page": F.col("doc_id").cast("int"), "target_language": F.col("lang"), "text_hash": F.sha2("text", 256)}
    k = F.pmod("doc_id", F.lit(6))
    item = F.array(F.struct(F.lit("b0").alias("id"), F.when(k == 1, F.lit(None)).otherwise(F.col("lang")).alias("text")))
    return docs.select("doc_id", *[v.alias(c) for c, v in key.items()], F.when(k == 2, 4).otherwise(5).alias("schema_version"), item.alias("translations"), F.timestamp_seconds(F.col("doc_id")).alias("created_at"), F.when(k == 3, F.concat("source", F.lit(".json.tmp"))).otherwise(F.concat("source", F.lit(".json"))).alias("path"), F.timestamp_seconds(F.col("doc_id") * 10).alias("modified"))


def page_cache(spark, d):
    """Every page is looked up; only valid entries hit."""
    c = _cache(spark, d)
    return exchange.page_hits(c.select("doc_id", *exchange.KEY), c.filter("doc_id % 5 <> 0").drop("doc_id")).select("doc_id", F.col("translations")[0]["text"].alias("cached"))


def swept(spark, d):
    """Stale entries by kind, and their size."""
    now = F.timestamp_seconds(F.lit(5000))
    return exchange.stale(_cache(spark, d), now).groupBy("schema_version").agg(F.count("*").alias("entries"), F.sum(F.length("path")).alias("bytes"))


def invalidated(spark, d):
    """What stays after one attachment goes."""
    return exchange.invalidate(_cache(spark, d), "src3").groupBy("attachment").agg(F.count("*").alias("entries"))


def segments(spark, d):
    """Two writes of the segment store, last one wins; lookups by hash."""
    docs = _read(spark, d, "documents").select(F.md5(F.concat_ws("\x01", "text", "lang")).alias("hash"), "doc_id", "lang")
    old = docs.filter("doc_id % 3 = 0").groupBy("hash").agg(F.lit("old").alias("text"))
    new = docs.filter("doc_id % 5 = 0").groupBy("hash").agg(F.lit("new").alias("text"))
    return exchange.segment_hits(docs.select("doc_id", "hash"), exchange.segment_merge(old, new)).select("doc_id", "cached")


_SEGMENTS = """WITH d AS (SELECT doc_id, md5(text || chr(1) || lang) AS hash FROM documents), o AS (SELECT DISTINCT hash FROM d WHERE doc_id % 3 = 0), n AS (SELECT DISTINCT hash FROM d WHERE doc_id % 5 = 0)
SELECT doc_id, CASE WHEN n.hash IS NOT NULL THEN 'new' ELSE 'old' END AS cached FROM d LEFT JOIN o USING (hash) LEFT JOIN n USING (hash) WHERE o.hash IS NOT NULL OR n.hash IS NOT NULL"""


def complete(spark, d):
    """Pages all of whose blocks have been answered."""
    b = pages.blocks(spark, d).withColumn("id", F.concat_ws("-", "doc_id", "page", "ord"))
    return exchange.complete_pages(b, b.filter("k % 17 <> 0").select("id"))


def shorter(spark, d):
    """Only strictly shorter answers replace."""
    c = _read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("n"))
    return exchange.shorter_only(c.select("id", "text"), c.filter("n is not null").select("id", F.col("n").alias("text")))


def broken(spark, d):
    """Conversations as pages, turns as attempts."""
    c = _read(spark, d, "conversations").select(F.lit(0).alias("doc_id"), F.col("conv_id").alias("page"), F.col("turn").alias("attempt"), F.length("text").alias("expected"), F.pmod(F.length("text") * 7, F.lit(100)).alias("missing"))
    return exchange.breaker(c).select("page", "attempt", "expected", "missing")


# --- policies and state over events ----------------------------------------------------------------------------------------


def _events(spark, d):
    return _read(spark, d, "events")


def policies(spark, d):
    """Lane bands of every kind and mode, ceilings and prefetch windows."""
    e = _events(spark, d).select("event_id", "user_id", F.element_at(F.array(*[F.lit(x) for x in ("free", "llm", "local", "paid-mt", "other")]), (F.pmod("event_id", F.lit(5)) + 1).cast("int")).alias("kind"))
    plan = lanes.lane_plan(e.withColumnRenamed("event_id", "lane"), "auto")
    page = F.pmod("user_id", F.lit(30)).cast("int")
    p = lanes.prefetch(F.lit("auto"), F.pmod("lane", F.lit(7)).cast("int"))
    return plan.select("lane", "kind", "least", "initial", "most", lanes.custom(F.col("kind"), F.pmod("lane", F.lit(9))).alias("custom"), lanes.ceiling(F.pmod("lane", F.lit(40)) - 5).alias("ceiling"), F.size(lanes.window_pages(page, p["ahead"], p["behind"], F.lit(30))).alias("window"))


_POLICIES = """WITH e AS (SELECT event_id AS lane, user_id % 30 AS page, (['free', 'llm', 'local', 'paid-mt', 'free'])[event_id % 5 + 1] AS kind FROM events),
m AS (SELECT *, CASE kind WHEN 'llm' THEN 3 WHEN 'paid-mt' THEN 3 ELSE 1 END AS initial, CASE kind WHEN 'llm' THEN 6 WHEN 'paid-mt' THEN 4 WHEN 'local' THEN 2 ELSE 1 END AS most, greatest(1, least(2 * (lane % 7), 10)) AS ahead FROM e)
SELECT lane, kind, 1 AS least, initial, most, least(greatest(lane % 9, 1), most)::INT AS custom, CASE WHEN lane % 40 - 5 <= 0 THEN 12 ELSE least(greatest(lane % 40 - 5, 2), 24) END::INT AS ceiling,
  (least(page + ahead, 29) - greatest(page - 1, 0) + 1)::INT AS window FROM m"""


def _feedback(spark, d):
    return _events(spark, d).select((F.col("user_id") % 50).alias("lane"), F.col("event_id").alias("seq"), F.when(F.pmod("event_id", F.lit(13)) == 0, "rate").when(F.pmod("event_id", F.lit(11)) == 0, "timeout").otherwise("success").alias("kind"))


def caps(spark, d):
    """Each lane's width after all its feedback."""
    return lanes.adaptive_caps(_feedback(spark, d))


_CAPS = """WITH RECURSIVE e AS (SELECT user_id % 50 AS lane, CASE WHEN event_id % 13 = 0 THEN 'rate' WHEN event_id % 11 = 0 THEN 'timeout' ELSE 'success' END AS kind, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id % 50) AS n FROM events),
f AS (SELECT lane, 0::BIGINT AS r, 6 AS cap, 0 AS streak, max(n) AS n FROM e GROUP BY lane
  UNION ALL SELECT f.lane, e.r, CASE WHEN kind = 'rate' THEN greatest(1, cap // 2) WHEN kind = 'timeout' THEN greatest(1, cap - 1) WHEN cap < 6 AND streak + 1 >= 5 THEN cap + 1 ELSE cap END::INT,
  CASE WHEN kind <> 'success' THEN 0 WHEN cap >= 6 THEN streak WHEN streak + 1 >= 5 THEN 0 ELSE streak + 1 END, f.n FROM f JOIN e ON e.lane = f.lane AND e.r = f.r + 1)
SELECT lane, cap, streak, n::INT AS events FROM f WHERE r = n"""


def sessions(spark, d):
    """Watchdog sessions of users with the real 150 seconds; the events' clock runs 144 times as fast, as they are sparse."""
    ts = F.expr("cast(timestamp_micros(unix_micros(cast(ts as timestamp)) div 144) as timestamp_ntz)")
    return lanes.idle_sessions(_events(spark, d).select("user_id", ts.alias("ts")), "user_id", "ts").select("user_id", "start", "end", "events")


_SESSIONS = """WITH e AS (SELECT user_id, make_timestamp(epoch_us(ts) // 144) AS ts FROM events),
g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 150 SECOND OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 150 SECOND AS "end", count(*) AS events FROM s GROUP BY user_id, s"""


def latest(spark, d):
    """The newest event of every user."""
    return lanes.latest_wins(_events(spark, d), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def cooled(spark, d):
    """Echoes within 400 ms of the last accepted event of a user are dropped; the events' clock runs 108,000 times as fast, as they are sparse."""
    return lanes.cooled(_events(spark, d), "user_id", F.expr("unix_millis(cast(ts as timestamp)) div 108000"), 400)


_COOLED = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) // 108000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) // 108000, event_id) AS r FROM events),
f AS (SELECT user_id, event_id, ms AS last, r, true AS ok FROM e WHERE r = 1
  UNION ALL SELECT e.user_id, e.event_id, CASE WHEN e.ms - f.last >= 400 THEN e.ms ELSE f.last END, e.r, e.ms - f.last >= 400 FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
SELECT user_id, event_id FROM f WHERE ok"""


def failures(spark, d):
    """Order lines as runs: a hash is a part, failed where returned."""
    li = _read(spark, d, "lineitem").select(F.col("l_partkey").alias("hash"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("started"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("l_quantity").cast("long") * 100).alias("ended"), (F.col("l_returnflag") == "R").alias("failed"))
    return lanes.failure_memory(li)


_FAILURES = """WITH RECURSIVE e AS (SELECT l_partkey AS hash, l_orderkey * 10 + l_linenumber AS started, l_orderkey * 10 + l_linenumber + l_quantity::BIGINT * 100 AS ended FROM lineitem WHERE l_returnflag = 'R'),
o AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY started, ended) AS r FROM e),
f AS (SELECT hash, ended AS at, 1 AS n, r FROM o WHERE r = 1
  UNION ALL SELECT o.hash, CASE WHEN o.started > f.at THEN o.ended ELSE f.at END, f.n + (o.started > f.at)::INT, o.r FROM f JOIN o ON o.hash = f.hash AND o.r = f.r + 1)
SELECT hash, max(n)::INT AS failures, max(n) >= 2 AS skip FROM f GROUP BY hash"""


def queued(spark, d):
    """Queue verbs folded to what still waits."""
    verbs = F.element_at(F.array(*[F.lit(x) for x in ("enqueue", "enqueue", "promote", "enqueue", "cancel", "enqueue")]), (F.pmod("event_id", F.lit(6)) + 1).cast("int"))
    return lanes.queue(_events(spark, d).select((F.col("user_id") % 20).alias("queue"), F.col("event_id").alias("seq"), verbs.alias("verb"), F.concat(F.lit("k"), F.pmod("event_id", F.lit(37))).alias("key"), F.pmod("event_id", F.lit(5)).cast("int").alias("priority")))


# --- page-wise algorithms (rows only; tests hold them against expectations) ----------------------------------------------------


def _pages(spark, d):
    return pages.blocks(spark, d)


def islands(spark, d):
    """Lines of glyphs: a flag after every seventh."""
    b = _pages(spark, d).select("doc_id", "page", F.col("ord").alias("pos"), F.pmod("k", F.lit(7)).eqNullSafe(F.lit(0)).alias("line_break_after"))
    return layout.line_groups(b).select("doc_id", "page", "pos", "line")


_ISLANDS = f"{pages.sql()}, l AS (SELECT doc_id, page, ord, coalesce(lag(k % 7 = 0) OVER w, false) AS cut FROM b WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord))\nSELECT doc_id, page, ord AS pos, sum(cut::INT) OVER (PARTITION BY doc_id, page ORDER BY ord)::INT AS line FROM l"


def rows_and_lines(spark, d):
    """W02 then W03 (y up within the page's own box): number of the row and of the part within it."""

    def run(rows):
        items = [pagewise.item(r | {"y1": 792 - r["y2"], "y2": 792 - r["y1"]}) for r in rows]
        for n, row in enumerate(pagewise.baseline_rows(items)):
            for i in row:
                yield {"id": i.id, "row": n, "x1": i.box.x1, "x2": i.box.x2, "font": float(i.font), "ord": int(i.id)}

    r = pagewise.run(_pages(spark, d).select("doc_id", "page", "ord", "text", "x1", "y1", "x2", "y2", "font", "column", "type"), run, "doc_id long, page int, id string, row int, x1 double, x2 double, font double, ord int")
    return layout.lines_from_rows(r, F.lit(300.0)).select("doc_id", "page", "ord", "row", "part")


def regions(spark, d):
    """Coalesced regions of each page, in canonical reading order."""
    ordered = layout.reading_order(_pages(spark, d)).select("doc_id", "page", "reading_index", "ord", "text", "x1", (F.lit(792.0) - F.col("y2")).alias("yy1"), "x2", (F.lit(792.0) - F.col("y1")).alias("yy2"), "font", "column", F.when(F.pmod("k", F.lit(9)) == 0, "caption").otherwise("paragraph").alias("type"))

    def run(rows):
        items = [pagewise.item(r | {"y1": r["yy1"], "y2": r["yy2"]}) for r in rows]
        for n, i in enumerate(pagewise.join_labels(pagewise.coalesce(items))):
            yield {"region": n, "members": ",".join(i.members or [i.id]), "chars": len(i.text)}

    return pagewise.run(ordered, run, "doc_id long, page int, region int, members string, chars int", ("reading_index",))


def modules(spark, d):
    """Modules of a page and the chunk each goes to."""
    from ..operators import chunks

    def run(rows):
        items = [pagewise.item(r) for r in rows]
        size = {i.id: len(i.text) * 6 for i in items}  # so that the limits of a chunk matter
        found = pagewise.modules(items)
        of = {m: n for n, c in enumerate(chunks.module_pack([[size[i] for i in ids] for _, _, ids in found])) for m, _ in c}
        for n, (name, kind, ids) in enumerate(found):
            yield {"module": name, "kind": kind, "members": len(ids), "chunk": of.get(n)}

    return pagewise.run(_pages(spark, d).select("doc_id", "page", "ord", "text", "x1", "y1", "x2", "y2", "font", "column", "type"), run, "doc_id long, page int, module string, kind string, members int, chunk int")


def tables(spark, d):
    """Cells of the tables found on each page."""

    def run(rows):
        items = [pagewise.item(r) for r in rows]
        for n, (_, members) in enumerate(pagewise.tables(items, 10)):
            for c in pagewise.grid(members):
                yield {"table": n, "row": c["row"], "col": c["col"], "kind": c["kind"], "text": c["text"], "members": len(c["members"])}

    # Pages of even documents: a grid of three columns, mostly numbers.
    even = F.pmod("doc_id", F.lit(2)) == 0
    numeric = _pages(spark, d).withColumn("text", F.when(even & (F.col("ord") > 2), F.concat(F.pmod("k", F.lit(97)), F.lit(" ± 1.5"))).when(even, F.concat(F.lit("n="), F.pmod("k", F.lit(97)))).otherwise(F.col("text")))
    col, row = F.pmod("ord", F.lit(3)), F.floor(F.col("ord") / 3)
    for name, value in (("x1", 60 + col * 90), ("x2", 120 + col * 90), ("y1", 100 + row * 16), ("y2", 110 + row * 16)):
        numeric = numeric.withColumn(name, F.when(even, value.cast("double")).otherwise(F.col(name)))
    return pagewise.run(numeric.select("doc_id", "page", "ord", "text", "x1", "y1", "x2", "y2", "font", "column", "type"), run, "doc_id long, page int, table int, row int, col int, kind string, text string, members int")


def column_bands(spark, d):
    """Bands, gutters, tops, and the column and run of each block of a page, as lists in the blocks' order."""

    def run(rows):
        boxes = [pagewise.item(r).box for r in rows]
        runs = [[boxes.index(b) for b in r] for r in pagewise.column_runs(boxes)]
        yield {"bands": [list(b) for b in pagewise.columns(boxes, 612, 792)], "channels": [list(c) for c in pagewise.coverage_channels(boxes)], "gutters": pagewise.gutters([[b] for b in boxes], 612), "columns": pagewise.assign_columns(boxes), "tops": pagewise.bands([b.y1 for b in boxes], 10), "runs": runs}

    kind = "doc_id long, page int, bands array<array<double>>, channels array<array<double>>, gutters array<double>, columns array<int>, tops array<double>, runs array<array<int>>"
    return pagewise.run(_pages(spark, d).select("doc_id", "page", "ord", "x1", "y1", "x2", "y2"), run, kind)


def flowed(spark, d):
    """Placed tops by each of the three methods."""

    def run(rows):
        items = [{"id": str(r["ord"]), "column": r["column"], "top": r["y1"], "height": r["y2"] - r["y1"], "left": r["x1"], "width": r["x2"] - r["x1"], "anchor": r["ord"] % 3 > 0} for r in rows]
        a = {p["id"]: p for p in pagewise.flow(items, [{"column": 0, "top": 200, "bottom": 260}], 792, 4)}
        b = {p["id"]: p["top"] for p in pagewise.push_down(items, 4)}
        c = pagewise.sweep([(str(r["ord"]), pagewise.Box(r["x1"], r["y1"], r["x2"], r["y2"])) for r in rows], [], 4)
        for i in items:
            yield {"id": i["id"], "flow": float(a[i["id"]]["top"]), "overflow": a[i["id"]]["overflow"], "pushed": float(b[i["id"]]), "swept": float(c[i["id"]])}

    return pagewise.run(_pages(spark, d).select("doc_id", "page", "ord", "x1", "y1", "x2", "y2", "column"), run, "doc_id long, page int, id string, flow double, overflow boolean, pushed double, swept double")


def masked(spark, d):
    """Masked text, risk, and whether restoring gives the text back."""
    s = snippets.table(spark, d).withColumn("m", masking.protect_udf(F.col("text")))
    s = s.withColumn("n", F.size("m.placeholders")).withColumn("prose", F.col("m.prose"))
    score = T.risk_score(F.col("m.text"), F.col("prose"), F.col("n"))
    return s.select("doc_id", "pos", F.col("m.text").alias("masked"), "n", score.alias("risk"), T.formula_dense(score, F.col("n")).alias("dense"), masking.intact(F.col("m.text"), F.col("m.placeholders")).alias("intact"), (masking.restore_udf(F.col("m.text"), F.col("m.placeholders")) == F.col("text")).alias("same"))


def sentences(spark, d):
    """Sentences of each snippet, its parts in two boxes, and its lines when wrapped and when shrunk to fit."""
    from pyspark.sql.types import ArrayType, StringType

    @F.pandas_udf(ArrayType(ArrayType(StringType())))
    def measured(text):
        import pandas as pd

        return pd.Series([[pagewise.sentences(t), pagewise.distribute(t, [2.0, 1.0]), pagewise.wrap(t, 40, len), pagewise.fit(t, 300, 60, 10, 6, lambda s, f: len(s) * f / 2)[1]] for t in text])

    return snippets.table(spark, d).withColumn("m", measured("text")).select("doc_id", "pos", *[F.col("m")[i].alias(n) for i, n in enumerate(("sentences", "parts", "lines", "fitted"))])


def translated(spark, d):
    """The repair ladder over conversations with the stand-in service."""
    c = _read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    out = exchange.ladder(c).join(c.withColumnRenamed("text", "source"), "id")
    return out.select("id", "round", "text", similarity.looks_translated(F.col("source"), F.col("text"), F.lit("zh-CN")).alias("accepted"))


def answers(spark, d):
    """Noisy answers of a service, parsed."""
    c = _read(spark, d, "conversations")
    k = F.pmod("turn", F.lit(4))
    good = F.to_json(F.struct(F.array(F.struct(F.lit("b1").alias("id"), F.col("text").alias("translatedText"))).alias("translations")))
    raw = F.when(k == 0, good).when(k == 1, F.concat(F.lit("Here you are:\n```json\n"), good, F.lit("\n```"))).when(k == 2, F.concat(F.lit("well {"), F.col("text"))).otherwise(F.concat(F.lit("noise "), good, F.lit(" more")))
    return c.withColumn("e", exchange.entries_udf(raw)).select("conv_id", "turn", F.size("e").alias("found"), F.col("e")[0]["text"].alias("text"))


_ANSWERS = "SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN NULL ELSE 1 END::INT AS found, CASE WHEN turn % 4 = 2 THEN NULL ELSE text END AS text FROM conversations"

_QUERIES = {
    "v03_validate_answers": (validated, _VALIDATED),
    "v01_parse_answers": (answers, _ANSWERS),
    "u02_replace_members": (replaced, _REPLACED),
    "j06_requested_subset": (requested, "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    "j14_glossary_matches": (glossary_matches, _MATCHES),
    "j15_merge_layers": (merged_layers, _MERGED),
    "j17_provider_pool": (providers, "SELECT page_id, CASE WHEN page_id - 3 < 0 THEN 'alpha' ELSE (['alpha', 'beta', 'gamma'])[(page_id - 3) % 3 + 1] END AS provider FROM pages"),
    "j18_previous_context": (previous_context, f"SELECT conv_id, turn, right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), {X.CONTEXT_CHARS}) AS context FROM conversations"),
    "s04_source_fallback": (source_fallback, _FALLBACK),
    "s05_has_text": (has_text, _HAS_TEXT),
    "s06_text_blocks": (plain_blocks, _PLAIN),
    "s08_page_cache": (page_cache, "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 AND doc_id % 6 NOT IN (1, 2) THEN lang END AS cached FROM documents"),
    "s11_segment_store": (segments, _SEGMENTS),
    "s12_invalidate": (invalidated, "SELECT source AS attachment, count(*) AS entries FROM documents WHERE source <> 'src3' GROUP BY ALL"),
    "s13_stale_sweep": (swept, "SELECT CASE WHEN doc_id % 6 = 2 THEN 4 ELSE 5 END::INT AS schema_version, count(*) AS entries, sum(length(source) + CASE WHEN doc_id % 6 = 3 THEN 9 ELSE 5 END)::BIGINT AS bytes FROM documents WHERE doc_id % 6 = 2 OR (doc_id % 6 = 3 AND doc_id * 10 < 4700) GROUP BY ALL"),
    "s22_notes": (notes, _NOTES),
    "s23_diagnostics": (diagnosed, _DIAGNOSED),
    "s24_glossary_lines": (glossary_parsed, _GLOSSARY),
    "l03_page_top_n": (top_residues, f"{pages.sql()}\nSELECT doc_id, page, ord, row_number() OVER (PARTITION BY doc_id, page ORDER BY length(text) DESC, ord)::INT AS r FROM b QUALIFY r <= 8"),
    "x18_term_memory": (term_pairs, _TERMS),
    "r13_complete_pages": (complete, f"{pages.sql()}\nSELECT doc_id, page, count(*) AS blocks FROM b GROUP BY ALL HAVING count(*) FILTER (k % 17 = 0) = 0"),
    "r16_shorter_only": (shorter, "WITH c AS (SELECT conv_id || '-' || turn AS id, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)\nSELECT id, CASE WHEN length(n) < length(text) THEN n ELSE text END AS text FROM c"),
    "r10_circuit_breaker": (broken, "WITH c AS (SELECT conv_id AS page, turn AS attempt, length(text)::INT AS expected, (length(text) * 7 % 100)::INT AS missing FROM conversations)\nSELECT page, attempt, expected, missing FROM c WHERE missing > 0.25 * expected QUALIFY row_number() OVER (PARTITION BY page ORDER BY attempt) = 1"),
    "p10_lane_policy": (policies, _POLICIES),
    "r03_adaptive_caps": (caps, _CAPS),
    "r05_cooldown": (cooled, _COOLED),
    "r06_idle_sessions": (sessions, _SESSIONS),
    "r01_latest_wins": (latest, "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "r08_failure_memory": (failures, _FAILURES),
    "w01_line_islands": (islands, _ISLANDS),
    "w02_rows_and_lines": (rows_and_lines, None),
    "w10_modules": (modules, None),
    "w15_regions": (regions, None),
    "w19_tables": (tables, None),
    "w24_flow": (flowed, None),
    "w27_columns": (column_bands, None),
    "x01_masking": (masked, None),
    "x12_sentences": (sentences, None),
    "r11_repair_ladder": (translated, None),
}


def queries() -> dict:
    return {n: q for n, (q, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _QUERIES.items() if s}


__all__ = ["R", "oracle_sql", "queries"]

"""Small policies: configuration, prompts, language codes, retries, error texts. Dimension tables are inlined; everything is a column or a join."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import regex as R
from ..functions import text as T

#: Codes that a service spells in its own way.
LANGUAGE_CODES = {
    "auto-detecting": {"auto": "auto-detect", "zh": "zh-Hans", "zh-CN": "zh-Hans", "zh-TW": "zh-Hant", "tl": "fil", "no": "nb"},
    "plain": {"zh": "zh-CN"},
    "upper": {"zh": "ZH", "zh-CN": "ZH-HANS", "zh-TW": "ZH-HANT", "en": "EN", "auto": ""},
}


def language_code(code: Column, scheme: str) -> Column:
    """X22."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGE_CODES[scheme].items() for x in kv])
    return F.coalesce(F.element_at(known, code), F.upper(code) if scheme == "upper" else code)


def versioned_base(url: Column, default: str, plain: bool = False) -> Column:
    """A base address with a version at its end, unless it has one or ends in the completion path."""
    b = R.replace(F.when(F.coalesce(url, F.lit("")) == "", default).otherwise(url), "/+$", "")
    return b if plain else F.when(R.like(b, r"/v\d+[a-z]*$") | b.contains("/chat/completions"), b).otherwise(F.concat(b, F.lit("/v1")))


def messages_url(url: Column) -> Column:
    """X26."""
    b = R.replace(url, "/+$", "")
    return F.when(R.like(b, "/v1/messages$"), b).otherwise(F.concat(R.replace(b, "/v1$", ""), F.lit("/v1/messages")))


def prompt(system: Column, blocks: Column, glossary: Column, context: Column, budget: Column) -> Column:
    """The request as JSON: blocks in order, glossary and context only where there are any."""
    none = lambda c, test: F.when(test, c)
    return F.to_json(F.struct(system.alias("system"), blocks.alias("blocks"), none(glossary, F.size(glossary) > 0).alias("glossary"), none(context, context != "").alias("previousContext"), budget.alias("charBudget")))


def cleaned_annotations(text: Column) -> Column:
    """Of an annotated answer only the sentences in <b>, tags gone, entities decoded."""
    bare = F.when(text.contains("<pre"), R.replace(F.replace(text, F.lit("</pre>"), F.lit("")), "^[^>]*>", "")).otherwise(text)
    sentences = R.find_all(bare, r"(?s)<b>(.*?)(?:<i>|$)", 1)
    joined = F.when(F.size(sentences) > 0, F.array_join(sentences, " ")).otherwise(bare)
    return R.trim(R.replace(T.unescape_html(R.replace(joined, r"</?[bi]>|</?(?:pre|a)[^>]*>", "")), r"\s+", " "))


def explanation_sections(raw: str, labels: tuple[str, ...]) -> list[tuple[str, str]]:
    """Labelled sections of an explanation if there are two or more, else one without a label."""
    head = re.compile(r"\s*(?:\d+[.)、]?\s*)?(?:\*\*)?(" + "|".join(map(re.escape, labels)) + r")(?:\*\*)?\s*[—\-–:：]?\s*", re.I)
    text, found = raw.strip(), []
    for line in text.splitlines():
        if m := head.match(line):
            found.append((m[1], line[m.end() :]))
        elif found:
            found[-1] = (found[-1][0], found[-1][1] + "\n" + line)
        elif line.strip():
            found.append(("", line))
    found = [(label, body.strip()) for label, body in found if label and body.strip()]
    return found if len(found) >= 2 else [("", text)] if text else []


def effective_config(requests: DataFrame, profiles: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Each request's provider settings: its profile's where it has them, else the defaults."""
    out = requests.join(F.broadcast(profiles), "provider", "left")
    return out.withColumns({c: F.coalesce(F.when(F.trim(F.col(c)) != "", F.col(c)), F.lit(v)) for c, v in defaults.items()})


def profiles(rows: DataFrame, col: str = "json") -> DataFrame:
    """Stored profiles, permissively parsed; the old single-provider form becomes one profile, broken JSON none."""
    kind = "struct<profiles: array<struct<provider: string, model: string, baseUrl: string>>, provider: string, model: string, baseUrl: string>"
    p = F.from_json(col, kind)
    every = F.coalesce(p["profiles"], F.when(p["provider"].isNotNull(), F.array(F.struct(p["provider"].alias("provider"), p["model"].alias("model"), p["baseUrl"].alias("baseUrl")))))
    return rows.select(*[c for c in rows.columns if c != col], F.explode(every).alias("p")).select(*[c for c in rows.columns if c != col], "p.*").filter("provider is not null")


def catalogue(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Requests with their model's row; one without a known model gets its provider's recommended one."""
    best = models.filter("recommended").groupBy("provider").agg(F.min("model").alias("_best"))
    known = models.select("provider", "model", F.lit(True).alias("_known"))
    out = requests.join(F.broadcast(known), ["provider", "model"], "left").join(F.broadcast(best), "provider", "left")
    return out.withColumn("model", F.when(F.col("_known"), F.col("model")).otherwise(F.coalesce("_best", "model"))).drop("_known", "_best")


def drop_rejected(params: DataFrame, rejections: DataFrame) -> DataFrame:
    """Request parameters without those that the provider and model have rejected before."""
    return params.join(rejections.select("provider", "model", "param").distinct(), ["provider", "model", "param"], "left_anti")


def rejected_parameter(body: Column) -> Column:
    """The parameter that an error text names, or null."""
    name = F.regexp_extract(body, r"(?i)(?:parameter|argument|value)[^'\"`:]{0,40}[:'\"`]\s*['\"`]?([a-z_]+)", 1)
    return F.when(name != "", name)


def retry_split(unfit: DataFrame, most: int) -> DataFrame:
    """Blocks that don't fit are compressed while the service can and rounds are left, else shrunk."""
    return unfit.withColumn("action", F.when(F.col("budget_capable") & (F.col("rounds") < most), "compress").otherwise("shrink"))


def ink_obstacles(blocks: DataFrame) -> DataFrame:
    """References and tables that have lines."""
    return blocks.filter((F.coalesce("is_reference", F.lit(False)) | (F.col("type") == "table")) & (F.size("line_rects") > 0))


def spanning_expanded(blocks: DataFrame, columns: int) -> DataFrame:
    """A full-width block stands in every column."""
    if columns <= 1:
        return blocks.withColumn("column", F.lit(0))
    return blocks.withColumn("column", F.explode(F.when(F.col("column") == -1, F.sequence(F.lit(0), F.lit(columns - 1))).otherwise(F.array("column"))))


def spanning_collapsed(placed: DataFrame) -> DataFrame:
    """Of its copies the lowest counts."""
    return placed.groupBy("doc_id", "page", "id").agg(F.max("top").alias("top"))


def required_height(placed: DataFrame, page_height: float) -> DataFrame:
    """P06."""
    return placed.groupBy("doc_id", "page").agg(F.greatest(F.lit(page_height), F.max(F.col("top") + F.col("height"))).alias("height"))


def obstacle_boxes(obstacles: DataFrame, bands: DataFrame) -> DataFrame:
    """An obstacle's own ink extent, else its column's band; neither: dropped."""
    out = obstacles.join(bands.select("doc_id", "page", "column", F.col("left").alias("_l"), F.col("right").alias("_r")), ["doc_id", "page", "column"], "left")
    return out.withColumn("left", F.coalesce("left", "_l")).withColumn("right", F.coalesce("right", "_r")).drop("_l", "_r").filter("left is not null and right is not null")


def nearest_below(captions: DataFrame, blocks: DataFrame) -> DataFrame:
    """J13 (y down): the topmost block below each caption that overlaps it sideways: (doc_id, page, caption, ord)."""
    c = captions.select("doc_id", "page", F.col("ord").alias("caption"), F.col("x1").alias("cx1"), F.col("x2").alias("cx2"), F.col("y2").alias("cy2"))
    near = c.join(blocks, ["doc_id", "page"]).filter((F.col("y1") >= F.col("cy2")) & (F.least("x2", "cx2") > F.greatest("x1", "cx1")))
    return near.groupBy("doc_id", "page", "caption").agg(F.min_by("ord", F.struct("y1", "ord")).alias("ord"))


def bands(values: Column, tolerance: float) -> Column:
    """First members of the bands of an array of centres: in order, a value opens a band if it lies more than ``tolerance`` above the last one's first member.

    The array is that of a page or a table."""
    start = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(values), start, lambda a, v: F.when((F.size(a) == 0) | (v > F.element_at(a, -1) + tolerance), F.concat(a, F.array(v))).otherwise(a))


def shared_rows(cells: DataFrame, tolerance: float, least: int = 3) -> DataFrame:
    """Cluster pairs a < b of a page, with the number of a's row bands that have a band of b within ``tolerance``, if there are ``least`` or more."""
    rows = cells.groupBy("doc_id", "page", "cluster").agg(F.collect_list((F.col("y1") + F.col("y2")) / 2).alias("y")).withColumn("y", bands(F.col("y"), tolerance))
    a, b = (rows.select("doc_id", "page", F.col("cluster").alias(n), F.col("y").alias(f"_{n}")) for n in "ab")
    shared = F.size(F.filter("_a", lambda y: F.exists("_b", lambda z: F.abs(z - y) <= tolerance)))
    return a.join(b, ["doc_id", "page"]).filter("a < b").withColumn("rows", shared).filter(F.col("rows") >= least).select("doc_id", "page", "a", "b", "rows")


def numeric_columns(cells: DataFrame) -> DataFrame:
    """A column of a table with three body cells or more, 70 % of them data, becomes data; the header row keeps its kind."""
    w = Window.partitionBy("doc_id", "page", "table", "col")
    body = F.col("row") > 0
    share = F.avg(F.when(body, (F.col("kind") == "data").cast("int"))).over(w)
    return cells.withColumn("kind", F.when(body & (F.count_if(body).over(w) >= 3) & (share >= 0.7), "data").otherwise(F.col("kind")))


def placement_tally(blocks: DataFrame) -> DataFrame:
    """Placed and kept blocks of a page, and its phase."""
    by = blocks.groupBy("doc_id", "page").agg(F.count_if(F.col("status") == "placed").alias("placed"), F.count_if(F.col("status").isin("abandoned", "untranslated", "table-failed")).alias("kept"))
    return by.withColumn("phase", F.when(F.col("kept") == 0, "complete").when(F.col("placed") == 0, "original").otherwise("partial"))


def request_budget(requests: DataFrame, chunks: Column, rescue: Column) -> DataFrame:
    """The first 2 n + 2 requests of a page with n chunks, four more if blocks are to be rescued."""
    n = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("seq"))
    return requests.withColumn("_n", n).filter(F.col("_n") <= 2 * chunks + 2 + F.when(rescue, 4).otherwise(0)).drop("_n")


def most_urgent(tasks: DataFrame) -> DataFrame:
    """A session's task to show: running before failed before waiting before done, the newest of equals."""
    rank = F.when(F.col("state") == "running", 4).when(F.col("state") == "failed", 3).when(F.col("state") == "waiting", 2).otherwise(1)
    return tasks.groupBy("session").agg(F.max_by("task", F.struct(rank, "seq")).alias("task"))


def refresh(blocks: DataFrame, page_cache: DataFrame, segment_cache: DataFrame, level: str = "none") -> DataFrame:
    """Cached texts of blocks: a normal refresh skips the page cache, a forced one both."""
    out = blocks
    if level == "none":
        out = out.join(page_cache.select("id", F.col("text").alias("_p")), "id", "left")
    if level != "force":
        out = out.join(segment_cache.select("hash", F.col("text").alias("_s")), "hash", "left")
    none = F.lit(None).cast("string")
    return out.withColumn("cached", F.coalesce(F.col("_p") if "_p" in out.columns else none, F.col("_s") if "_s" in out.columns else none)).drop("_p", "_s")


def refreshed_failures(failures: DataFrame, page_hashes: DataFrame, level: str = "none") -> DataFrame:
    """What the failure memory keeps: a normal refresh forgets the hashes of this page's blocks only, a forced one all."""
    if level == "force":
        return failures.limit(0)
    return failures if level == "none" else failures.join(page_hashes.select("hash").distinct(), "hash", "left_anti")


def finished(extractions: DataFrame, slots: int = 2, timeout: float = 20.0) -> DataFrame:
    """Extractions (lane, seq, asked, seconds) through ``slots`` per lane in order of asking: when each starts and ends, and whether its result is still taken.

    A slot stays busy until its work ends, also past the time limit; a result after the limit is late and dropped."""
    rows = extractions.groupBy("lane").agg(F.array_sort(F.collect_list(F.struct(F.col("asked").cast("double").alias("asked"), "seq", F.col("seconds").cast("double").alias("seconds")))).alias("e"))
    kind = "array<struct<seq: bigint, start: double, end: double, late: boolean>>"
    begin = F.struct(F.array_repeat(F.lit(0.0), slots).alias("free"), F.array().cast(kind).alias("out"))

    def step(a: Column, e: Column) -> Column:
        start = F.greatest(e["asked"], F.array_min(a["free"]))
        end = start + e["seconds"]
        busy = F.array_sort(F.concat(F.slice(F.array_sort(a["free"]), 2, slots), F.array(end)))
        mine = F.struct(e["seq"].cast("long").alias("seq"), start.alias("start"), end.alias("end"), (e["seconds"] > timeout).alias("late"))
        return F.struct(busy.alias("free"), F.concat(a["out"], F.array(mine)).alias("out"))

    return rows.select("lane", F.explode(F.aggregate("e", begin, step, lambda a: a["out"])).alias("x")).select("lane", "x.*")


def accept_repair(old: DataFrame, new: DataFrame, valid: Column, gone: Column) -> DataFrame:
    """A redone block replaces the old one only if it is valid and what was wrong is gone."""
    out = old.join(new.select("id", F.col("text").alias("new")), "id", "left")
    return out.withColumn("text", F.when(F.col("new").isNotNull() & valid & gone, F.col("new")).otherwise(F.col("text"))).drop("new")

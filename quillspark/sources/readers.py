"""Sources and sinks: glyph and span pages, plain text, the fallback between them, glossaries, diagnostics and notes."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import regex as R
from ..functions import text as T

RECT = "struct<x1: double, y1: double, x2: double, y2: double>"
CHARS = f"doc_id string, page int, pos int, c string, rect {RECT}, font_name string, font_size double, ignorable boolean, space_after boolean, line_break_after boolean, paragraph_break_after boolean"
SPANS = f"doc_id string, page int, page_width double, page_height double, pos int, text string, rect {RECT}, font_size double"
SPAN_FILE = "source string, page int, pageWidth double, pageHeight double, items array<struct<text: string, rect: array<double>, fontSize: double>>"


class PageParser(Protocol):
    """Turns the bytes of a document into rows of :data:`SPANS` or :data:`CHARS`."""

    def __call__(self, content: bytes) -> list[dict]: ...


def chars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Glyphs, with a fixed schema; ignorable ones are dropped."""
    return glyphs(spark.read.schema(CHARS).format(fmt).load(path))


def glyphs(rows: DataFrame) -> DataFrame:
    """Of rows of :data:`CHARS` those that count."""
    return rows.filter(~F.coalesce("ignorable", F.lit(False)))


def page_text(rows: DataFrame) -> DataFrame:
    """(doc_id, page, text) of glyphs, with spaces and line ends where their flags say so; lines are joined as everywhere. A page is an array."""
    each = F.array_sort(F.collect_list(F.struct("pos", F.concat("c", F.when(F.coalesce("line_break_after", F.lit(False)), "\n").when(F.coalesce("space_after", F.lit(False)), " ").otherwise("")).alias("c"))))
    return rows.groupBy("doc_id", "page").agg(each.alias("g")).select("doc_id", "page", T.join_lines(F.split(F.array_join(F.transform("g", lambda g: g["c"]), ""), "\n", -1)).alias("text"))


def whole_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text): the pages of a document in a row, with nothing between them."""
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: F.coalesce(p["text"], F.lit(""))), "").alias("text"))


def spans(spark: SparkSession, path: str) -> DataFrame:
    """Span files (one JSON object a page)."""
    return span_rows(spark.read.schema(SPAN_FILE).json(path, multiLine=True))


def span_rows(files: DataFrame) -> DataFrame:
    """Rows of :data:`SPANS` from parsed span files; the declared size wins over the box's height."""
    rows = files.select(F.col("source").alias("doc_id"), "page", F.col("pageWidth").alias("page_width"), F.col("pageHeight").alias("page_height"), F.posexplode("items").alias("pos", "i"))
    r = F.col("i.rect")
    rect = F.struct(r[0].alias("x1"), r[1].alias("y1"), r[2].alias("x2"), r[3].alias("y2"))
    return rows.select("doc_id", "page", "page_width", "page_height", "pos", F.col("i.text").alias("text"), rect.alias("rect"), F.coalesce("i.fontSize", r[3] - r[1]).alias("font_size"))


def documents_of(spark: SparkSession, path: str, parser: PageParser, schema: str = SPANS) -> DataFrame:
    """Files through a page parser, one row a span; a failing file gives no rows but its path and error in ``_corrupt``."""

    def parse(batches):
        import pandas as pd

        for b in batches:
            out = []
            for p, content in zip(b["path"], b["content"]):
                try:
                    out += [row | {"doc_id": p} for row in parser(content)]
                except Exception as e:  # bad bytes of one file
                    out.append({"doc_id": p, "_corrupt": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame([[row.get(n) for n in names] for row in out], columns=names, dtype=object)

    names = [f.split()[0] for f in (schema + ", _corrupt string").replace(RECT, "struct").split(", ")]
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, schema + ", _corrupt string")


def undecoded(chars_: DataFrame, share: float = 0.6) -> DataFrame:
    """Pages on which over 60 % of the glyphs have no character."""
    return chars_.groupBy("doc_id", "page").agg(F.avg(F.col("c").startswith("(cid:").cast("int")).alias("bad")).filter(F.col("bad") > share).select("doc_id", "page")


def first_source(*sources: DataFrame) -> DataFrame:
    """Of each page the rows of the first source that has it; sources share a schema with (doc_id, page)."""
    tagged = [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    return every.withColumn("_best", F.min("_rank").over(Window.partitionBy("doc_id", "page"))).filter("_rank = _best").drop("_best")


def has_text(pages: DataFrame) -> DataFrame:
    """Documents with a first, middle or last page of over ten characters."""
    w = Window.partitionBy("doc_id")
    n = pages.withColumn("_last", F.max("page").over(w))
    sampled = n.filter(F.col("page").isin(0) | (F.col("page") == F.floor(F.col("_last") / 2)) | (F.col("page") == F.col("_last")))
    return sampled.groupBy("doc_id").agg((F.max(F.length(R.trim(F.col("text")))) > 10).alias("has_text"))


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", references: bool = False) -> DataFrame:
    """Plain text into blocks: at blank lines, then before lines that begin like a new block; what follows a references heading goes."""
    parts = F.flatten(F.transform(R.split(F.col(text_col), r"\n\s*\n"), lambda p: F.split(p, r"\n(?=[A-Z0-9一-鿿•▪◦‣·*–—-])", -1)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("ord", "text")).withColumn("text", R.trim(F.col("text"))).filter(F.length("text") >= 2)
    if not references:
        w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_seen", F.max(R.like(F.col("text"), X.REFERENCES, True).cast("int")).over(w)).filter("coalesce(_seen, 0) = 0").drop("_seen")
    return rows


def glossary_lines(lines: DataFrame, col: str = "line") -> DataFrame:
    """S24: "source → target", "source -> target" or tab-separated lines; "?" at the end suggests, # comments."""
    t = R.trim(F.col(col))
    p = R.java(r"^(.+?)(?:\s*(?:→|->)\s*|\t+)(.+?)(\s*\?)?$")
    out = lines.withColumn("source", R.trim(F.regexp_extract(t, p, 1))).withColumn("target", R.trim(F.regexp_extract(t, p, 2)))
    out = out.withColumn("mode", F.when(R.trim(F.regexp_extract(t, p, 3)) != "", "suggested").otherwise("required"))
    return out.filter((t != "") & ~t.startswith("#") & (F.col("target") != ""))


def glossary_json(rows: DataFrame, col: str = "json") -> DataFrame:
    """A JSON list of rules; entries without source or target don't count."""
    rule = F.explode(F.from_json(col, "array<struct<source: string, target: string, mode: string>>")).alias("r")
    out = rows.select(*[c for c in rows.columns if c != col], rule)
    out = out.select("*", R.trim(F.col("r.source")).alias("source"), R.trim(F.col("r.target")).alias("target"), F.when(F.col("r.mode") == "suggested", "suggested").otherwise("required").alias("mode")).drop("r")
    return out.filter((F.col("source") != "") & F.col("target").isNotNull())


def glossary_out(rules: DataFrame) -> Column:
    """A rule as a line."""
    return F.concat(F.col("source"), F.lit(" → "), F.col("target"), F.when(F.col("mode") == "suggested", " ?").otherwise(""))


def matching_rules(rules: DataFrame, texts: DataFrame, most: int = 20_000) -> DataFrame:
    """Rules that occur in a text, whatever the case: (id, source).

    Rules are broadcast as one automaton that finds all of them in a pass over a text; more than about ``most`` rules are dealt by hash into slices with an
    automaton each."""
    rules = rules.filter(F.coalesce("source", F.lit("")) != "").select("source").distinct()
    slices = max(1, -(-rules.count() // most))
    rows = texts.select("id", F.coalesce("text", F.lit("")).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, source string"
    out = None
    for k in range(slices):
        part = rules.filter(F.pmod(F.xxhash64("source"), F.lit(slices)) == k)
        found = rows.mapInArrow(_finder(sorted(r["source"] for r in part.collect())), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _finder(sources: list[str]):
    def run(batches):
        import ahocorasick
        import pyarrow as pa

        by: dict[str, list[str]] = {}
        for s in sources:
            by.setdefault(s.lower(), []).append(s)
        machine = ahocorasick.Automaton()
        for low in by:
            machine.add_word(low, low)
        machine.make_automaton()
        for b in batches:
            at, hits = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                there = {low for _, low in machine.iter(text.lower())} if by else ()
                for low in there:
                    at += [i] * len(by[low])
                    hits += by[low]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(hits, pa.string())], ["id", "source"])

    return run


def diagnostics(blocks: DataFrame) -> DataFrame:
    """A page's counts by status, as JSON without any text."""
    by = blocks.groupBy("doc_id", "page").agg(F.count("*").alias("blocks"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "missing").alias("missing"), F.sum(F.length("text")).alias("chars"))
    return by.select("doc_id", "page", F.to_json(F.struct("blocks", "ok", "missing", "chars")).alias("report"))


def note(title: Column, body: Column) -> Column:
    """An escaped HTML note; line feeds become paragraphs."""
    paragraphs = F.array_join(F.transform(F.filter(F.split(body, "\n", -1), lambda p: F.trim(p) != ""), lambda p: F.concat(F.lit("<p>"), T.escape_html(p), F.lit("</p>"))), "")
    return F.concat(F.lit("<h1>"), T.escape_html(title), F.lit("</h1>"), paragraphs)


def exportable(blocks: DataFrame) -> DataFrame:
    """What a typeset copy replaces."""
    return blocks.filter(F.col("type").isin("paragraph", "caption", "list") & ~F.col("is_reference") & T.metadata_reason(F.col("text")).isNull() & (F.col("x2") - F.col("x1") >= 36) & (F.col("y2") - F.col("y1") >= 7) & (F.length(R.trim(F.col("text"))) >= 6))

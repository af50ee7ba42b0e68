"""The whole way from blocks to stored answers, as one object with a small API.

Dependencies are arguments: the service, the caches' folder, the glossary and the policy can all be given. Every step is a DataFrame of another, so
Spark plans the whole; tables are written only where a cache is kept."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import hashing, similarity
from ..functions import text as T
from ..operators import chunks, exchange, layout, masking
from ..sources import readers


@dataclass
class Engine:
    source: str = "auto"
    target: str = "zh-CN"
    service: exchange.Service = field(default_factory=lambda: exchange.SERVICES["stand-in"])
    glossary: DataFrame | None = None

    def blocks(self, rows: DataFrame, page_height: float = 792.0) -> DataFrame:
        """Typed, filtered and ordered blocks of (doc_id, page, ord, text, x1 .. y2, column, font, lines, font_name), y down.

        Filters come before the order, as what they drop would change columns and bands."""
        up = G.flip(F.struct("x1", "y1", "x2", "y2"), F.lit(page_height))
        kept = rows.filter(T.metadata_reason(F.col("text"), G.vertical_sliver(up)).isNull() & ~G.running_head_or_foot(up, F.lit(page_height), F.col("lines"), F.col("text")))
        body = layout.page_sizes(kept).select("doc_id", "page", "body")
        typed = kept.join(body, ["doc_id", "page"], "left").withColumn("type", G.classify(F.col("text"), F.col("lines"), F.col("font"), F.coalesce("body", F.lit(10.0)), T.bold_font(F.col("font_name"))))
        ordered = layout.reading_order(layout.reference_cut(typed).drop("body"))
        return ordered.withColumn("id", F.concat_ws("-", F.lit("page"), "doc_id", "page", F.lit("block"), "ord"))

    def plain(self, docs: DataFrame) -> DataFrame:
        """Blocks of documents that have only text."""
        return readers.text_blocks(docs).withColumn("id", F.concat_ws("-", "doc_id", "ord"))

    def answers(self, blocks: DataFrame, store: DataFrame | None = None) -> DataFrame:
        """(id, text, hash, answer, accepted): stored answers first, the repair ladder for the rest, all validated."""
        rows = blocks.select("id", "text", hashing.segment(F.col("text"), F.lit(self.source), F.lit(self.target)).alias("hash"))
        masked = rows.withColumn("m", masking.protect_udf(F.col("text")))
        left = masked
        if store is not None:
            left = masked.join(store.select("hash"), "hash", "left_anti")
        asked = exchange.ladder(left.select("id", F.col("m.text").alias("text")), self.service.translate)
        out = masked.join(asked.select("id", F.col("text").alias("got")), "id", "left")
        out = out.withColumn("answer", masking.restore_udf(F.col("got"), F.col("m.placeholders")))
        if store is not None:
            out = out.join(store.select("hash", F.col("text").alias("stored")), "hash", "left").withColumn("answer", F.coalesce("stored", "answer"))
        return out.select("id", "text", "hash", "answer", similarity.looks_translated(F.col("text"), F.coalesce("answer", F.lit("")), F.lit(self.target)).alias("accepted"))

    def store(self, answers: DataFrame, store: DataFrame | None = None) -> DataFrame:
        """Accepted answers merged into the segment store."""
        new = answers.filter("accepted").select("hash", F.col("answer").alias("text")).dropDuplicates(["hash"])
        return new if store is None else exchange.segment_merge(store, new)

    def plan(self, blocks: DataFrame) -> DataFrame:
        """Lanes and chunks of blocks with module, heading, is_heading and the risk predicate as a column."""
        return chunks.plan(blocks)

    def report(self, blocks: DataFrame, answers: DataFrame) -> DataFrame:
        """Counts by page."""
        rows = blocks.join(answers.select("id", "accepted"), "id", "left")
        return readers.diagnostics(rows.withColumn("status", F.when(F.col("accepted"), "ok").otherwise("missing")))

"""Synthetic page geometry over the documents' lines: a deterministic layout that Spark and DuckDB compute alike.

Every document's lines become blocks (doc_id, page, ord, text, x1, y1, x2, y2, column, font, type ...), twelve a page, y down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import snippets

PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snippets.table(spark, sf_dir)
    k = F.col("doc_id") * 31 + F.col("pos") * 17
    column = (F.pmod(k, F.lit(5)) % 3 - 1).cast("int")
    out = s.select("doc_id", F.floor(F.col("pos") / 12).cast("int").alias("page"), F.pmod("pos", F.lit(12)).cast("int").alias("ord"), "text", column.alias("column"), k.alias("k"))
    x1 = F.when(F.col("column") == -1, 50).otherwise(50 + F.col("column") * 260) + F.pmod("k", F.lit(7))
    y1 = F.pmod(F.col("k") * 37, F.lit(700)) + 20
    out = out.withColumn("x1", x1.cast("double")).withColumn("y1", y1.cast("double"))
    out = out.withColumn("x2", F.col("x1") + F.when(F.col("column") == -1, 500.0).otherwise(240.0)).withColumn("y2", F.col("y1") + 8 + F.pmod("k", F.lit(41)))
    out = out.withColumn("font", 8 + F.pmod("k", F.lit(13)) / 2).withColumn("type", F.when(F.pmod("k", F.lit(11)) == 0, "heading").otherwise("paragraph"))
    return out.withColumn("lines", (F.pmod("k", F.lit(4)) + 1).cast("int")).withColumn("font_name", F.element_at(F.array(*[F.lit(x) for x in FONTS]), (F.pmod("k", F.lit(len(FONTS))) + 1).cast("int")))


FONTS = ["Body-Regular", "Body-Bold", "CMBX10", "Thin-Light", "Serif-Medium-Bold", "Sans,bd", ""]


def sql() -> str:
    """The same as a common table expression named ``b``."""
    fonts = ", ".join(f"'{x}'" for x in FONTS)
    return f"""{snippets.sql()},
b0 AS (SELECT doc_id, (pos // 12)::INT AS page, (pos % 12)::INT AS ord, text, doc_id * 31 + pos * 17 AS k, (((doc_id * 31 + pos * 17) % 5) % 3 - 1)::INT AS "column" FROM s),
b1 AS (SELECT *, (CASE WHEN "column" = -1 THEN 50 ELSE 50 + "column" * 260 END + k % 7)::DOUBLE AS x1, ((k * 37) % 700 + 20)::DOUBLE AS y1 FROM b0),
b AS (SELECT *, x1 + CASE WHEN "column" = -1 THEN 500.0 ELSE 240.0 END::DOUBLE AS x2, y1 + 8 + k % 41 AS y2, 8 + (k % 13)::DOUBLE / 2 AS font,
  CASE WHEN k % 11 = 0 THEN 'heading' ELSE 'paragraph' END AS type, (k % 4 + 1)::INT AS lines, ([{fonts}])[k % {len(FONTS)} + 1] AS font_name FROM b1)"""

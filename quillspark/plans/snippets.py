"""Lines of the documents mixed with constant samples, so that text rules have something to find in invented prose.

The same table is built for Spark and, as SQL, for DuckDB: (doc_id, pos, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = [
    "Received: 12 March 2020; accepted 3 May 2020",
    "© 2019 Elsewhere Press. All rights reserved.",
    "The effect was small (P<0.05, n = 1,234) [12, 13] and 95% CI 1.2–3.4 held.",
    "Department of Prose, University of Nowhere, Old Town, Nowhere, Hospital of Letters",
    "Anna Example3, Bert Sample MD*, Carla Specimen PhD, Doris Placeholder MSc†",
    "结果显示该方法明显优于对照组 (RCT) 和心力衰竭(HF)组。",
    "1.2 Methods",
    "1. first item of a list",
    "• a bullet point",
    "Figure 6:",
    "Table 2. Means and counts",
    "12.5 ± 3.1 | 45% | <0.001",
    "References",
    "and continued from the line before,",
    "E = mc^2 + (a*b)/{c|d}",
    "Correspondence to: a.person@mail.example.org",
    "doi:10.1000/xyz123 https://doi.example.org/abc",
    "Chapter one ........ 12",
    "Smith J. Doe, Jane Roe and Max Mustermann, Erika Musterfrau; Peter Pan",
    "authorization: Bearer abcdefgh12345678 and api_key=\"zyxwvuts98765432\"",
    "funded by grant no. AB-12 & licence <b>open</b> 'text' \"x\"",
    "he said so.”",
    "12  ",
    "",
]


#: Rows that are a sample alone, after the lines of each document.
ALONE = 3


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, text): all lines, a third as they are, a third behind a sample, a third before one; then samples alone. A null text is an empty line."""
    lines = F.concat(F.split(F.coalesce("text", F.lit("")), "\n", -1), F.array_repeat(F.lit(None).cast("string"), ALONE))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(lines).alias("pos", "line"))
    sample = F.element_at(F.array(*[F.lit(s) for s in SAMPLES]), (F.pmod(F.col("doc_id") + F.col("pos") * 5, F.lit(len(SAMPLES))) + 1).cast("int"))
    kind = F.pmod(F.col("doc_id") + F.col("pos"), F.lit(3))
    text = F.when(F.col("line").isNull(), sample).when(kind == 0, F.col("line")).when(kind == 1, F.concat(sample, F.lit(" "), F.col("line"))).otherwise(F.concat("line", F.lit(" "), sample))
    return docs.select("doc_id", F.col("pos").cast("int").alias("pos"), text.alias("text"))


def sql() -> str:
    """The same as a common table expression named ``s``."""
    quoted = ", ".join("'" + s.replace("'", "''") + "'" for s in SAMPLES)
    sample, lines = f"([{quoted}])[(doc_id + pos * 5) % {len(SAMPLES)} + 1]", f"list_concat(string_split(coalesce(text, ''), chr(10)), [{', '.join(['NULL'] * ALONE)}])"
    return f"""
WITH lines AS (SELECT doc_id, unnest({lines}) AS line, unnest(range(len({lines}))) AS pos FROM documents),
s AS (SELECT doc_id, pos::INTEGER AS pos, CASE WHEN line IS NULL THEN {sample} WHEN (doc_id + pos) % 3 = 0 THEN line WHEN (doc_id + pos) % 3 = 1 THEN {sample} || ' ' || line ELSE line || ' ' || {sample} END AS text FROM lines)"""

"""Mixing sources to target weights by Pareto order sampling.

Sizes are words. Sources in code-point order (null last) weigh 5, 2, 1, repeating; targets share the total of all sizes
by weight, none above ``most`` times its source's size; what a full source can't take is shared again by weight.

Within a source documents have weights: the number of binary digits of their word count, so that the chance grows with the logarithm of the length; or a column of the
user's. A document of weight w is expected lambda = min(``most``, c * w) times, with c such that the expected words of the source are its target. It gets
floor(lambda) certain copies. The fraction p = lambda - floor(lambda) is the inclusion probability of one more copy, unequal between weights: documents are
ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in that order until the words that the certain copies leave open are reached
(fixed size in words; the last document only if that comes nearer). u is a hash of seed and id, so reruns agree.

No source is ranked in one task: the rank is cut into ``BUCKETS`` ranges, none of which holds more than about a 4,096th of a source near the end of its sample; sums per
(source, bucket) combine map-side, and only the one bucket a source where the sample ends is ordered row by row. Sums per (source, weight) are aggregated rows: a user's
weights are rounded to 8 steps an octave. :func:`targets` orders the sources in one task, one aggregated row each.

Defined cases: null text has size 0; a null source is a source of its own; rows with null ids get their random number from the text's hash; a source of
size 0 takes nothing; equal rows have equal keys and are ordered arbitrarily but count alike; rows of equal rank are taken by id and size; texts of any length are counted whole;
an empty table gives an empty result; extra columns of any name are kept by :func:`apply` and don't matter to :func:`plan`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

P = "__mx_"
WEIGHTS, MOST, BUCKETS, SEED = (5, 2, 1), 3, 4096, "mix-1"  # the targets' weights, copies at most


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(common.WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of a table with ``source`` and ``size``: one aggregated row a source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.select("source", "source_size", w.cast("long").alias("w"))
    # Sources fill up in the order of size over weight: the first that doesn't sets the level of all others.
    up = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    before, everything = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    cap = F.col("source_size") * most
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    by = by.select("*", cap.alias("cap"), rest.alias("rest"), left.alias("left"))
    by = by.withColumn("free", F.col("cap") * F.col("left") >= F.col("w") * F.col("rest"))
    level = lambda c: F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.coalesce("source", F.lit("")), F.col(c).alias("v")))).over(everything)["v"]
    by = by.select("*", level("rest").alias("r"), level("left").alias("l"))
    share = F.col("w") * F.col("r") / F.col("l")
    return by.select("source", "source_size", F.when(F.col("r").isNull() | (share > F.col("cap")), F.col("cap").cast("double")).otherwise(share).alias("target"))


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from 52 bits of MD5 of seed and key."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def expected(classes: DataFrame, most: int) -> DataFrame:
    """(_key, wt, target, source_size, whole, p, need) of ``classes`` (_key, wt, s, source_size, target): how often a document of each weight is expected.

    Of the weights from high to low, the first so many reach ``most`` copies that c is right for all others."""
    down = Window.partitionBy("_key").orderBy(F.desc("wt")).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("_key")
    full = F.coalesce(F.sum("s").over(down), F.lit(0))  # words of all higher weights
    left = F.sum(F.col("s") * F.col("wt")).over(all_) - F.coalesce(F.sum(F.col("s") * F.col("wt")).over(down), F.lit(0))
    x = classes.withColumn("c", F.when(left > 0, (F.col("target") - full * most) / left).otherwise(0.0))
    # c is right where the first weight that isn't full stays within the bound; all weights are full if none is.
    x = x.withColumn("c", F.max(F.when((F.col("c") * F.col("wt") <= most), F.struct(F.col("wt").alias("wt"), F.col("c").alias("c")))).over(all_)["c"])
    x = x.withColumn("times", F.when(F.col("source_size") == 0, 0.0).when(F.col("c").isNull(), float(most)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.col("c") * F.col("wt")))))
    x = x.withColumn("whole", F.floor("times")).withColumn("p", F.col("times") - F.col("whole"))
    return x.withColumn("need", F.col("target") - F.sum(F.col("whole") * F.col("s")).over(all_)).select("_key", "wt", "_n", "target", "source_size", "whole", "p", "need")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, weights: tuple = WEIGHTS, most: int = MOST, seed: str = SEED, row_col: str | None = None) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, whole (certain copies), p (of one more), copies, taken, and ``row_col`` if one is named.

    ``weight_col``: relative chance of a document within its source (null, not a number or not above zero: 1)."""
    size = words(F.col(text_col))
    if weight_col:
        w = F.col(weight_col).cast("double")
        octave = F.round(F.log2(F.greatest(F.least(w, F.lit(1e9)), F.lit(1e-9))) * 8) / 8
        weight = F.when(w.isNull() | F.isnan(w) | (w <= 0), 1.0).otherwise(F.pow(F.lit(2.0), octave))
    else:
        weight = F.length(F.bin(size)).cast("double")
    key = F.sha2(F.concat(F.col("source").isNull().cast("string"), F.coalesce("source", F.lit(""))).cast("binary"), 256)
    chance = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    own = [F.col(row_col).alias("_row")] if row_col else []
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), weight.alias("wt"), uniform(chance, seed).alias("u"), *own)
    sizes = common.materialize(sizes.withColumn("_key", key))
    classes = common.materialize(sizes.groupBy("_key", "source", "wt").agg(F.count("*").alias("_n"), F.sum("size").alias("s")))
    by = targets(classes.withColumnRenamed("s", "size"), weights, most).withColumn("_key", key).drop("source")
    by = common.materialize(expected(classes.drop("source").join(by, "_key"), most))
    total = by.agg(F.sum("_n")).first()[0] or 1
    inside = F.least(F.greatest(F.col("p"), F.lit(1e-12)), F.lit(1 - 1e-9))

    def ranked(groups: DataFrame) -> DataFrame:
        rows = common.attach(sizes, groups, ["_key", "wt"], "_n", total)
        odds = (F.col("u") / (1 - F.col("u"))) / (inside / (1 - inside))
        rows = rows.withColumn("odds", odds)
        return rows.withColumn("bucket", F.when(F.col("p") > 0, F.floor(F.col("odds") / (1 + F.col("odds")) * BUCKETS)).cast("int"))

    sums = ranked(by).filter("bucket is not null").groupBy("_key", "bucket").agg(F.sum("size").alias("s"), F.first("need").alias("need"))
    upto = F.sum("s").over(Window.partitionBy("_key").orderBy("bucket"))
    ends = sums.withColumn("base", upto - F.col("s")).filter((F.col("base") < F.col("need")) & (F.col("base") + F.col("s") >= F.col("need")))
    rows = ranked(by.join(ends.select("_key", F.col("bucket").alias("end"), "base"), "_key", "left"))
    last = F.coalesce(F.col("bucket") == F.col("end"), F.lit(False))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("_key").orderBy("odds", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.col("need") - F.col("base") - before
    cut = rows.filter(last).withColumn("extra", ((left > 0) & (left * 2 >= F.col("size"))).cast("int"))
    inner = F.col("bucket").isNotNull() & (F.col("need") > 0) & (F.col("end").isNull() | (F.col("bucket") < F.col("end")))
    rest = rows.filter(~last).withColumn("extra", inner.cast("int"))
    out = rest.unionByName(cut).withColumn("copies", (F.col("whole") + F.col("extra")).cast("int"))
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("whole").cast("int").alias("whole"), "p", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"), *([F.col("_row").alias(row_col)] if row_col else []))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, and copies."""
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, **kw) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of ``docs``."""
    names = [f"{P}c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names))
    seen = common.materialize(docs.toDF(*names).withColumn(P + "row", F.monotonically_increasing_id()))
    times = plan(seen, of[id_col], of[text_col], of[source_col], of.get(weight_col), row_col=P + "row", **kw).select(P + "row", "copies").filter("copies > 0")
    rows = seen.join(times, P + "row").withColumn(P + "copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(*names).toDF(*docs.columns)


#: The same odds, each document ranked in one window.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS w FROM d GROUP BY source),
s1 AS (SELECT *, source_size * 3 AS cap,
  (SELECT sum(source_size) FROM s0) - coalesce(sum(source_size * 3) OVER o, 0) AS rest,
  (SELECT sum(w) FROM s0) - coalesce(sum(w) OVER o, 0) AS lft
  FROM s0 WINDOW o AS (ORDER BY source_size::DOUBLE / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT rest AS r, lft AS l FROM s1 WHERE cap * lft >= w * rest ORDER BY source_size::DOUBLE / w, source IS NULL, source LIMIT 1),
s2 AS (SELECT s1.*, CASE WHEN lv.r IS NULL OR (w * lv.r)::DOUBLE / lv.l::DOUBLE > cap THEN cap::DOUBLE ELSE (w * lv.r)::DOUBLE / lv.l::DOUBLE END AS target FROM s1 LEFT JOIN lv ON true),
e AS (SELECT d.doc_id, d.text, d.source, d.size, length(bin(d.size))::BIGINT AS wt, s.source_size, s.target FROM d JOIN s2 s ON d.source IS NOT DISTINCT FROM s.source),
-- Of each weight: the words of all documents of higher weight, and the weighted words of the rest. The lowest c that keeps its weight within 3 copies is right.
k AS (SELECT DISTINCT source, wt, target, coalesce(sum(size) OVER hi, 0) AS above, sum(size * wt) OVER all_ - coalesce(sum(size * wt) OVER hi, 0) AS rest FROM e
  WINDOW hi AS (PARTITION BY source ORDER BY wt DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), all_ AS (PARTITION BY source)),
c AS (SELECT source, max_by(CASE WHEN rest > 0 THEN (target - above * 3) / rest::DOUBLE ELSE 0 END, wt) AS c FROM k WHERE (CASE WHEN rest > 0 THEN (target - above * 3) / rest::DOUBLE ELSE 0 END) * wt <= 3 GROUP BY source),
t AS (SELECT e.*, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN c.c IS NULL THEN 3.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(3.0::DOUBLE, c.c * wt)) END AS times FROM e LEFT JOIN c ON e.source IS NOT DISTINCT FROM c.source),
p AS (SELECT *, floor(times) AS whole, times - floor(times) AS p, target - sum(floor(times) * size) OVER (PARTITION BY source) AS need,
  (('0x' || md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))))[:13])::BIGINT + 0.5) / 4503599627370496.0::DOUBLE AS u FROM t),
q AS (SELECT *, (u / (1 - u)) / (least(greatest(p, 1e-12), 1 - 1e-9) / (1 - least(greatest(p, 1e-12), 1 - 1e-9))) AS odds FROM p),
x AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, p > 0 ORDER BY odds, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
f AS (SELECT *, (whole + CASE WHEN p > 0 AND need > 0 AND before < need AND (need - before) * 2 >= size THEN 1 ELSE 0 END)::INT AS copies FROM x)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * copies)::BIGINT AS taken, copies FROM f
"""

"""Relational smoke over the star tables: an extension beyond the inventory, so that joins, aggregates, windows, cubes and event time have SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _read(spark: SparkSession, d: str, *tables: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{d}/{t}.parquet") for t in tables]


def pricing(spark, d):
    (li,) = _read(spark, d, "lineitem")
    rows = li.filter("l_shipdate <= timestamp_ntz'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), F.count("*").alias("orders"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))


def segments(spark, d):
    c, o, n = _read(spark, d, "customer", "orders", "nation")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rows.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.countDistinct("c_custkey").alias("customers"))


def rolled(spark, d):
    (p,) = _read(spark, d, "part")
    return p.rollup("p_brand", "p_size").agg(F.count("*").alias("parts"), F.grouping_id().cast("long").alias("level"))


def ranked(spark, d):
    (o,) = _read(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place")).filter("place <= 3")


def daily(spark, d):
    (e,) = _read(spark, d, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("day"), "event_type", "events")


_QUERIES = {
    "ext_pricing_summary": (pricing, "SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS sum_qty, count(*) AS orders, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"),
    "ext_segment_orders": (segments, "SELECT n_name, c_mktsegment, count(*) AS orders, count(DISTINCT c_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"),
    "ext_part_rollup": (rolled, "SELECT p_brand, p_size, count(*) AS parts, grouping_id(p_brand, p_size)::BIGINT AS level FROM part GROUP BY ROLLUP (p_brand, p_size)"),
    "ext_top_orders": (ranked, "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS place FROM orders QUALIFY place <= 3"),
    "ext_daily_events": (daily, "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS events FROM events GROUP BY ALL"),
}


def queries() -> dict:
    return {n: q for n, (q, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _QUERIES.items()}

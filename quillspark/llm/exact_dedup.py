"""Exact deduplication by two passes over a Bloom filter of repeated hashes (DataFrame functions only).

Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``. The filter counts to two: it consists of pieces of ``PIECE`` bits, a text's SHA-256 selects
one piece and ``HASHES`` bits of it. Pass one finds the bits met twice or more: a task sends the numbers of its bits, combined (8 bytes for each different one; whole
partial filters would cost tasks x filter, which grows with the square of the input). Pass two tests every row: if one of its bits was met only once, the row is surely
single and goes straight through. Only the possibly repeated rows shuffle, by SHA-256, so a false positive costs a shuffled row (about 1 of 600 single ones) and never a
wrong result.

The filter grows with the rows, ``BITS_A_ROW`` bits each. It is never broadcast whole: rows are written by ranges of at most ``RANGE`` pieces (32 MB), and each
range's rows are read and tested against its part of the filter. Up to 11 million rows are one range.

Defined cases: a null text counts as empty, and all empty texts are one group; a null doc_id sorts after every
id; equal rows (same id and text) are told apart only by order, one of them stays; an empty table gives an empty result; texts of any length are hashed whole;
extra columns pass through :func:`deduplicate` unchanged, whatever their names (the helper columns are kept apart from them)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

P = "__xd_"
BITS_A_ROW, HASHES, PIECE, RANGE = 24, 3, 32768, 8192


def filter_pieces(total: int) -> int:
    return max(1, -(-total * BITS_A_ROW // PIECE))


def prepared(docs: DataFrame, carry: list[str], id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """``carry``, row number, size, SHA-256 and filter piece of every row, written by range of pieces; and the number of rows."""
    total = docs.count()
    norm = F.translate(F.coalesce(F.col(text_col), F.lit("")), " \t\n\x0b\x0c\r", "")
    rows = docs.select(
        *carry,
        F.col(id_col).alias(P + "id"),
        F.monotonically_increasing_id().alias(P + "row"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias(P + "n"),
        F.sha2(norm.cast("binary"), 256).alias(P + "sha"),
    )
    rows = rows.withColumn(P + "piece", F.pmod(F.xxhash64(P + "sha"), F.lit(filter_pieces(total))))
    return common.materialize(rows.withColumn(P + "range", F.floor(F.col(P + "piece") / RANGE)), by=P + "range"), total


def bit(k: int) -> Column:
    """Number within its piece of the row's k-th bit."""
    return F.pmod(F.xxhash64(F.lit(k), F.col(P + "sha")), F.lit(PIECE))


def filter_of(rows: DataFrame) -> DataFrame:
    """Pass one: (piece, bits), a bitmap of the bits that two or more rows have."""
    slots = rows.select(F.explode(F.array(*[F.col(P + "piece") * PIECE + bit(k) for k in range(HASHES)])).alias("slot"))
    again = slots.groupBy("slot").agg(F.count("*").alias("c")).filter("c > 1")
    return again.groupBy(F.floor(F.col("slot") / PIECE).alias(P + "piece")).agg(F.bitmap_construct_agg(F.pmod("slot", F.lit(PIECE))).alias(P + "bits"))


def possibly_repeated(rows: DataFrame, total: int) -> DataFrame:
    """Pass two: ``rows`` of :func:`prepared` plus ``__xd_hit``, false only if no other row has the same hash."""
    out = None
    for r in range(-(-filter_pieces(total) // RANGE)):
        mine = rows.filter(F.col(P + "range") == r)
        met = mine.join(F.broadcast(filter_of(mine)), P + "piece", "left")  # at most RANGE pieces of 4 KB
        hit = F.col(P + "bits").isNotNull()
        for k in range(HASHES):
            byte = F.conv(F.hex(F.substring(F.col(P + "bits"), (bit(k) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            hit = hit & (F.call_function("shiftright", byte, F.pmod(bit(k), F.lit(8)).cast("int")).bitwiseAND(1) == 1)
        met = met.withColumn(P + "hit", hit).drop(P + "bits")
        out = met if out is None else out.unionByName(met)
    return out


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, SHA, keep id, group size, kept) for every row; texts don't shuffle."""
    slim, total = prepared(docs, [], id_col, text_col)
    tested = common.materialize(possibly_repeated(slim, total).select(F.col(P + "id").alias("doc_id"), P + "row", P + "n", P + "sha", P + "hit"))
    single = tested.filter(~F.col(P + "hit")).select("doc_id", P + "row", P + "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    maybe = tested.filter(P + "hit").select("doc_id", P + "row", P + "n", P + "sha")
    joined = common.attach(maybe, maybe.groupBy(P + "sha").agg(F.count("*").alias("group_size"), first("doc_id")), P + "sha", "group_size", total)
    return single.unionByName(joined.select("doc_id", P + "row", P + "sha", F.col("best.id").alias("keep_id"), "group_size", (F.col("best.row") == F.col(P + "row")).alias("kept")))


def first(id_col: str) -> Column:
    """The row of a group that stays: most code points, then the smallest id."""
    return F.min(F.struct((-F.col(P + "n")).alias("n"), F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(P + "row").alias("row"))).alias("best")


def report(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    return groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.col(P + "sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``; of equal rows with equal ids one stays.

    Rows are written once with their hashes; both passes read only the hashes. Single rows are read again without a shuffle; of the possibly repeated, those that stay
    come by a join with the groups' best rows."""
    names = [f"{P}c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names))
    rows, total = prepared(docs.toDF(*names), names, of[id_col], of[text_col])
    tested = possibly_repeated(rows, total)
    maybe = tested.filter(P + "hit")
    stay = maybe.groupBy(P + "sha").agg(first(P + "id")).select(F.col("best.row").alias(P + "row"))
    # An inner join: Spark would push a semi join below the test of the filter, and shuffle all rows.
    return tested.filter(~F.col(P + "hit")).select(*names).unionByName(maybe.join(stay, P + "row").select(*names)).toDF(*docs.columns)

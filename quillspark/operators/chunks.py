"""Batches of bounded size: greedy folds over the ordered blocks of a page or document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from . import ordered


def fold(sizes: Column, budget: int = X.CHUNK_CHARS, most: int = X.CHUNK_BLOCKS) -> Column:
    """W11 for one array of sizes, that of a page: chunk number of each: a block is never split, a chunk never over ``most`` blocks."""
    start = F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("s"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, size: Column) -> Column:
        full = (a["n"] > 0) & ((a["s"] + size > budget) | (a["n"] >= most))
        c = F.when(full, a["c"] + 1).otherwise(a["c"])
        return F.struct(c.alias("c"), F.when(full, size.cast("long")).otherwise(a["s"] + size).alias("s"), F.when(full, 1).otherwise(a["n"] + 1).alias("n"), F.concat(a["out"], F.array(c)).alias("out"))

    return F.aggregate(sizes, start, step, lambda a: a["out"])


def _packer(order: list[str], budget: int, most: int, fill: float | None):
    """A chunk ends when the next block would not fit, or, with ``fill``, at the start of a module once it is so full."""

    def step(s: dict, row: dict) -> list[dict]:
        full = s["size"] + row["_size"] > budget or s["n"] >= most or (fill is not None and row["_starts"] and s["size"] >= budget * fill)
        if s["n"] and full:
            s.update(chunk=s["chunk"] + 1, size=0, n=0)
        s["size"] += row["_size"]
        s["n"] += 1
        return [{o: row[o] for o in order} | {"chunk": s["chunk"]}]

    return step


def _pack(rows: DataFrame, keys: list[str], order: list[str], budget: int, most: int, fill: float | None = None) -> DataFrame:
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{o}` {kinds[o]}" for o in order) + ", chunk int"
    return ordered.fold(rows, keys, order, schema, lambda: {"chunk": 0, "size": 0, "n": 0}, _packer(order, budget, most, fill))


def greedy(blocks: DataFrame, keys: list[str], order: list[str], size: Column, budget: int = X.CHUNK_CHARS, most: int = X.CHUNK_BLOCKS) -> DataFrame:
    """W11 over a table: (keys, order, chunk), linear in the blocks of a key."""
    return _pack(blocks.select(*keys, *order, F.coalesce(size, F.lit(0)).cast("long").alias("_size")), keys, order, budget, most)


def plan(blocks: DataFrame, budget: int = X.CHUNK_CHARS, most: int = X.CHUNK_BLOCKS, fill: float = X.CHUNK_FILL) -> DataFrame:
    """W13 of blocks (doc_id, ord, text, module, heading, is_heading, risky): (doc_id, ord, lane, chunk, context).

    Blocks at risk go last, one a chunk, in the slow lane. A chunk that begins inside a module whose heading it lacks carries it as context."""
    fast, slow = blocks.filter(~F.col("risky")), blocks.filter("risky")
    w = Window.partitionBy("doc_id").orderBy("ord")
    marked = fast.withColumn("_starts", F.lag("ord").over(w).isNotNull() & ~F.lag("module").over(w).eqNullSafe(F.col("module")))
    rows = _pack(marked.select("doc_id", "ord", F.length("text").cast("long").alias("_size"), "_starts"), ["doc_id"], ["ord"], budget, most, fill)
    out = marked.join(rows, ["doc_id", "ord"])
    chunk = Window.partitionBy("doc_id", "chunk").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.struct("module", "heading")).over(chunk)
    has = F.max((F.col("is_heading") & F.col("module").eqNullSafe(first["module"])).cast("int")).over(chunk) == 1
    out = out.select("doc_id", "ord", F.lit("fast").alias("lane"), "chunk", F.when(has, F.lit("")).otherwise(F.coalesce(first["heading"], F.lit(""))).alias("context"))
    last = rows.groupBy("doc_id").agg(F.max("chunk").alias("last"))
    slow = slow.join(last, "doc_id", "left").withColumn("chunk", (F.coalesce("last", F.lit(-1)) + F.row_number().over(w)).cast("int"))
    return out.unionByName(slow.select("doc_id", "ord", F.lit("slow").alias("lane"), "chunk", F.coalesce("heading", F.lit("")).alias("context")))


def previous_tail(planned: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, chunk, tail): the end of the last block of the fast chunk before."""
    rows = planned.filter("lane = 'fast'").join(blocks.select("doc_id", "ord", "text"), ["doc_id", "ord"])
    tails = rows.groupBy("doc_id", "chunk").agg(F.max_by("text", "ord").alias("text"))
    return tails.select("doc_id", "chunk", F.lag(T.trailing_context(F.col("text"))).over(Window.partitionBy("doc_id").orderBy("chunk")).alias("tail"))


def module_pack(sizes: list[list[int]], budget: int = X.CHUNK_CHARS, most: int = X.CHUNK_BLOCKS) -> list[list[tuple[int, int]]]:
    """W12 of one page: whole modules go together if they fit, larger ones are split in order. (module, member) by chunk."""
    chunks: list[list[tuple[int, int]]] = []
    used = 0

    def fits(size: int, n: int) -> bool:
        return bool(chunks and chunks[-1]) and used + size <= budget and len(chunks[-1]) + n <= most

    for m, members in enumerate(sizes):
        groups = [list(range(len(members)))] if sum(members) <= budget and len(members) <= most else [[i] for i in range(len(members))]
        if len(groups) > 1 and chunks and chunks[-1]:
            chunks.append([])
            used = 0
        for g in groups:
            size = sum(members[i] for i in g)
            if g and not fits(size, len(g)):
                if not chunks or chunks[-1]:
                    chunks.append([])
                used = 0
            if g:
                chunks[-1] += [(m, i) for i in g]
                used += size
    return [c for c in chunks if c]


def split_sentences(text: str, most: int) -> list[str]:
    """Sentences packed up to ``most`` characters; a longer one is cut hard."""
    import re

    if len(text) <= most:
        return [text]
    out, now = [], ""
    for s in re.findall(r"[^.!?。！？;；]+[.!?。！？;；]*\s*|[.!?。！？;；]+\s*", text):
        while len(s) > most:
            if now:
                out.append(now)
                now = ""
            out.append(s[:most])
            s = s[most:]
        if len(now) + len(s) > most:
            out.append(now)
            now = ""
        now += s
    return [x for x in [*out, now] if x]

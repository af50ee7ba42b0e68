"""SimHash near-duplicates by tiled exact comparison.

Words are lower-cased (A-Z) ``[^\\x20\\x09-\\x0D]+``; a 64-bit fingerprint has the bits that over half of the 3-word shingles'
XXH64 (seed 42) have. Distinct fingerprints fall into tiles by the population counts of their four 16-bit quarters: keys (four counts) in order of their sum and of
the first two counts' sum fill tiles of at most ``tile`` fingerprints; a key that has more is dealt into several tiles by hash. Two
fingerprints at ``RADIUS`` or fewer differing bits have quarter counts that differ by ``RADIUS`` in sum at most, so a fingerprint meets only the tiles
that hold a key so near to its own; these pairs of tiles are compared whole with numpy exclusive-or and bit counts, each pair a unit of work. A unit returns a
spanning forest of its links (fewer links than fingerprints, and no component is lost), and components of all forests come from Spark joins.

The work is quadratic in the number of *distinct* fingerprints by the method named. A tile holds a ``PARTS``th of them, ``TILE`` at most: up to 4 million fingerprints
each is sent to some 10 to 20 tiles, whatever their number; beyond, to a share of all tiles.

Defined cases: null, empty or blank texts have fingerprint zero and link like any other; texts of 1 or 2 words have one shingle,
the whole sequence; a null doc_id counts as larger than any id and a component of only such rows has a null id; rows with equal ids
are each returned; an empty table gives an empty result; extra columns pass through :func:`deduplicate` unchanged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RADIUS, PARTS, TILE, WIDTH, SEED = 2, 32, 131_072, 3, 42
P = "__sh_"


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Of one text; see :func:`fingerprints`."""
    return int(fingerprints([text], width)[0])


def fingerprints(texts: list[bytes], width: int = WIDTH) -> np.ndarray:
    """uint64 fingerprints. Bit counts are taken over slices of hashes, so memory doesn't follow the text's length."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        w = text.lower().split()  # bytes: only A-Z, and only the six white-space bytes
        if not w:
            continue
        if len(w) <= width:
            out[i] = digest(b" ".join(w), SEED)
            continue
        shingles = [a + b" " + b + b" " + c for a, b, c in zip(w, w[1:], w[2:])] if width == 3 else [b" ".join(w[j : j + width]) for j in range(len(w) - width + 1)]
        n, total = len(shingles), np.zeros(64, np.int64)
        for j in range(0, n, 65_536):
            h = np.array([digest(s, SEED) for s in shingles[j : j + 65_536]], "<u8")
            total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(total * 2 > n, bitorder="little").view("<u8")[0]
    return out


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, row key, fp as a signed long) of every row; only these 24 bytes a row go on. ``row_col``: a column of different numbers, else made here."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias(P + "row"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            fp = fingerprints(common.text_bytes(b.column(2))).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", P + "row", "fp"])

    return rows.mapInArrow(run, f"doc_id long, {P}row long, fp long")


def quarters(fp: np.ndarray) -> np.ndarray:
    """Tile key of each fingerprint: four population counts of 0 to 16 as digits of base 17."""
    c = np.bitwise_count(np.ascontiguousarray(fp).view(np.uint16).reshape(-1, 4)).astype(np.int64)
    return ((c[:, 0] * 17 + c[:, 1]) * 17 + c[:, 2]) * 17 + c[:, 3]


def _steps(radius: int) -> np.ndarray:
    grid = np.stack(np.meshgrid(*[np.arange(-radius, radius + 1)] * 4, indexing="ij"), -1).reshape(-1, 4)
    return grid[np.abs(grid).sum(1) <= radius]


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest within ``a`` and between ``a`` and ``b`` (b None: within a only); blocks bound the memory."""
    every = a if b is None else np.concatenate([a, b])
    label = np.arange(len(every))  # of each fingerprint, the index of some member of its component
    found: list[tuple[int, int]] = []
    right, shift = (a, 0) if b is None else (b, len(a))
    step = max(1, 4_000_000 // max(1, len(right)))
    for i in range(0, len(a), step):
        near = np.bitwise_count(a[i : i + step, None] ^ right[None, :]) <= radius
        if b is None:  # each pair once
            near &= np.arange(len(right))[None, :] > np.arange(i, min(i + step, len(a)))[:, None]
        for r in np.flatnonzero(near.any(axis=1)):
            mine = label[r + i]
            for other in np.unique(label[np.flatnonzero(near[r]) + shift]):
                if other != mine:
                    found.append((mine, other))
                    label[label == other] = mine
    if not found:
        return every[:0], every[:0]
    f = np.array(found)
    return every[f[:, 0]], every[f[:, 1]]


def tiles_of(n: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """First tile and number of tiles of each key, from the keys' counts."""
    k = np.arange(17**4)
    c = np.stack([k // 4913, k // 289 % 17, k // 17 % 17, k % 17])
    first, cuts = np.zeros(17**4, np.int64), np.zeros(17**4, np.int64)
    at, room = -1, 0
    order = np.lexsort((c[2], c[0], c[0] + c[1], c.sum(0)))
    for key in order[n[order] > 0].tolist():
        own = int(n[key])
        if own > room:
            at, room = at + 1, tile
        first[key], cuts[key] = at, max(1, -(-own // tile))
        room -= own
        if cuts[key] > 1:  # tiles of its own
            at, room = at + int(cuts[key]) - 1, 0
    return first, cuts


def links(fps: DataFrame, radius: int = RADIUS, tile: int | None = None) -> DataFrame:
    """(a long, b long): links between distinct fingerprints (column fp) that keep every component whole."""

    def count(batches):
        for b in batches:
            k, n = np.unique(quarters(b.column(0).to_numpy()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["k", "n"])

    # At most 17^4 = 83,521 rows of two numbers, whatever the input: safe to hold on the driver and to broadcast.
    held = fps.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    size = np.zeros(17**4, np.int64)
    size[held.column("k").to_numpy()] = held.column("n").to_numpy()
    base, cuts = tiles_of(size, tile or int(min(TILE, max(1, size.sum() // PARTS))))
    shared, steps = fps.sparkSession.sparkContext.broadcast((cuts, base)), _steps(radius)

    def deal(batches):
        cuts, base = shared.value
        for batch in batches:
            whole = batch.column(0).to_numpy()
            for lo in range(0, len(whole), 16_384):  # a slice times 41 neighbours stays small
                fp = whole[lo : lo + 16_384]
                k = quarters(fp)
                mixed = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                own = base[k] + (mixed % cuts[k].astype(np.uint64)).astype(np.int64)
                digits = np.stack([k // 4913, k // 289 % 17, k // 17 % 17, k % 17], 1)
                units, which = [own * (1 << 31) + own], [np.arange(len(fp))]
                for s in steps:
                    near = digits + s
                    ok = ((near >= 0) & (near <= 16)).all(1)
                    other = ((near[ok, 0] * 17 + near[ok, 1]) * 17 + near[ok, 2]) * 17 + near[ok, 3]
                    n, mine = cuts[other], np.flatnonzero(ok)
                    at = np.repeat(np.arange(len(n)), n)
                    t = base[other][at] + (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n))
                    m = own[mine[at]]
                    keep = t != m
                    units.append((np.minimum(t, m) * (1 << 31) + np.maximum(t, m))[keep])
                    which.append(mine[at][keep])
                unit, of = np.concatenate(units), np.concatenate(which)
                o = np.lexsort((unit, of))  # several near keys may be in one tile
                unit, of = unit[o], of[o]
                once = np.ones(len(o), bool)
                once[1:] = (unit[1:] != unit[:-1]) | (of[1:] != of[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(unit[once]), pa.array(fp[of[once]])], ["unit", "fp"])

    def compare(batches):
        cuts, base = shared.value
        for unit, t in common.Runs(batches, "unit"):
            fp = t.column("fp").to_numpy().view(np.uint64)
            first, second = int(unit) >> 31, int(unit) & ((1 << 31) - 1)
            if first == second:
                x, y = forest(fp, None, radius)
            else:
                k = quarters(fp)
                mixed = (fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                left = base[k] + (mixed % cuts[k].astype(np.uint64)).astype(np.int64) == first
                if left.all() or not left.any():
                    continue
                x, y = forest(fp[left], fp[~left], radius)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    return fps.mapInArrow(deal, "unit long, fp long").repartition(F.col("unit")).sortWithinPartitions("unit").mapInArrow(compare, "a long, b long")


def rows_with_roots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, row_col: str | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, row, fp) of all rows; (fp, id, row, n) of all fingerprints, id and row the first of their component; rows."""
    rows = common.materialize(with_fingerprints(docs, id_col, text_col, row_col))
    first = lambda c: F.min(c).alias("first")
    fps = common.materialize(rows.groupBy("fp").agg(F.count("*").alias("n"), first(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(P + "row").alias("row")))))
    roots = common.components(links(fps.select("fp"), radius))
    of = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = common.materialize(of)
    least = linked.groupBy("root").agg(F.count("*").alias("m"), F.min("first").alias("least"))
    total = rows.count()
    member = common.attach(linked, least, "root", "m", total).select("fp", "n", F.col("least.id").alias("component_id"), F.col("least.row").alias("keep_row"))
    return rows, common.materialize(member), total


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    rows, member, total = rows_with_roots(docs)
    return common.attach(rows, member, "fp", "n", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The row with the smallest id of every component, with the columns of ``docs``."""
    names = [f"{P}c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names))
    seen = common.materialize(docs.toDF(*names).withColumn(P + "row", F.monotonically_increasing_id()))
    _, member, _ = rows_with_roots(seen, of[id_col], of[text_col], radius, P + "row")
    keep = member.select(F.col("keep_row").alias(P + "row")).distinct().hint("merge")  # one plan at every size: this table grows with the documents
    return seen.join(keep, P + "row", "left_semi").select(*names).toDF(*docs.columns)

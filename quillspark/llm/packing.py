"""Best-fit packing of documents into sequences by a grouping genetic algorithm on distributed islands.

A document is its token ids and an end id; one longer than a sequence is cut into full pieces, the first of which may be shorter. Pieces
of a whole sequence need no packing. The others are dealt by hash into shards of about ``SHARD`` pieces; each shard has ``ISLANDS`` islands,
every one a Spark group of its own that evolves a population of packings from differently ordered best fits. Crossover injects whole
well-filled bins of one parent into the other, removes the bins that hold a piece twice, and best-fits the displaced pieces, largest first; a mutation dissolves some
open bins as well. An epoch ends with migration: every island of a shard gets the elites of all. After ``EPOCHS`` of them one group a shard evolves all elites
together. Bins filled to ``FULL`` of a sequence are final; the pieces of all other bins are dealt anew into fewer shards, until one shard holds the rest. A shard whose packing
has no more bins than its tokens need evolves no further. If dealing anew places less than a tenth of what was left, or after ``MOST_LEVELS`` levels, open bins stay
as they are (some sequences are less full; no piece is lost).

Only 30 bytes a piece shuffle; a group has a bounded number of pieces whatever the input. All choices derive from hashes of the pieces, so
reruns agree.

Defined cases: null or empty text is the end id alone, one token; equal rows are pieces of their own; pieces of equal length go by their row's place; a text of any length is
encoded whole; a null doc_id is kept; an empty table gives an empty result; extra columns don't matter."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

SIZE, END, SHARD, ISLANDS, EPOCHS, POPULATION, CHILDREN, FULL, MOST_LEVELS = 1024, 2, 20_000, 2, 2, 3, 8, 1022 / 1024, 12
P = "__pk_"


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every piece; one pass over the texts."""

    def run(batches):
        memo = tokens.memo(path, "bytes")
        tail = np.array([end], memo.type).tobytes()
        for b in common.slices(batches, 2400):
            at, columns = [], ([], [], [], [], [])
            for row, found in enumerate(memo.encode(common.text_bytes(b.column(1)))):
                own = np.frombuffer(found + tail, memo.type)
                first = len(own) - size * ((len(own) - 1) // size)
                for piece, (lo, hi) in enumerate(zip([0, *range(first, len(own), size)], range(first, len(own) + 1, size))):
                    data = own[lo:hi].astype("<u4").tobytes()
                    at.append(row)
                    for c, v in zip(columns, (piece, lo, hi - lo, zlib.crc32(data), data)):
                        c.append(v)
            ids_col = [pa.array(columns[4], pa.binary())] if ids else []
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:4]], *ids_col],
                ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


Packing = list[list]  # of bins: [filled, piece, piece, ...]


def best_fit(lengths: list[int], order: list[int], size: int, bins: Packing | None = None) -> Packing:
    """Put the pieces of ``order`` into ``bins``, each where the least room stays."""
    bins = [] if bins is None else bins
    by: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0  # of the rooms that some bin has; the best fit is one bit search
    for b, members in enumerate(bins):
        free = size - members[0]
        by[free].append(b)
        mask |= 1 << free
    for i in order:
        need = lengths[i]
        m = mask >> need
        if m:
            free = need + (m & -m).bit_length() - 1
            b = by[free].pop()
            if not by[free]:
                mask ^= 1 << free
            members = bins[b]
            members[0] += need
            members.append(i)
        else:
            free, b = size, len(bins)
            bins.append([need, i])
        free -= need
        by[free].append(b)
        mask |= 1 << free
    return bins


def fitness(bins: Packing, size: int) -> tuple[int, int]:
    """Fewer bins first, then unevenly filled ones (Falkenauer's squares): less is better."""
    return len(bins), -sum(b[0] * b[0] for b in bins)


def cross(a: Packing, b: Packing, lengths: list[int], size: int, rng: random.Random) -> Packing:
    """Child of b with well-filled bins of a."""
    good = [x for x in a if x[0] >= size * FULL] or [max(a, key=lambda x: x[0])]
    take = rng.sample(good, max(1, int(len(good) * rng.uniform(0.02, 0.25))))
    inside = {i for x in take for i in x[1:]}
    full, child, displaced = [x for x in take if x[0] == size], [list(x) for x in take if x[0] < size], []  # full bins never change, so packings share them
    open_ = [x for x in b if x[0] < size]
    dissolved = {id(x) for x in rng.sample(open_, int(len(open_) * rng.uniform(0, 0.5)))} | {id(min(b, key=lambda x: x[0]))}
    for x in b:
        if id(x) in dissolved or not inside.isdisjoint(x[1:]):
            displaced += [i for i in x[1:] if i not in inside]
        elif x[0] == size:
            full.append(x)
        else:
            child.append(list(x))
    if noise := rng.choice((0, 0, 4, 16, 64)):
        displaced.sort(key=lambda i: lengths[i] + rng.random() * noise, reverse=True)
    else:
        displaced.sort(key=lengths.__getitem__, reverse=True)
    return full + best_fit(lengths, displaced, size, child)


def evolve(lengths: list[int], population: list[Packing], size: int, seed: int, children: int | None = None) -> Packing:
    """The best packing found; ``population`` may be empty. It stops at the bound ceil(sum / size)."""
    rng, n = random.Random(seed), len(lengths)
    least = -(-sum(lengths) // size)
    people = [(fitness(p, size), p) for p in population]
    while len(people) < POPULATION and min((x[0][0] for x in people), default=n + 1) > least:
        keys = lengths
        if people:
            noise = rng.choice((2, 8, 32, 128))
            keys = [x + (rng.random() - 0.5) * noise for x in lengths]
        p = best_fit(lengths, sorted(range(n), key=keys.__getitem__, reverse=True), size)
        people.append((fitness(p, size), p))
    people.sort(key=lambda x: x[0])
    for _ in range(CHILDREN if children is None else children):
        if people[0][0][0] <= least or len(people) < 2:
            break
        a, b = sorted(rng.sample(range(len(people)), 2))  # the better one's bins are injected
        child = cross(people[a][1], people[b][1], lengths, size, rng)
        f = fitness(child, size)
        if f < people[-1][0] and all(f != x[0] for x in people):  # keeps the population varied
            people[-1] = (f, child)
            people.sort(key=lambda x: x[0])
    return people[0][1]


def _bin_of(bins: Packing, n: int) -> np.ndarray:
    of = np.zeros(n, np.int32)
    for b, members in enumerate(bins):
        of[members[1:]] = b
    return of


def _bins(of: np.ndarray, lengths: list[int]) -> Packing:
    out: Packing = [[0] for _ in range(int(of.max()) + 1)] if len(of) else []
    for i, b in enumerate(of.tolist()):
        out[b][0] += lengths[i]
        out[b].append(i)
    return [x for x in out if len(x) > 1]


def _seed(*parts: int) -> int:
    return zlib.crc32(":".join(map(str, parts)).encode())


def level_of(items: DataFrame, level: int, shards: int, size: int) -> DataFrame:
    """(row, length, sequence, final) of ``items`` (row, length): islands, migration, and which bins stay."""
    dealt = common.materialize(items.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards))), slim=True)

    def known(t: pa.Table) -> tuple[pa.Table, list[int], list[Packing]]:
        """Pieces in order, their lengths, and the packings of the elites that came with them."""
        of = [np.frombuffer(x, np.int32) for x in sorted(t.column("elite").drop_null().to_pylist())]
        t = t.filter(pc.is_valid(t.column("row"))).sort_by("row")
        lengths = t.column("length").to_pylist()
        return t, lengths, [_bins(x, lengths) for x in of]

    def island(epoch: int):
        def run(t: pa.Table) -> pa.Table:
            t, lengths, elites = known(t)
            shard, k = t.column("shard")[0].as_py(), t.column("island")[0].as_py()
            found = _bin_of(evolve(lengths, elites, size, _seed(shard, k, level, epoch)), len(lengths))
            return pa.table({"shard": [shard], "elite": pa.array([found.tobytes()], pa.binary())})

        return run

    def on(df: DataFrame) -> DataFrame:
        return df.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))

    none = F.lit(None).cast("long")
    rows = dealt.select("shard", "row", "length", F.lit(None).cast("binary").alias("elite"))
    both = rows
    for epoch in range(EPOCHS):
        elites = common.materialize(on(both).groupBy("shard", "island").applyInArrow(island(epoch), "shard long, elite binary"), slim=True)
        both = rows.unionByName(elites.select("shard", none.alias("row"), none.alias("length"), "elite"))

    def migrate(t: pa.Table) -> pa.Table:
        t, lengths, elites = known(t)
        shard = t.column("shard")[0].as_py()
        found = _bin_of(evolve(lengths, elites, size, _seed(shard, ISLANDS, level, EPOCHS)), len(lengths))
        fill = np.bincount(found, lengths)
        final = (fill >= size * FULL)[found] if shards > 1 else np.ones(len(found), bool)
        sequence = (np.int64(level) << np.int64(57)) | (np.int64(shard) << np.int64(20)) | found.astype(np.int64)
        return pa.table({"row": t.column("row"), "length": t.column("length"), "sequence": pa.array(sequence), "final": pa.array(final)})

    return both.groupBy("shard").applyInArrow(migrate, "row long, length long, sequence long, final boolean")


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """``cut`` (columns of :func:`pieces`) plus sequence_id and offset."""
    cut = common.materialize(cut.withColumn(P + "row", F.monotonically_increasing_id()))
    items = cut.filter(F.col("length") < size).select(F.col(P + "row").alias("row"), "length")
    placed, left = [], items.count()
    for level in range(MOST_LEVELS):
        shards = 1 if level == MOST_LEVELS - 1 and left <= 2 * SHARD else max(1, -(-left // SHARD))
        done = common.materialize(level_of(items, level, shards, size))
        placed.append(done.filter("final").select("row", "sequence"))
        items, before = done.filter("not final").select("row", "length"), left
        left = items.count() if shards > 1 else 0
        if left and (left > 0.9 * before or level == MOST_LEVELS - 1):  # no use in dealing again: what is placed stays
            placed.append(done.filter("not final").select("row", "sequence"))
            left = 0
        if not left:
            break
    of = placed[0]
    for x in placed[1:]:
        of = of.unionByName(x)
    top = F.lit(1 << 62).bitwiseOR(F.col(P + "row"))
    rows = cut.join(of.withColumnRenamed("row", P + "row"), P + "row", "left").withColumn("sequence_id", F.coalesce("sequence", top))
    # At most ``size`` pieces a sequence.
    before = Window.partitionBy("sequence_id").orderBy("doc_id", "piece", P + "row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop(P + "row", "sequence")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(pieces(docs, tokens.default_path("byte_bpe_50k.json")))

"""Token ids in a binary file format: canonical length-limited Huffman codes of ids from global counts.

Format: a folder with two Parquet datasets, so that any store Spark can write will do. ``codebook``: one row a used id (id, bits), lengths by
package-merge with at most ``BITS`` bits; codes are canonical, in the order of (bits, id). ``blocks/part=N``: one row a block of whole
documents, in ascending id order by (part, start): start (ids of all documents before it), doc ids and lengths, the bit offset of every
``STEP``-th id (checkpoints, as 32-bit differences), and the bit stream. Blocks decode independently, and every checkpoint within a block as well:
the decoder steps through all of them at once, one table look-up of ``BITS`` bits an id.

Only sums reach the driver: a count for each vocabulary id, and one a partition.

Defined cases: null or empty text is the end id alone; null ids come first; rows with equal ids are ordered by a hash of their texts; an empty
table gives an empty codebook and no blocks; extra columns aren't stored; a document longer than ``BLOCK`` ids is a block of its own."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

BITS, STEP, BLOCK, END = 16, 128, 262_144, 1


def code_lengths(counts: np.ndarray, most: int = BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits for the symbols with a count (package-merge); 0 for the others."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << most:
        raise ValueError(f"{n} symbols don't fit {most} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[used].astype(np.int64)
    weights, history = leaf, []
    for _ in range(most - 1):  # pair the cheapest of the level below, merge with the leaves
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, pairs])
        order = np.argsort(both, kind="stable")
        history.append(order)
        weights = both[order]
    take, length = 2 * n - 2, np.zeros(n, np.int64)
    for order in reversed(history):  # a taken package takes the two it was made of
        chosen = order[:take]
        length[chosen[chosen < n]] += 1
        take = 2 * int((chosen >= n).sum())
    length[:take] += 1
    out[used] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code of each symbol with a length."""
    codes, code, last = np.zeros(len(lengths), np.int64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for s in order[lengths[order] > 0].tolist():
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def table(lengths: np.ndarray, codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for every ``bits``-bit prefix."""
    sym, size = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.int64)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(codes[used] << (bits - lengths[used]))]
    times = 1 << (bits - lengths[used])
    sym[: times.sum()], size[: times.sum()] = np.repeat(used, times), np.repeat(lengths[used], times)
    return sym, size


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bit stream and the bit offset of every STEP-th id."""
    size = lengths[ids]
    at = np.cumsum(size) - size
    total = int(at[-1] + size[-1]) if len(ids) else 0
    byte, wide = at >> 3, codes[ids] << (24 - size - (at & 7))  # up to 16 bits after up to 7 lie in three bytes
    n = (total + 7) // 8 + 3
    out = np.zeros(n)
    for k, shift in enumerate((16, 8, 0)):
        out += np.bincount(byte + k, (wide >> shift) & 255, minlength=n)
    return out.astype(np.uint8)[: (total + 7) // 8].tobytes(), at[::STEP]


def decode(stream: bytes, points: np.ndarray, n: int, sym: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The n ids of a block, all checkpoints in step."""
    b = np.frombuffer(stream + bytes(4), np.uint8).astype(np.uint32)
    window = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    out = np.zeros((len(points), STEP), np.uint32)
    pos, last = points.astype(np.int64), len(window) - 1
    for k in range(STEP):
        at = np.minimum(pos >> 3, last)
        prefix = (window[at] >> (8 - (pos & 7)).astype(np.uint32)) & 0xFFFF
        out[:, k] = sym[prefix]
        pos += size[prefix]
    return out.reshape(-1)[:n]


def tokenized(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, part, local, ids): in ascending order by (part, local), local being the ids before it in its part."""
    key = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text")).repartitionByRange(max(common.partitions(docs), 1), "doc_id", key).sortWithinPartitions("doc_id", key)

    def run(batches):
        memo = tokens.memo(path, "words")
        part, before = TaskContext.get().partitionId(), 0
        tail = np.array([end], memo.type).tobytes()
        width = len(tail)
        for b in common.slices(batches):
            found = [x + tail for x in memo.encode(common.text_bytes(b.column(1)))]
            n = np.array([len(x) // width for x in found], np.int64)
            local = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(local), pa.array(found, pa.binary())], ["doc_id", "part", "local", "ids"])

    return rows.mapInArrow(run, "doc_id long, part int, local long, ids binary")


def write(docs: DataFrame, to: str, path: str, end: int = END) -> None:
    """Encode every text of ``docs`` into the folder ``to``."""
    spark = docs.sparkSession
    own = common.materialize(tokenized(docs, path, end))
    memo = tokens.memo(path, "words")
    kind, vocab, width = memo.type, max(memo.size, end + 1), int(memo.type[-1])

    def count(batches):
        n, parts = np.zeros(vocab, np.int64), {}  # ids, and ids of each part
        for b in common.slices(batches):
            part, ids = b.column(0).to_numpy(), b.column(1).to_pylist()
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // width
            n += np.bincount(np.frombuffer(b"".join(ids), kind), minlength=vocab)
            for p in np.unique(part).tolist():
                parts[p] = parts.get(p, 0) + int(size[part == p].sum())
        used = np.flatnonzero(n)
        keys = np.concatenate([used, -1 - np.array(list(parts), np.int64)]) if parts else used
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.concatenate([n[used], np.array(list(parts.values()), np.int64)]) if parts else n[used], pa.int64())], ["k", "n"])

    sums = own.select("part", "ids").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    k, n = sums["k"].to_numpy(np.int64), sums["n"].to_numpy(np.int64)
    counts = np.zeros(vocab, np.int64)
    counts[k[k >= 0]] = n[k >= 0]
    parts = int(-k.min()) if len(k) and k.min() < 0 else 0
    size = np.zeros(parts + 1, np.int64)
    size[-1 - k[k < 0]] = n[k < 0]
    base = np.cumsum(size) - size
    lengths = code_lengths(counts)
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths), base))

    def blocks(batches):
        lengths, codes, base = shared.value
        held: list[tuple] = []

        def close():
            part, start = held[0][1], int(base[held[0][1]] + held[0][2])
            n = np.array([len(x[3]) // width for x in held], np.int64)
            stream, points = encode(np.frombuffer(b"".join(x[3] for x in held), kind), lengths, codes)
            steps = np.diff(points, prepend=0).astype("<u4").tobytes()
            columns = [pa.array([v], t) for v, t in ((part, pa.int32()), (start, pa.int64()), ([x[0] for x in held], pa.list_(pa.int64())), (n.tolist(), pa.list_(pa.int64())), (steps, pa.binary()), (stream, pa.binary()))]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["part", "start", "doc_ids", "lengths", "points", "stream"])

        total = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (held[-1][1] != row[1] or held[-1][2] + len(held[-1][3]) // width != row[2]):  # another stretch of the order
                    yield close()
                    total = 0
                held.append(row)
                total += len(row[3]) // width
                if total >= BLOCK:
                    yield close()
                    total = 0
        if held:
            yield close()

    schema = "part int, start long, doc_ids array<long>, lengths array<long>, points binary, stream binary"
    own.select("doc_id", "part", "local", "ids").mapInArrow(blocks, schema).write.partitionBy("part").parquet(f"{to}/blocks")
    book = np.flatnonzero(lengths)
    spark.createDataFrame(list(zip(book.tolist(), lengths[book].tolist())), "id int, bits int").coalesce(1).write.parquet(f"{to}/codebook")
    common.drop(own)


def read(spark: SparkSession, at: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files."""
    book = spark.read.schema("id int, bits int").parquet(f"{at}/codebook").toPandas()  # at most the vocabulary
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.int64)
    lengths[book["id"].to_numpy(np.int64)] = book["bits"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(lengths)

    def run(batches):
        sym, size = table(shared.value, canonical(shared.value), BITS)
        for b in batches:
            for start, docs, n, points, stream in zip(*(c.to_pylist() for c in b.columns)):
                n = np.array(n, np.int64)
                ends = np.cumsum(n)
                found = decode(stream, np.cumsum(np.frombuffer(points, "<u4").astype(np.int64)), int(ends[-1]), sym, size).astype("<u4").tobytes()
                each = [found[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist())]
                columns = [pa.array(docs, pa.int64()), pa.array(start + ends - n), pa.array(n), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(each, pa.binary())] if ids else [])], ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids])

    schema = "part int, start long, doc_ids array<long>, lengths array<long>, points binary, stream binary"
    rows = spark.read.schema(schema).parquet(f"{at}/blocks").select("start", "doc_ids", "lengths", "points", "stream")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def report(docs: DataFrame) -> DataFrame:
    """Write all documents, read the files back."""
    to = f"{common.shared_dir(docs.sparkSession)}/quill-huffman-{uuid.uuid4().hex}"
    common.remember(docs.sparkSession, to)
    write(docs, to, tokens.default_path("word_bpe_49k.json"))
    return read(docs.sparkSession, to)

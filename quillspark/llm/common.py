"""Helpers that several operators share: words, shared storage, packed arrays, skew-safe joins, components."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here: space and TAB..CR. ``bytes.split()`` splits at exactly these six bytes.
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local master may do without: its tasks share this machine's folder."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file:{tempfile.gettempdir()}/quillspark-shared"
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone; a leftover scratch table is harmless
        pass


@atexit.register
def _tidy() -> None:
    while _made:
        _delete(*_made.pop())


def remember(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when this process ends."""
    _made.append((spark, path))


def materialize(df: DataFrame, slim: bool = False, by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and reread it: cuts lineage, survives lost executors.

    Its shuffle files go when the write ends, so that only one stage's shuffle is on disk at a time. ``slim``: Python gets only numbers here, in
    batches of Spark's usual size. ``by``: a column of few values, each of which gets a folder of its own, so that a filter on it reads no other."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quill-{uuid.uuid4().hex}"
    held = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": "10000"} if slim else {})
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out._quill_path = path
    return out


def written(spark: SparkSession, make) -> DataFrame:
    """The result of ``make`` as a table; the tables made on the way to it go at once."""
    before = {path for _, path in _made}
    out = materialize(make())
    for _, path in [x for x in _made if x[1] not in before and x[1] != out._quill_path]:
        _delete(spark, path)
    _made[:] = [x for x in _made if x[1] in before or x[1] == out._quill_path]
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing needs any more."""
    for t in tables:
        if path := getattr(t, "_quill_path", None):
            _delete(t.sparkSession, path)
            _made[:] = [x for x in _made if x[1] != path]


@contextlib.contextmanager
def batches(spark: SparkSession, rows: int = 500):
    """Rows here are whole texts: a batch of Spark's 10,000 is tens of megabytes, held several times on the way to Python and back.

    Holds for what runs inside; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns as differences, compressed: small if they are sorted."""
    import zstandard

    n = len(columns[0])
    body = b"".join(np.diff(c.astype(np.int64), prepend=0).view(np.uint8).reshape(n, 8).T.tobytes() for c in columns) if n else b""
    return zstandard.ZstdCompressor(level=1).compress(np.int64(n).tobytes() + body)


def unpack(data: bytes, columns: int) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    parts = np.frombuffer(raw[8:], np.uint8).reshape(columns, 8, n)
    return [np.cumsum(np.ascontiguousarray(p.T).view(np.int64).reshape(-1)) for p in parts]


def raw(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.large_binary()).to_pylist()


def text_bytes(column: pa.Array) -> list[bytes]:
    """As :func:`raw`, null as empty."""
    return [b or b"" for b in raw(column)]


def slices(batches, rows: int = 1200):
    """Smaller batches, so that few texts are held as objects at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def crc_mod(column: str, n: int) -> F.Column:
    """crc32(id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def partitions(df: DataFrame) -> int:
    """Input splits of ``df``: a size-proportional figure that costs no job."""
    return max(1, df.rdd.getNumPartitions())


def even_keys(spark: SparkSession, n: int) -> np.ndarray:
    """n different integers of which ``repartition(n, key)`` puts one in each partition; hashing 0 .. n-1 would put several in some and none in others."""
    spread = spark.range(24 * n + 64).select(F.col("id").cast("int").alias("id")).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p"))
    found = spread.groupBy("p").agg(F.min("id").alias("id")).toPandas()  # n rows of two numbers
    if len(found) < n:  # hardly ever: any keys are right, only less even
        return np.arange(n)
    return found.sort_values("p")["id"].to_numpy(np.int64)


def attach(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int, most: int = 10_000) -> DataFrame:
    """Inner join of ``rows`` with one row a group on ``key``, safe for a group that holds most rows.

    Groups of over ``total / most`` rows can't be more than ``most``: these few are broadcast (a proven bound), so
    their rows never shuffle. The other groups have at most ``total / most`` rows each and join by a shuffle."""
    keys = [key] if isinstance(key, str) else key
    hot = groups.filter(F.col(size) > max(1000, total // most))
    cold = groups.filter(F.col(size) <= max(1000, total // most))
    tagged = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    heavy = tagged.filter("_hot").drop("_hot").join(F.broadcast(hot), keys)
    light = tagged.filter("_hot is null").drop("_hot").join(cold, keys)
    return heavy.unionByName(light)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): (node, root) for every node that has an edge.

    Every round each node points to the least of its neighbours and itself in a fixed random order, and the edges are
    rewritten to what their ends point to, until none joins two nodes. The number of rounds grows with the logarithm
    of the size; each is two aggregations with map-side combining and two joins that AQE can split. ``root`` is some
    node of the component. All state is a table in the shared folder."""
    rank = lambda c: F.struct(F.xxhash64(c).alias("r"), F.col(c).alias("v"))
    cur = materialize(edges.filter("a <> b").select("a", "b").distinct(), slim=True)
    steps: list[DataFrame] = []
    for _ in range(most_rounds):
        if cur.isEmpty():
            break
        both = cur.select(F.col("a").alias("node"), F.col("b").alias("to")).union(cur.select("b", "a"))
        step = materialize(both.groupBy("node").agg(F.min(rank("to")).alias("m")).select("node", F.least("m", rank("node"))["v"].alias("to")))
        steps.append(step)
        a, b = (step.select(F.col("node").alias(c), F.col("to").alias(f"_{c}")) for c in ("a", "b"))
        nxt = cur.join(a, "a").join(b, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        nxt = materialize(nxt.filter("a <> b").distinct())
        drop(cur)
        cur = nxt
    else:
        raise RuntimeError(f"components: not done after {most_rounds} rounds")
    if not steps:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    out = steps[0].select("node", F.col("to").alias("root"))
    for step in steps[1:]:  # a root that is in no later edge stays
        out = out.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out


class Runs:
    """Groups rows of sorted Arrow batches: whole groups of equal ``key``, however the batches cut them."""

    def __init__(self, batches, key: str):
        self.batches, self.key = batches, key

    def __iter__(self):
        rest: list[pa.RecordBatch] = []
        now = None
        for batch in self.batches:
            if not batch.num_rows:
                continue
            keys = batch.column(self.key).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                if rest and keys[i] != now:
                    yield now, pa.Table.from_batches(rest)
                    rest = []
                now = keys[i]
                rest.append(batch.slice(i, j - i))
        if rest:
            yield now, pa.Table.from_batches(rest)

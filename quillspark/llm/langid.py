"""Language identification by nearest centroid.

A text's letters (other characters become spaces, case folded) give UTF-8 byte n-grams of 1 to 3, the longer ones hashed into ``DIMS``. Weights are
(1 + log tf) * idf, normalised; document frequencies count every training document. Each language has up to ``CENTROIDS`` centroids by
spherical k-means on a bounded sample of its training documents (about ``SAMPLE`` a language, chosen by a hash of the id). A text gets the language of the
centroid with the highest cosine; it is flagged as rejected if its cosine distance to it is beyond what nearly all sample members of that
centroid have (the ``QUANTILE`` plus ``SLACK``). Rejected texts keep the nearest language in lang_pred; the flag is a column of its own.

Training documents have a text and a lang, and crc32(doc_id as text) mod 4 is not 2. Only the text is an input of a prediction.

Defined cases: null text or text without a letter: ``und``, score 0; nothing to learn from: ``und`` for all; null doc_id counts as the
empty text in the hash; equal rows get equal results; an empty table gives an empty result; extra columns don't matter. What reaches the driver
is the sample, one count a dimension, and one a language (languages are assumed to be thousands at most)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIMS, CENTROIDS, SAMPLE, QUANTILE, SLACK = 8192, 3, 400, 0.995, 0.15
_FOLD = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def grams(text: bytes) -> np.ndarray | None:
    """Count of each dimension; None if the text has no letter."""
    s = text.decode("utf-8", "replace")
    if not any(map(str.isalpha, s)):
        return None
    b = np.frombuffer(b" " + s.lower().encode("utf-8", "replace").translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    two = (b[:-1] << np.uint32(8)) | b[1:]
    three = (two[:-1] << np.uint32(8)) | b[2:]
    mix = lambda x, k: ((x * np.uint32(k)) >> np.uint32(16)) & np.uint32(DIMS - 1)
    n = np.bincount(mix(two, 0x9E3779B1), minlength=DIMS) + np.bincount(mix(three, 0x85EBCA77), minlength=DIMS)
    n[:256] += np.bincount(b, minlength=256)
    n[32] = 0
    return n


def unit(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1."""
    w = np.zeros(n.shape, np.float32)
    np.log(n, out=w, where=n > 0)
    w = (w + (n > 0)) * idf
    return w / np.maximum(np.linalg.norm(w, axis=-1, keepdims=True), 1e-12)


def cluster(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from the mean and the rows furthest from what is there; few rows give few centroids."""
    norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    c = norm(rows.mean(0, keepdims=True))
    while len(c) < min(k, len(rows) // 8):
        c = np.vstack([c, rows[(rows @ c.T).max(1).argmin()]])
    for _ in range(10):
        of = (rows @ c.T).argmax(1)
        c = norm(np.stack([rows[of == j].mean(0) if (of == j).any() else c[j] for j in range(len(c))]))
    return c


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """The model: languages, centroids, idf, and the least accepted cosine of each centroid."""
    rows = docs.filter(f"`{text_col}` is not null and `{lang_col}` is not null").filter(common.crc_mod(id_col, 4) != 2)
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")).alias("h"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = {lang: int(min(1.0, SAMPLE / n) * (1 << 62)) for lang, n in sizes.items()}
    shared = docs.sparkSession.sparkContext.broadcast(share)

    def run(batches):
        seen, found, share = 0, np.zeros(DIMS, np.int64), shared.value
        for b in batches:
            langs, vectors = [], []
            for text, lang, h in zip(common.text_bytes(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist()):
                n = grams(text)
                if n is None:
                    continue
                seen += 1
                found += n > 0
                if (h & ((1 << 62) - 1)) < share[lang]:
                    langs.append(lang)
                    vectors.append(n.astype("<u4")[n > 0].tobytes() + np.packbits(n > 0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(vectors, pa.binary()), pa.array([None] * len(langs), pa.int64()), pa.array([None] * len(langs), pa.int64())], ["lang", "vector", "dim", "n"])
        dims = np.append(np.flatnonzero(found), -1)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(dims), pa.string()), pa.nulls(len(dims), pa.binary()), pa.array(dims, pa.int64()), pa.array(np.append(found[dims[:-1]], seen), pa.int64())], ["lang", "vector", "dim", "n"])

    out = common.materialize(rows.mapInArrow(run, "lang string, vector binary, dim long, n long"))
    df = out.filter("dim is not null").groupBy("dim").agg(F.sum("n").alias("n")).toPandas()
    count = dict(zip(df["dim"].tolist(), df["n"].tolist()))
    total, have = count.pop(-1, 0), np.zeros(DIMS)
    have[list(count)] = list(count.values())
    idf = (np.log((1 + total) / (1 + have)) + 1).astype(np.float32)
    idf[have == 0] = 0
    sample: dict[str, list[bytes]] = {}
    for r in out.filter("lang is not null").select("lang", "vector").collect():
        sample.setdefault(r["lang"], []).append(bytes(r["vector"]))
    common.drop(out)
    langs, centroids, least = [], [], []
    for lang in sorted(sample):
        rows_ = np.zeros((len(sample[lang]), DIMS), np.uint32)
        for i, v in enumerate(sorted(sample[lang])):
            mask = np.unpackbits(np.frombuffer(v[-DIMS // 8 :], np.uint8)).astype(bool)
            rows_[i, mask] = np.frombuffer(v[: -DIMS // 8], "<u4")
        x = unit(rows_, idf)
        c = cluster(x, CENTROIDS)
        own = x @ c.T
        for j in range(len(c)):
            mine = own[own.argmax(1) == j, j]
            langs.append(lang)
            centroids.append(c[j])
            least.append(float(np.quantile(mine, 1 - QUANTILE)) - SLACK if len(mine) else -1.0)
    return {"langs": langs, "centroids": np.array(centroids, np.float32).reshape(-1, DIMS), "least": least, "idf": idf}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), (common.crc_mod(id_col, 4) == 2).alias("held_out"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        weights = m["centroids"].T
        for b in batches:
            texts = common.text_bytes(b.column(2))
            lang, score, rejected = [], [], []
            for i in range(0, len(texts), 64):
                n = [grams(t) if m["langs"] else None for t in texts[i : i + 64]]
                have = [k for k, x in enumerate(n) if x is not None]
                cos = unit(np.stack([n[k] for k in have]), m["idf"]) @ weights if have else None
                at = dict(zip(have, range(len(have))))
                for k in range(len(n)):
                    if k not in at:
                        lang.append("und"), score.append(0.0), rejected.append(True)
                        continue
                    j = int(cos[at[k]].argmax())
                    c = float(cos[at[k], j])
                    lang.append(m["langs"][j]), score.append(min(1.0, max(0.0, c))), rejected.append(c < m["least"][j])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, rejected boolean")


def report(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))

"""Content hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed as X

_M = 0xFFFFFFFF


def _lanes(texts: list[str]) -> list[str]:
    """M01 of several texts, a step for all that are long enough; the few longest are finished one by one."""
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2") for t in texts]
    order = sorted(range(len(units)), key=lambda i: -len(units[i]))
    sizes = np.array([len(units[i]) for i in order], np.int64)
    a, b = (np.full(len(order), seed, np.uint64) for seed in X.HASH_SEEDS)
    p, q = (np.uint64(x) for x in X.HASH_PRIMES)
    mask = np.uint64(_M)
    few = 32
    steps = int(sizes[few]) if len(sizes) > few else 0
    if steps:
        every = np.zeros((steps, len(order)), np.uint16)
        for k, i in enumerate(order):
            n = min(steps, len(units[i]))
            every[:n, k] = units[i][:n]
        live = np.searchsorted(-sizes, -np.arange(steps), side="left")  # texts longer than the step
        for s in range(steps):
            n = live[s]
            c = every[s, :n].astype(np.uint64)
            a[:n] = ((a[:n] ^ c) * p) & mask
            b[:n] = ((b[:n] ^ (((c * np.uint64(31) + np.uint64(s)) & np.uint64(0xFFFF)) ^ (c >> np.uint64(8)))) * q) & mask
    out = [""] * len(order)
    for k, i in enumerate(order):
        x, y = int(a[k]), int(b[k])
        for s, c in enumerate(units[i][steps:].tolist(), steps):
            x = ((x ^ c) * X.HASH_PRIMES[0]) & _M
            y = ((y ^ (((31 * c + s) & 0xFFFF) ^ (c >> 8))) * X.HASH_PRIMES[1]) & _M
        out[i] = f"{x:08x}{y:08x}"
    return out


@F.pandas_udf(StringType())
def two_lane(text: pd.Series) -> pd.Series:
    """16 hex digits of two 32-bit multiplicative lanes over UTF-16 units; the second also mixes the position. In Arrow batches, 1,000 texts at a time."""
    texts, out = [t if isinstance(t, str) else None for t in text], []
    for i in range(0, len(texts), 1000):
        part = texts[i : i + 1000]
        found = iter(_lanes([t for t in part if t is not None]))
        out += [None if t is None else next(found) for t in part]
    return pd.Series(out, dtype=object)


def of_list(texts: Column) -> Column:
    """Hash of an ordered list, its items divided by NUL."""
    return two_lane(F.array_join(texts, "\x00"))


def segment(text: Column, source: Column, target: Column) -> Column:
    """Identity of a segment under a language pair."""
    return two_lane(F.concat_ws("\x00", text, source, target))


def fast(*columns: Column) -> Column:
    """The engine's own key where bytes needn't agree with anything stored elsewhere."""
    return F.xxhash64(*columns)

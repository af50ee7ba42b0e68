"""State machines over the ordered rows of a key, in batch. Rows stream through in Arrow batches: a task holds one state and one batch, however many rows a key has."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold(df: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable[[], object], step: Callable[[object, dict], Iterable[dict]], finish: Callable[[object], Iterable[dict]] | None = None) -> DataFrame:
    """Rows (``keys`` and ``schema``) that ``step`` gives for each row and ``finish`` for each key. ``step`` changes the state it gets.

    Keys meet by a shuffle; the order within a key is the machine's nature, so a key is one task's work, linear in its rows."""
    kinds = dict(df.dtypes)
    fields = StructType.fromDDL(", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + schema)
    arrow = to_arrow_schema(fields)

    def run(batches):
        import pyarrow as pa

        now, state, out = None, None, []
        for b in batches:
            for row in b.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != now or state is None:
                    if state is not None and finish:
                        out += [dict(zip(keys, now)) | r for r in finish(state)]
                    now, state = key, start()
                for r in step(state, row):
                    out.append(dict(zip(keys, key)) | r)
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
        if state is not None and finish:
            out += [dict(zip(keys, now)) | r for r in finish(state)]
        yield pa.RecordBatch.from_pylist(out, arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, fields)

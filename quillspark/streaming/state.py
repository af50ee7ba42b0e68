"""Structured Streaming twins of the ordered folds. ``ts`` must be a timestamp with zone (cast TIMESTAMP_NTZ first)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A file stream of events, ``ts`` cast for watermarks."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


class LaneCaps(StatefulProcessor):
    """Width and streak of each lane; rows are (lane, seq, kind)."""

    def __init__(self, least: int = 1, most: int = 6):
        self.least, self.most = least, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("lane", "cap int, streak int, events int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        cap, streak, n = self.state.get() if self.state.exists() else (self.most, 0, 0)
        for kind in pd.concat(list(rows)).sort_values("seq")["kind"]:
            n += 1
            if kind == "rate":
                cap, streak = max(self.least, cap // 2), 0
            elif kind == "timeout":
                cap, streak = max(self.least, cap - 1), 0
            elif cap < self.most:
                streak += 1
                if streak >= 5:
                    cap, streak = min(self.most, cap + 1), 0
        self.state.update((cap, streak, n))
        yield pd.DataFrame({"lane": [key[0]], "cap": [cap], "streak": [streak], "events": [n]})

    def close(self) -> None:
        pass


def lane_caps(feedback: DataFrame, least: int = 1, most: int = 6) -> DataFrame:
    """The current cap after each micro-batch (update mode)."""
    return feedback.groupBy("lane").transformWithStateInPandas(LaneCaps(least, most), "lane string, cap int, streak int, events int", "Update", "None")


class Cooldown(StatefulProcessor):
    """Drops an event within the pause of the last accepted one of its key."""

    def __init__(self, pause_ms: int):
        self.pause = pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        last, ids = self.last.get()[0] if self.last.exists() else None, []
        for ms, i in pd.concat(list(rows)).sort_values(["ms", "event_id"])[["ms", "event_id"]].itertuples(index=False):
            if last is None or ms - last >= self.pause:
                last = int(ms)
                ids.append(i)
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame({"key": [str(key[0])] * len(ids), "event_id": ids})

    def close(self) -> None:
        pass


def cooled(stream: DataFrame, key: str, pause_ms: int) -> DataFrame:
    """The stream has ``ms`` and ``event_id``."""
    return stream.groupBy(key).transformWithStateInPandas(Cooldown(pause_ms), "key string, event_id long", "Append", "None")


def deduplicated(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A key that has been seen within the watermark is dropped."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def idle_sessions(stream: DataFrame, key: str, ts: str = "ts", gap: str = "150 seconds", late: str = "10 minutes") -> DataFrame:
    """Watchdog sessions, closed by the watermark."""
    return stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events")).select(key, "w.start", "w.end", "events")


def windows(stream: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tumbling counts and sums; an extension beyond the inventory."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select("w.start", "event_type", "events", "value")


def drain(df: DataFrame, name: str, mode: str, checkpoint: str):
    """Run a stream to the end of what is there, into an in-memory table."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)

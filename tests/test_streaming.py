"""Streams run to their end and are compared with the batch operators."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import lanes
from quillspark.streaming import state


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, state.ROCKSDB)
    yield spark
    spark.conf.set(key, before)


def feedback(spark):
    return spark.range(400).select((F.col("id") % 3).cast("string").alias("lane"), F.col("id").alias("seq"), F.when(F.col("id") % 29 == 0, "rate").when(F.col("id") % 31 == 0, "timeout").otherwise("success").alias("kind"))


def test_lane_caps_equal_the_fold(rocks, tmp_path):
    f = feedback(rocks)
    for i in range(4):  # four files in order: state goes over micro-batches
        f.filter(f"seq >= {i * 100} and seq < {i * 100 + 100}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = state.drain(state.lane_caps(stream), "caps", "update", str(tmp_path / "c"))
    last = got.groupBy("lane").agg(F.max_by(F.struct("cap", "streak", "events"), "events").alias("s")).select("lane", "s.*")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, lanes.adaptive_caps(f).select("lane", "cap", "streak", "events").collect()))


def test_cooldown_equals_the_fold(rocks, tmp_path):
    e = rocks.range(200).select((F.col("id") % 4).alias("user_id"), F.col("id").alias("event_id"), (F.col("id") * 97 % 5000).alias("ms"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    got = state.drain(state.cooled(stream, "user_id", 400), "cool", "append", str(tmp_path / "c"))
    want = lanes.cooled(e, "user_id", F.col("ms"), 400)
    assert sorted((r.key, r.event_id) for r in got.collect()) == sorted((str(r.user_id), r.event_id) for r in want.collect())


def test_watermarks_cast_first(spark, tmp_path):
    e = spark.sql("select id as event_id, cast(timestamp_seconds(id * 3600) as timestamp_ntz) as ts, 'a' as event_type, 1.0D as value, id % 2 as user_id from range(60)")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = state.events(spark, str(tmp_path / "in"), e.schema)
    got = state.drain(state.windows(stream), "win", "append", str(tmp_path / "c"))
    assert sum(r.events for r in got.collect()) <= 60
    dup = state.drain(state.deduplicated(state.events(spark, str(tmp_path / "in"), e.schema), ["user_id"], late="100 days").select("user_id"), "dd", "append", str(tmp_path / "d"))
    assert dup.count() == 2
    s = state.drain(state.idle_sessions(state.events(spark, str(tmp_path / "in"), e.schema), "user_id", gap="90 minutes"), "ses", "append", str(tmp_path / "s"))
    assert all(r.events == 1 for r in s.collect())


def test_queue_and_scheduler(spark):
    rows = [("q", 1, "enqueue", "a", 0), ("q", 2, "enqueue", "b", 1), ("q", 3, "enqueue", "a", 5), ("q", 4, "promote", "a", 3), ("q", 5, "enqueue", "c", 0), ("q", 6, "cancel", "b", 0)]
    got = lanes.queue(spark.createDataFrame(rows, "queue string, seq long, verb string, key string, priority int")).orderBy("place").collect()
    assert [(r.key, r.priority) for r in got] == [("a", 3), ("c", 0)]
    jobs = [{"id": i, "lane": "x", "priority": 0, "seconds": 1} for i in range(3)] + [{"id": 9, "lane": "y", "priority": 1, "seconds": 1}]
    order = lanes.simulate(jobs, 2, {"x": 2, "y": 1})
    assert order[0]["id"] == 9 and [j["start"] for j in order] == [0.0, 0.0, 1.0, 2.0]

"""Adaptive concurrency of service lanes, policies, and ordered state over events; streaming twins are in ``streaming``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered

#: Fixed values: (kind, mode) to (least, initial, most) parallel requests.
BANDS = [
    ("free", "stable", 1, 1, 1), ("free", "auto", 1, 1, 1), ("free", "high", 1, 1, 1), ("free", "custom", 1, 1, 1),
    ("paid-mt", "stable", 1, 2, 2), ("paid-mt", "auto", 1, 3, 4), ("paid-mt", "high", 1, 4, 4), ("paid-mt", "custom", 1, 3, 3),
    ("local", "stable", 1, 1, 1), ("local", "auto", 1, 1, 2), ("local", "high", 1, 2, 2), ("local", "custom", 1, 1, 1),
    ("llm", "stable", 1, 2, 2), ("llm", "auto", 1, 3, 6), ("llm", "high", 1, 6, 6), ("llm", "custom", 1, 3, 3),
]
CUSTOM_MOST = {"free": 1, "paid-mt": 4, "local": 2, "llm": 6}


def bands(spark) -> DataFrame:
    """P10: the policy as a dimension table."""
    return spark.createDataFrame(BANDS, "kind string, mode string, least int, initial int, most int")


def custom(kind: Column, value: Column) -> Column:
    """P10: a chosen width, within the kind's range."""
    top = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CUSTOM_MOST.items() for x in kv]), kind), F.lit(1))
    return F.least(F.greatest(F.round(value).cast("int"), F.lit(1)), top)


def lane_plan(lanes: DataFrame, mode: str) -> DataFrame:
    """Lanes (lane, kind) with their bands; unknown kinds count as free."""
    known = F.when(F.col("kind").isin(*CUSTOM_MOST), F.col("kind")).otherwise("free")
    return lanes.withColumn("kind", known).join(F.broadcast(bands(lanes.sparkSession).filter(F.col("mode") == mode)), "kind")


def prefetch(mode: Column, pool: Column) -> Column:
    """Pages ahead and behind."""
    ahead = F.when(mode == "stable", 2).when(mode == "high", 12).otherwise(F.greatest(F.lit(1), F.least(2 * pool, F.lit(10))))
    return F.struct(ahead.alias("ahead"), F.when(mode == "high", 2).otherwise(1).alias("behind"))


def ceiling(value: Column) -> Column:
    """Global width: 12 by default, 2 to 24."""
    n = F.round(value).cast("int")
    return F.when(n.isNull() | (n <= 0), 12).otherwise(F.least(F.greatest(n, F.lit(2)), F.lit(24)))


def window_pages(page: Column, ahead: Column, behind: Column, pages: Column) -> Column:
    """The page set around a page, within the document."""
    return F.filter(F.sequence(page - behind, page + ahead), lambda p: (p >= 0) & (p < pages))


def adaptive_caps(events: DataFrame, least: int = 1, most: int = 6) -> DataFrame:
    """(lane, cap, streak, events) after all feedback (lane, seq, kind) in order: rate limits halve, timeouts take one, five successes in a row give one."""

    def step(s: dict, row: dict) -> tuple:
        s["events"] += 1
        if row["kind"] in ("rate", "timeout"):
            s["cap"], s["streak"] = max(least, s["cap"] // 2 if row["kind"] == "rate" else s["cap"] - 1), 0
        elif s["cap"] < most:
            s["streak"] += 1
            if s["streak"] == 5:
                s["cap"], s["streak"] = s["cap"] + 1, 0
        return ()

    rows = events.select("lane", "seq", "kind")
    return ordered.fold(rows, ["lane"], ["seq", "kind"], "cap int, streak int, events int", lambda: {"cap": most, "streak": 0, "events": 0}, step, lambda s: [s])


def idle_sessions(events: DataFrame, key: str, ts: str, gap: str = "150 seconds") -> DataFrame:
    """Stretches without a pause of ``gap``."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def latest_wins(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key only the newest generation counts."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return events.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def cooled(events: DataFrame, key: str, ts: Column, pause_ms: int) -> DataFrame:
    """Events that aren't echoes: an event within ``pause_ms`` of the last accepted one of its key is dropped."""

    def step(s: dict, row: dict) -> list[dict]:
        if s["last"] is not None and row["_ms"] - s["last"] < pause_ms:
            return []
        s["last"] = row["_ms"]
        return [{"event_id": row["event_id"]}]

    return ordered.fold(events.select(key, ts.alias("_ms"), "event_id"), [key], ["_ms", "event_id"], "event_id long", lambda: {"last": None}, step)


def failure_memory(runs: DataFrame, limit: int = 2) -> DataFrame:
    """Hashes that failed in ``limit`` runs, each begun after the failure before was counted: (hash, failures, skip)."""

    def step(s: dict, row: dict) -> tuple:
        if s["at"] is None or row["started"] > s["at"]:
            s["at"], s["failures"] = row["ended"], s["failures"] + 1
        return ()

    rows = runs.filter("failed").select("hash", "started", "ended")
    out = ordered.fold(rows, ["hash"], ["started", "ended"], "failures int", lambda: {"at": None, "failures": 0}, step, lambda s: [{"failures": s["failures"]}])
    return out.withColumn("skip", F.col("failures") >= limit)


def first_terms(terms: DataFrame, most: int = 200) -> DataFrame:
    """A document's first meaning of each term, the first ``most`` terms by arrival."""
    first = terms.groupBy("doc_id", "source").agg(F.min_by("target", "pos").alias("target"), F.min("pos").alias("pos"))
    return first.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "source"))).filter(F.col("_r") <= most).drop("_r")


def queue(commands: DataFrame) -> DataFrame:
    """Queue verbs as an event fold: (queue, seq, verb, key, priority) to what is still waiting, most urgent first.

    enqueue (ignored while the key waits), promote (keeps the higher priority), cancel, cancel-except, clear. What waits is the state, by key."""

    def step(waiting: dict, row: dict) -> tuple:
        verb, key = row["verb"], row["key"]
        if verb == "enqueue":
            waiting.setdefault(key, [row["priority"], row["seq"]])
        elif verb == "promote" and key in waiting:
            waiting[key][0] = max(waiting[key][0], row["priority"])
        elif verb == "cancel":
            waiting.pop(key, None)
        elif verb in ("cancel-except", "clear"):
            kept = {key: waiting[key]} if verb == "cancel-except" and key in waiting else {}
            waiting.clear()
            waiting.update(kept)
        return ()

    rows = commands.select("queue", "seq", "verb", "key", "priority")
    left = ordered.fold(rows, ["queue"], ["seq", "verb", "key"], "key string, priority int, seq long", dict, step, lambda w: [{"key": k, "priority": p, "seq": n} for k, (p, n) in w.items()])
    return left.withColumn("place", F.row_number().over(Window.partitionBy("queue").orderBy(F.desc("priority"), "seq")))


def simulate(jobs: list[dict], total: int, lanes: dict[str, int], reserved: int = 1) -> list[dict]:
    """Order and times in which jobs (id, lane, priority, seconds) start under a global width, lane widths and a slot reserved for priority > 0."""
    waiting, running, now, out = sorted(jobs, key=lambda j: (-j["priority"], j["id"])), [], 0.0, []
    while waiting or running:
        for j in list(waiting):
            room = len(running) < total and (j["priority"] > 0 or sum(r["priority"] <= 0 for r in running) < total - reserved)
            if room and sum(r["lane"] == j["lane"] for r in running) < lanes.get(j["lane"], 1):
                waiting.remove(j)
                running.append(j | {"end": now + j["seconds"]})
                out.append({"id": j["id"], "start": now})
        if not running:
            break
        now = min(r["end"] for r in running)
        running = [r for r in running if r["end"] > now]
    return out

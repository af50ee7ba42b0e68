"""What goes to a generating service and comes back: requests, answers, repair rounds, caches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed as X
from ..functions import hashing

ANSWERS = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())]))


# --- answers ---------------------------------------------------------------------------------------------------------


def first_object(raw: str) -> dict | list | None:
    """The first JSON value of a noisy answer: inside a code fence, whole, or from the first brace; None if there is none."""
    text = raw.strip()
    if m := re.search(r"```(?:json)?\s*(.*?)```", text, re.S):
        text = m[1].strip() or text
    try:
        return json.loads(text)
    except ValueError:
        pass
    at = text.find("{")
    try:
        return json.JSONDecoder().raw_decode(text[at:])[0] if at >= 0 else None
    except ValueError:
        return None


def entries(raw: str) -> list[dict] | None:
    """Well-formed (id, text) entries in order; None if the answer has no list of them."""
    data = first_object(raw)
    found = data.get("translations") if isinstance(data, dict) else None
    if not isinstance(found, list):
        return None
    return [{"id": e["id"], "text": e["translatedText"]} for e in found if isinstance(e, dict) and isinstance(e.get("id"), str) and isinstance(e.get("translatedText"), str)]


@F.pandas_udf(ANSWERS)
def entries_udf(raw: pd.Series) -> pd.Series:
    return pd.Series([entries(r) if r is not None else None for r in raw])


def plain_answer(raw: str) -> str | None:
    """The text of a plain-mode answer, without fence, label and quotes; None for empty, a JSON shell, or a request for input."""
    t = raw.strip()
    if m := re.fullmatch(r"```(?:\w+)?\s*(.*?)```", t, re.S):
        t = m[1].strip() or t
    t = re.sub(X.ANSWER_LABEL, "", t, flags=re.I).strip()
    if len(t) > 1 and t[0] + t[-1] in ('""', "“”"):
        t = t[1:-1].strip()
    if t.startswith("{") and ('"translations"' in t or '"translatedText"' in t):
        found = entries(t)
        return found[0]["text"] if found else None
    if len(t) <= 48 and re.match(X.ASKS_FOR_INPUT, t, re.I):
        return None
    return t or None


def validate(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """(req, id, status, text): first answer of each id; missing and unexpected ids have rows of their own.

    ``requests``: (req, id); ``answers``: (req, pos, id, text)."""
    w = Window.partitionBy("req", "id").orderBy("pos")
    first = answers.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("req", "id", "text", F.lit(True).alias("_a"))
    both = requests.select("req", "id", F.lit(True).alias("_e")).join(first, ["req", "id"], "full")
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").otherwise("ok")
    return both.select("req", "id", status.alias("status"), F.when(status == "ok", F.col("text")).alias("text"))


# --- first-wins, subsets, replacement --------------------------------------------------------------------------------


def merge_layers(layers: DataFrame, key: Column) -> DataFrame:
    """Of equal keys the row of the first layer (then position) stays."""
    w = Window.partitionBy("_key").orderBy("layer", "pos")
    return layers.withColumn("_key", key).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_key")


def replace_members(blocks: DataFrame, cells: DataFrame, members: DataFrame) -> DataFrame:
    """Blocks without the members, and the cells made of them."""
    return blocks.join(members, ["doc_id", "page", "ord"], "left_anti").unionByName(cells, allowMissingColumns=True)


def shorter_only(old: DataFrame, new: DataFrame) -> DataFrame:
    """A new text replaces the old only if it is strictly shorter."""
    return old.join(new.select("id", F.col("text").alias("_n")), "id", "left").withColumn("text", F.when(F.length("_n") < F.length("text"), F.col("_n")).otherwise(F.col("text"))).drop("_n")


def pool_provider(pool: Column, page: Column) -> Column:
    """Page modulo pool; the first for a negative or missing page."""
    return F.element_at(pool, F.when(page.isNull() | (page < 0), 1).otherwise(F.pmod(page, F.size(pool)) + 1).cast("int"))


# --- caches ------------------------------------------------------------------------------------------------------------

#: The 13 columns that identify a cached page.
KEY = ("attachment", "file_hash", "page", "source_language", "target_language", "provider", "model", "prompt_version", "prompt_hash", "glossary_hash", "no_translate_hash", "settings_hash", "text_hash")
SCHEMA_VERSION = 5


def page_hits(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages with their cached answers; anything invalid (another version, no entries, half an entry) is a miss."""
    valid = cache.filter((F.col("schema_version") == SCHEMA_VERSION) & F.col("translations").isNotNull() & F.forall("translations", lambda t: t["id"].isNotNull() & t["text"].isNotNull()))
    w = Window.partitionBy(*KEY).orderBy(F.desc("created_at"))
    newest = valid.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*KEY, "translations")
    return pages.join(newest, list(KEY), "left")


def write_pages(cache: DataFrame, path: str) -> None:
    """Append finished pages; the commit protocol makes the write atomic, the schema version is stamped."""
    cache.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode("append").partitionBy("attachment").parquet(path)


def cached_by_id(blocks: DataFrame, page_hits_: DataFrame, valid: Column) -> DataFrame:
    """Blocks with the cached text of their id, where it still passes validation (a column over text and cached)."""
    rows = page_hits_.select(F.explode("translations").alias("t")).select(F.col("t.id").alias("id"), F.col("t.text").alias("cached"))
    out = blocks.join(rows.dropDuplicates(["id"]), "id", "left")
    return out.withColumn("cached", F.when(valid, F.col("cached")))


def stale(cache: DataFrame, now: Column) -> DataFrame:
    """Rows to sweep: another schema version, or a temporary file over five minutes old."""
    return cache.filter((F.col("schema_version") != SCHEMA_VERSION) | (F.col("path").endswith(".json.tmp") & (F.col("modified") < now - F.expr("interval 5 minutes"))))


def invalidate(cache: DataFrame, attachment: str | None = None, file_hash: str | None = None) -> DataFrame:
    """What stays when one version, all versions, or everything goes."""
    if attachment is None:
        return cache.limit(0)
    gone = F.col("attachment") == attachment
    return cache.filter(~(gone if file_hash is None else gone & (F.col("file_hash") == file_hash)))


def segment_hits(segments: DataFrame, store: DataFrame) -> DataFrame:
    """Segments with a non-empty stored text, by content hash."""
    return segments.join(store.filter(F.length("text") > 0).select("hash", F.col("text").alias("cached")), "hash")


def segment_merge(store: DataFrame, new: DataFrame) -> DataFrame:
    """Read, merge, last write wins."""
    rows = store.select("hash", "text", F.lit(0).alias("_n")).unionByName(new.select("hash", "text", F.lit(1).alias("_n")))
    return rows.groupBy("hash").agg(F.max_by("text", "_n").alias("text"))


def complete_pages(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Pages all of whose blocks have an answer; only these are cached."""
    rows = blocks.join(answers.select("id", F.lit(1).alias("_a")), "id", "left")
    return rows.groupBy("doc_id", "page").agg(F.count("*").alias("blocks"), F.sum(F.coalesce("_a", F.lit(0))).alias("answered")).filter("blocks = answered").select("doc_id", "page", "blocks")


def segment_hash(text: Column, source: Column, target: Column) -> Column:
    return hashing.segment(text, source, target)


# --- a service, and the ladder of repairs ----------------------------------------------------------------------------

Translator = Callable[[list[tuple[str, str]]], list[tuple[str, str]]]


def fake(rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """A deterministic stand-in: reverses words, and leaves out ids it has never been asked alone (every seventh)."""
    alone = len(rows) == 1
    return [(i, " ".join(reversed(t.split()))) for i, t in rows if alone or sum(map(ord, i)) % 7]


@dataclass(frozen=True)
class Service:
    """A service as configuration: what it is called, can do and where it is; ``translate`` does the work."""

    name: str
    translate: Translator = fake
    base_url: str = ""
    model: str = ""
    explains: bool = False
    takes_budget: bool = False
    local: bool = False


SERVICES: dict[str, Service] = {"stand-in": Service("stand-in", explains=True, takes_budget=True, local=True)}


def register(service: Service) -> None:
    """Make a service known by its name."""
    SERVICES[service.name] = service


def explain(service: Service, text: str, most: int = 2000) -> str | None:
    """Services that can, on at most ``most`` characters."""
    return service.translate([("explain", text[:most])])[0][1] if service.explains and text else None


def batch_answer(data: object, expected: int) -> list[str]:
    """The three shapes of a batch answer: list of strings, list of [text, language], or a single string; another count is an error."""
    rows = [data] if isinstance(data, str) else [r[0] if isinstance(r, list) else r for r in data] if isinstance(data, list) else []
    if len(rows) != expected or not all(isinstance(r, str) for r in rows):
        raise ValueError(f"{len(rows)} answers for {expected} texts")
    return rows


@F.pandas_udf(T.ArrayType(T.StringType()))
def batch_answers_udf(raw: pd.Series, expected: pd.Series) -> pd.Series:
    """S17 over JSON texts; null for a wrong count or no JSON."""

    def one(r, n):
        try:
            return batch_answer(json.loads(r), n)
        except (TypeError, ValueError):
            return None

    return pd.Series([one(r, n) for r, n in zip(raw, expected)], dtype=object)


def bounded(tasks: list, work: Callable, most: int = 4) -> list:
    """Results in the order of ``tasks``, at most ``most`` at once; the first failure ends it."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(most) as pool:
        return list(pool.map(work, tasks))


def call(batches: DataFrame, translator: Translator) -> DataFrame:
    """One request a batch: (batch, id, text) to (id, text); each batch is bounded by the planner."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(translator(list(zip(batch["id"], batch["text"]))), columns=["id", "text"])

    return batches.select("batch", "id", "text").groupBy("batch").applyInPandas(run, "id string, text string")


def ladder(blocks: DataFrame, translator: Translator = fake, rounds: tuple[int, ...] = (24, 24, 4, 1)) -> DataFrame:
    """Batches, then what is missing again, then in fours, then singly: (id, text, round).

    Every round anti-joins what has been answered. Identical texts are asked once (S10) and joined back."""
    unique = blocks.groupBy("text").agg(F.min("id").alias("id"))
    done, left = None, unique
    for n, size in enumerate(rounds):
        batch = F.floor((F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")) - 1) / size)
        asked = left.withColumn("batch", F.concat_ws("-", F.pmod(F.xxhash64("id"), F.lit(64)), batch))
        got = call(asked, translator).withColumn("round", F.lit(n)).filter(F.length("text") > 0).dropDuplicates(["id"])
        done = got if done is None else done.unionByName(got)
        left = unique.join(done.select("id"), "id", "left_anti")
    answers = unique.select(F.col("text").alias("source"), "id").join(done, "id").select("source", "text", "round")
    return blocks.select("id", F.col("text").alias("source")).join(answers, "source").select("id", "text", "round")


def breaker(pages: DataFrame) -> DataFrame:
    """Pages with over a quarter missing after a retry, the first time each."""
    w = Window.partitionBy("doc_id", "page").orderBy("attempt")
    broken = pages.filter(F.col("missing") > 0.25 * F.col("expected"))
    return broken.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")

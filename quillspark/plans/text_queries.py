"""Queries for text rules and scalar functions: one an operator, each with a SQL twin written for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..functions.regex import SPACE, re2
from . import snippets

_T = rf"regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def _like(text: str, pattern: str, i: bool = False) -> str:
    return f"regexp_matches({text}, {re2(pattern, i)})"


def _count(text: str, pattern: str, i: bool = False) -> str:
    return f"len(regexp_extract_all({text}, {re2(pattern, i)}))"


def _words(text: str, test: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, {re2(chr(92) + 's+')}), lambda w: {test}))"


_CASES = " ".join(
    f"WHEN {test} THEN '{name}'"
    for name, test in (
        ("empty", "t = ''"),
        ("label", f"{_like('t', X.META_LABEL, True)} AND n < 700"),
        ("banner", f"n < 40 AND {_like('t', X.ARTICLE_BANNER, True)}"),
        ("grant", f"{_like('t', X.GRANT, True)} AND n < 700"),
        ("licence", f"{_like('t', X.LICENSE_TAIL, True)} AND n < 700"),
        ("marks", f"n < 40 AND {_like('t', X.ORPHAN_MARKS)}"),
        ("notes", f"{_like('t', X.AUTHOR_NOTES, True)} AND n < 300"),
        ("degrees", f"{_count('t', X.DEGREES)} >= 3 AND n < 900"),
        ("dates", _like("t", X.RECEIVED, True)),
        ("copyright", _like("t", X.COPYRIGHT, True)),
        ("correspondence", _like("t", X.CORRESPONDENCE, True)),
        ("doi", f"{_like('t', X.DOI_URL, True)} AND n < 220"),
        ("authors", "authors"),
        ("affiliation", "affiliation"),
    )
)


def _authors(t: str) -> str:
    bare = f"regexp_replace({t}, {re2(chr(92) + 'b[A-Z]' + chr(92) + '.')}, '', 'g')"
    letters = _words(t, "regexp_matches(w, '[a-zA-Z]')")
    names = _words(t, f"regexp_matches(w, '[a-zA-Z]') AND {_like('w', X.NAME_LIKE)}")
    return f"(length({t}) BETWEEN 12 AND 420 AND NOT {_like(f'substr({bare}, 1, greatest(length({bare}) - 6, 0))', '[.!?。][' + chr(92) + 's]')} AND {_count(t, ',')} >= 2 AND {letters} >= 4 AND {_like(t, '[*†‡§]|' + chr(92) + 'd')} AND {names} / {letters} >= 0.66)"


def _affiliation(t: str) -> str:
    return f"(length({t}) <= 600 AND ({_like(t, X.AFFILIATION_HEAD, True)} OR ({_count(t, X.INSTITUTION, True)} >= 2 AND {_count(t, ',')} >= 3)))"


_MARKS = X.CELL_MARKS
_NAMES = f"list_filter(list_transform(regexp_split_to_array(replace(t, ' and ', ', '), {re2(',|;|' + chr(92) + 'band' + chr(92) + 'b')}), lambda w: regexp_replace(w, '^[{SPACE}*†‡§,;]+|[{SPACE}*†‡§,;]+$', '', 'g')), lambda w: w <> '')"
_SURFACE = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"


def _redacted(sql: str) -> str:
    for pattern, i, keep in X.SECRETS:
        sql = f"regexp_replace({sql}, {re2(pattern, i)}, '{keep.replace('$', chr(92))}{X.REDACTED}', 'g')"
    return sql


def _escaped(sql: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        sql = f"replace({sql}, '{a}', '{b}')"
    return sql


#: name: (column, SQL over t = trimmed text, n = its length, text)
PREDICATES: dict[str, tuple] = {
    "f04_boilerplate": (T.boilerplate, f"t <> '' AND n <= 180 AND {_like('t', X.BOILERPLATE, True)}"),
    "f06_author_list": (T.author_list, _authors("text")),
    "f07_degree_roster": (T.degree_roster, f"{_count('text', X.DEGREES)} >= 3"),
    "f08_affiliation": (T.affiliation, _affiliation("text")),
    "f11_metadata_reason": (T.metadata_reason, f"CASE {_CASES} END"),
    "f13_tabular": (T.tabular, f"t <> '' AND n <= 160 AND (({_count('t', '[A-Za-z' + chr(92) + 'x{4e00}-' + chr(92) + 'x{9fff}]')} = 0 AND {_count('t', _MARKS)} > 0) OR (n <= 80 AND {_like('t', '[0-9]')} AND {_count('t', _MARKS)} >= greatest(3, n * 0.3)) OR ({_words('t', chr(119) + ' <> ' + chr(39) * 2)} <= 3 AND {_like('t', '[' + chr(92) + 'd%±<>=/]')} AND n <= 40))"),
    "f14_ends_sentence": (T.ends_sentence, _like("t", X.ENDS_SENTENCE)),
    "f14_starts_continuation": (T.starts_continuation, _like("t", X.STARTS_CONTINUATION)),
    "f15_leader_dots": (T.leader_dots, _like("text", X.LEADER_DOTS)),
    "f15_list_start": (T.list_start, _like("t", X.LIST_START)),
    "f15_ordered_list": (T.ordered_list_start, f"NOT {_like('t', X.SECTION_PREFIX)} AND {_like('t', X.ORDERED_LIST)}"),
    "f15_section_number": (T.section_number, _like("t", X.SECTION_NUMBER)),
    "f22_bare_label": (T.bare_label, _like("t", X.BARE_LABEL, True)),
    "f25_formula_run": (T.formula_run, f"n >= 3 AND ({_like('t', X.MATH_SYMBOL)} OR ({_count('t', X.OPERATOR)} >= 3 AND {_count('t', X.OPERATOR)} >= {_count('t', '[a-zA-Z' + chr(92) + 'x{4e00}-' + chr(92) + 'x{9fff}]')} / 2 AND {_words('t', 'regexp_matches(w, ' + chr(39) + '^[a-zA-Z]{3,}$' + chr(39) + ')')} <= 1))"),
    "f27_english_words": (T.english_words, f"{_count('text', X.ENGLISH_WORD)}::INTEGER"),
    "f27_han_chars": (T.han_chars, f"{_count('text', X.HAN)}::INTEGER"),
    "f28_data_dense": (T.data_dense, f"{_count('text', '[A-Za-z]')} = 0 OR {_count('text', '[0-9]')} >= greatest(6, floor({_count('text', '[A-Za-z]')} * 0.35))"),
    "f29_english_prose": (T.english_prose, f"t <> '' AND NOT {_like('t', '@|https?://')} AND {_count('t', X.ENGLISH_WORD)} >= 6 AND {_count('t', '[A-Za-z]')} >= 30"),
    "f30_name_list": (T.name_list, f"t <> '' AND n <= 240 AND NOT {_like('t', '@|https?://')} AND len({_NAMES}) >= 3 AND len(list_filter({_NAMES}, lambda w: len(regexp_extract_all(w, {re2(X.AUTHOR_TOKEN)})) BETWEEN 2 AND 5)) >= greatest(3, len({_NAMES}) - 1)"),
    "x16_surface": (T.surface, _SURFACE),
    "x19_redact": (T.redact, _redacted("text")),
    "x20_escape_html": (T.escape_html, _escaped("text")),
    "x25_file_part": (T.file_part, "substr(regexp_replace(text, '[^a-zA-Z0-9._-]', '_', 'g'), 1, 60)"),
    "w14_trailing_context": (T.trailing_context, f"right(text, {X.CONTEXT_CHARS})"),
}


def _predicate(column):
    return lambda spark, d: snippets.table(spark, d).select("doc_id", "pos", column(F.col("text")).alias("value"))


def _predicate_sql(value: str) -> str:
    return f"{snippets.sql()}, u AS (SELECT *, {_T} AS t FROM s), v AS (SELECT *, length(t) AS n, {_authors('t')} AS authors, {_affiliation('t')} AS affiliation FROM u)\nSELECT doc_id, pos, {value} AS value FROM v"


def language_profile(spark: SparkSession, d: str) -> DataFrame:
    """F01, F02, F03 over whole documents."""
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("s", T.stats(F.col("text"))).withColumn("detected", T.language(F.col("s")))
    return docs.groupBy("lang", "detected", T.default_target(F.col("detected")).alias("target"), T.source_code(F.col("detected")).alias("code")).agg(
        F.count("*").alias("documents"), F.sum("s.cjk").cast("long").alias("cjk"), F.sum("s.latin").cast("long").alias("latin"), F.sum("s.total").cast("long").alias("total")
    )


_PROFILE = f"""
WITH a AS (SELECT lang, regexp_replace(text, {re2(X.NO_SIGNAL)}, '', 'g') AS g FROM documents),
b AS (SELECT lang, {_count('g', X.CJK)} AS cjk, {_count('g', X.LATIN)} AS latin, length(g) AS total FROM a),
c AS (SELECT *, CASE WHEN total < 4 THEN 'other' WHEN cjk / greatest(1, total) >= 0.25 THEN 'zh' WHEN latin / greatest(1, total) >= 0.5 THEN 'en' ELSE 'other' END AS detected FROM b)
SELECT lang, detected, CASE WHEN detected = 'zh' THEN 'en' ELSE 'zh-CN' END AS target, CASE WHEN detected IN ('zh', 'en') THEN detected ELSE 'auto' END AS code,
  count(*) AS documents, sum(cjk)::BIGINT AS cjk, sum(latin)::BIGINT AS latin, sum(total)::BIGINT AS total FROM c GROUP BY ALL"""


def language_of_snippets(spark: SparkSession, d: str) -> DataFrame:
    """F02 over snippets, which have Han text."""
    return snippets.table(spark, d).select("doc_id", "pos", T.language(T.stats(F.col("text"))).alias("value"))


_SNIPPET_LANGUAGE = f"""{snippets.sql()}, a AS (SELECT doc_id, pos, regexp_replace(text, {re2(X.NO_SIGNAL)}, '', 'g') AS g FROM s),
b AS (SELECT doc_id, pos, {_count('g', X.CJK)} AS cjk, {_count('g', X.LATIN)} AS latin, length(g) AS total FROM a)
SELECT doc_id, pos, CASE WHEN total < 4 THEN 'other' WHEN cjk / greatest(1, total) >= 0.25 THEN 'zh' WHEN latin / greatest(1, total) >= 0.5 THEN 'en' ELSE 'other' END AS value FROM b"""


def truncation(spark: SparkSession, d: str) -> DataFrame:
    """each document against a cut of itself, of a length that depends on its id."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    cut = F.substring("text", F.lit(1), (F.length("text") * (F.pmod("doc_id", F.lit(5)) + 1) / 20).cast("int"))
    return docs.select("doc_id", T.truncated(F.col("text"), cut).alias("value"))


_TRUNCATION = f"""WITH a AS (SELECT doc_id, {_T} AS s, regexp_replace(substr(text, 1, (length(text) * (doc_id % 5 + 1) // 20)::INT), '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS t FROM documents)
SELECT doc_id, length(s) >= 200 AND t <> '' AND length(t) / length(s) < 0.15 AS value FROM a"""


def joined_lines(spark: SparkSession, d: str) -> DataFrame:
    """The snippets of a document joined again, in order."""
    s = snippets.table(spark, d).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("lines"))
    return s.select("doc_id", T.join_lines(F.col("lines")).alias("value"))


def _join_sql() -> str:
    a, b = f"regexp_replace(x, '[{SPACE}]+$', '')", f"regexp_replace(y, '^[{SPACE}]+', '')"
    hyphen = f"regexp_matches({a}, '[A-Za-z][{X.HYPHENS[1:]}-]$') AND regexp_matches({b}, '^[A-Za-z]')"
    cjk = f"regexp_matches({a}, '{X.CJK_EDGE}$') AND regexp_matches({b}, '^{X.CJK_EDGE}')"
    step = f"CASE WHEN x = '' THEN y WHEN y = '' THEN x WHEN {hyphen} THEN {a}[:-2] || {b} WHEN {cjk} THEN {a} || {b} ELSE {a} || ' ' || {b} END"
    return f"""{snippets.sql()}, g AS (SELECT doc_id, list(text ORDER BY pos) AS l FROM s GROUP BY doc_id)
SELECT doc_id, regexp_replace(regexp_replace(list_reduce(l, lambda x, y: {step}), '[{SPACE}]+', ' ', 'g'), '^ | $', '', 'g') AS value FROM g"""


def errors(spark: SparkSession, d: str) -> DataFrame:
    """S18 / P12 / M15 / M16 / S19 over events: status, message and address derived from the row."""
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.pmod("event_id", F.lit(11))
    status = F.element_at(F.array(*[F.lit(x) for x in (0, 400, 401, 403, 404, 402, 429, 429, 500, 503, 418)]), (k + 1).cast("int"))
    body = F.element_at(F.array(*[F.lit(x) for x in ("", "bad model", "unsupported value", "insufficient quota", "slow down", "AbortError", "request timed out", "ECONNREFUSED", "dns")]), (F.pmod("event_id", F.lit(9)) + 1).cast("int"))
    url = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("https://api.example.com/", "http://127.0.0.1:11017", "http://example.org/v1//", " https://localhost/x ")]), (F.pmod("event_id", F.lit(4)) + 1).cast("int")))
    code = T.error_code(status, body)
    return e.select(
        "event_id", code.alias("code"), T.retryable(code).alias("retryable"), T.failure_code(F.lit(""), body).alias("failure"), T.timeout_ms(F.col("user_id") * 10, F.lit(60_000)).cast("long").alias("timeout_ms"),
        T.chat_url(url).alias("url"), T.endpoint_allowed(F.trim(url), F.pmod("event_id", F.lit(2)) == 0, F.pmod("event_id", F.lit(3)) == 0).alias("allowed"),
        T.backoff_ms(F.lit(500.0), F.pmod("event_id", F.lit(4)), F.lit(0.5), F.when(k == 6, 1000)).alias("backoff_ms"),
    )


_ERRORS = """
WITH a AS (SELECT event_id, user_id, event_id % 11 AS k, ([0, 400, 401, 403, 404, 402, 429, 429, 500, 503, 418])[event_id % 11 + 1] AS status,
  (['', 'bad model', 'unsupported value', 'insufficient quota', 'slow down', 'AbortError', 'request timed out', 'ECONNREFUSED', 'dns'])[event_id % 9 + 1] AS body,
  (['https://api.example.com/', 'http://127.0.0.1:11017', 'http://example.org/v1//', ' https://localhost/x '])[event_id % 4 + 1] AS url FROM events),
b AS (SELECT *, CASE WHEN status <= 0 THEN 'NETWORK' WHEN status IN (401, 403) THEN 'INVALID_API_KEY' WHEN status = 404 THEN 'INVALID_MODEL'
  WHEN status = 429 AND body ILIKE '%quota%' THEN 'QUOTA_EXCEEDED' WHEN status = 429 THEN 'RATE_LIMITED' WHEN status = 400 AND body ILIKE '%unsupported value%' THEN 'UNKNOWN'
  WHEN status = 400 AND body ILIKE '%model%' THEN 'INVALID_MODEL' WHEN status = 402 THEN 'QUOTA_EXCEEDED' WHEN status >= 500 THEN 'NETWORK' ELSE 'UNKNOWN' END AS code,
  regexp_extract(trim(url), '^(\\w+)://([^/:]+)', 1) AS scheme, regexp_extract(trim(url), '^(\\w+)://([^/:]+)', 2) AS host FROM a)
SELECT event_id, code, code IN ('NETWORK', 'TIMEOUT', 'RATE_LIMITED') AS retryable,
  CASE WHEN body ILIKE '%abort%' THEN 'CANCELLED' WHEN body ILIKE '%timed out%' THEN 'TIMEOUT' WHEN body ILIKE '%refused%' OR body ILIKE '%dns%' THEN 'NETWORK' ELSE 'UNKNOWN' END AS failure,
  least(120000, greatest(60000, 20000 + 12 * user_id * 10))::BIGINT AS timeout_ms, regexp_replace(trim(url), '/+$', '') || '/chat/completions' AS url,
  host IN ('localhost', '127.0.0.1') OR (event_id % 3 <> 0 AND (scheme = 'https' OR (scheme = 'http' AND event_id % 2 = 0))) AS allowed,
  CASE WHEN k = 6 THEN 1000.0::DOUBLE ELSE 500.0::DOUBLE * pow(2.0, event_id % 4 - 1) * (0.75 + 0.5 * 0.5) END AS backoff_ms FROM b""".replace("\\\\", "\\")

_QUERIES = {
    "f02_language_profile": (language_profile, _PROFILE),
    "f02_detect_language": (language_of_snippets, _SNIPPET_LANGUAGE),
    "f31_truncated": (truncation, _TRUNCATION),
    "x08_join_fragments": (joined_lines, _join_sql()),
    "s18_error_policy": (errors, _ERRORS),
}


def queries() -> dict:
    return {name: _predicate(c) for name, (c, _) in PREDICATES.items()} | {name: q for name, (q, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: _predicate_sql(s) for name, (_, s) in PREDICATES.items()} | {name: s for name, (_, s) in _QUERIES.items()}


__all__ = ["Column", "oracle_sql", "queries"]

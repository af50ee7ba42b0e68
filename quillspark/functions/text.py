"""Text predicates and scalar functions as Spark columns; the survey's identifiers are in the docstrings."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from . import regex as R


def stats(text: Column) -> Column:
    """struct of signal-carrying characters: cjk, latin, total."""
    signal = R.replace(text, X.NO_SIGNAL, "")
    return F.struct(R.count(signal, X.CJK).alias("cjk"), R.count(signal, X.LATIN).alias("latin"), F.length(signal).alias("total"))


def language(s: Column) -> Column:
    """F02 of a struct of F01: zh, en (Latin script) or other."""
    share = lambda part: s[part] / F.greatest(s["total"], F.lit(1))
    return F.when(s["total"] < X.LEAST_LETTERS, "other").when(share("cjk") >= X.CJK_SHARE, "zh").when(share("latin") >= X.LATIN_SHARE, "en").otherwise("other")


def default_target(detected: Column) -> Column:
    """what a language is turned into by default."""
    return F.when(detected == "zh", "en").otherwise("zh-CN")


def source_code(detected: Column) -> Column:
    """code that services take."""
    return F.when(detected.isin("zh", "en"), detected).otherwise("auto")


def boilerplate(text: Column) -> Column:
    """publisher boilerplate line."""
    t = R.trim(text)
    return (t != "") & (F.length(t) <= 180) & R.like(t, X.BOILERPLATE, True)


def author_list(text: Column) -> Column:
    """a roster of names with marks."""
    bare = R.replace(text, r"\b[A-Z]\.", "")

    def names(tokens: Column) -> Column:
        return (F.size(tokens) >= 4) & (F.size(F.filter(tokens, lambda t: R.like(t, X.NAME_LIKE))) / F.size(tokens) >= 0.66)

    tokens = F.filter(R.split(text, r"\s+"), lambda t: R.like(t, "[a-zA-Z]"))
    return F.length(text).between(12, 420) & R.like(text, "(?s),.*,") & R.like(text, r"[*†‡§]|\d") & ~R.let(bare, lambda b: R.like(F.substring(b, F.lit(1), F.greatest(F.length(b) - 6, F.lit(0))), r"[.!?。][\s]")) & R.let(tokens, names)


def degree_roster(text: Column) -> Column:
    """F07."""
    return R.count(text, X.DEGREES) >= 3


def affiliation(text: Column) -> Column:
    """F08."""
    return (F.length(text) <= 600) & (R.like(text, X.AFFILIATION_HEAD, True) | (R.like(text, "(?s),.*,.*,") & (R.count(text, X.INSTITUTION, True) >= 2)))


def metadata_reason(text: Column, sliver: Column | None = None, sidebar: Column | None = None) -> Column:
    """first rule that makes a block front matter, or null. The geometric rules come as columns, if there are any."""
    no = F.lit(False)
    return R.let(R.trim(text), lambda t: _reason(t, F.length(t), no if sliver is None else sliver, no if sidebar is None else sidebar))


def _reason(t: Column, n: Column, sliver: Column, sidebar: Column) -> Column:
    return (
        F.when(t == "", "empty")
        .when(sliver, "sliver")
        .when(sidebar & (n < 700), "sidebar")
        .when((n < 700) & R.like(t, X.META_LABEL, True), "label")
        .when((n < 40) & R.like(t, X.ARTICLE_BANNER, True), "banner")
        .when((n < 700) & R.like(t, X.GRANT, True), "grant")
        .when((n < 700) & R.like(t, X.LICENSE_TAIL, True), "licence")
        .when((n < 40) & R.like(t, X.ORPHAN_MARKS), "marks")
        .when((n < 300) & R.like(t, X.AUTHOR_NOTES, True), "notes")
        .when((n < 900) & degree_roster(t), "degrees")
        .when(R.like(t, r"(?:19|20)\d\d") & R.like(t, X.RECEIVED, True), "dates")
        .when(R.like(t, X.COPYRIGHT, True), "copyright")
        .when(R.like(t, X.CORRESPONDENCE, True), "correspondence")
        .when((n < 220) & R.like(t, X.DOI_URL, True), "doi")
        .when(author_list(t), "authors")
        .when(affiliation(t), "affiliation")
    )


def tabular(text: Column) -> Column:
    """F13."""
    t = R.trim(text)
    n, marks = F.length(t), R.count(t, X.CELL_MARKS)
    words = F.size(F.filter(R.split(t, r"\s+"), lambda w: w != ""))
    return (t != "") & (n <= 160) & (((R.count(t, r"[A-Za-z\x{4e00}-\x{9fff}]") == 0) & (marks > 0)) | ((n <= 80) & R.like(t, "[0-9]") & (marks >= F.greatest(F.lit(3.0), n * 0.3))) | ((words <= 3) & R.like(t, r"[\d%±<>=/]") & (n <= 40)))


def ends_sentence(text: Column) -> Column:
    """F14."""
    return R.like(R.trim(text), X.ENDS_SENTENCE)


def starts_continuation(text: Column) -> Column:
    """F14."""
    return R.like(R.trim(text), X.STARTS_CONTINUATION)


def leader_dots(text: Column) -> Column:
    """F15."""
    return R.like(text, X.LEADER_DOTS)


def list_start(text: Column) -> Column:
    """F15."""
    return R.like(R.trim(text), X.LIST_START)


def ordered_list_start(text: Column) -> Column:
    """a section number such as 1.1 is none."""
    t = R.trim(text)
    return ~R.like(t, X.SECTION_PREFIX) & R.like(t, X.ORDERED_LIST)


def section_number(text: Column) -> Column:
    """F15."""
    return R.like(R.trim(text), X.SECTION_NUMBER)


def bold_font(name: Column) -> Column:
    """F16: a light weight rules bold out, unless it is named as well."""
    n = F.lower(F.coalesce(name, F.lit("")))
    return R.like(n, X.BOLD_FONT) & ~(R.like(n, X.LIGHT_FONT) & ~R.like(n, "bold|black|heavy"))


def bare_label(text: Column) -> Column:
    """F22."""
    return R.like(R.trim(text), X.BARE_LABEL, True)


def shard(text: Column, kind: Column) -> Column:
    """a piece of body text that can't stand alone: a bare citation, a dozen characters, or what begins in lower case."""
    t = R.trim(text)
    return (kind == "paragraph") & (t != "") & ((F.length(t) <= 12) | R.like(t, "^[a-z]") | R.like(t, f"^{X.BARE_CITATION}$"))


def overlayable(kind: Column) -> Column:
    """what an overlay covers."""
    return kind.isin("paragraph", "heading")


def formula_run(text: Column) -> Column:
    """F25."""
    t = R.trim(text)
    marks, letters = R.count(t, X.OPERATOR), R.count(t, r"[a-zA-Z\x{4e00}-\x{9fff}]")
    words = F.size(F.filter(R.split(t, r"\s+"), lambda w: R.like(w, "^[a-zA-Z]{3,}$")))
    return (F.length(t) >= 3) & (R.like(t, X.MATH_SYMBOL) | ((marks >= 3) & (marks >= letters / 2) & (words <= 1)))


def english_words(text: Column) -> Column:
    """F27."""
    return R.count(text, X.ENGLISH_WORD)


def han_chars(text: Column) -> Column:
    """F27."""
    return R.count(text, X.HAN)


def data_dense(text: Column) -> Column:
    """the share is a decimal, as a double asks for a digit too few at 180, 340, 360, ... letters."""
    alpha = R.count(text, "[A-Za-z]")
    return (alpha == 0) | (R.count(text, "[0-9]") >= F.greatest(F.lit(6), F.floor(alpha * F.lit(Decimal("0.35")))))


def english_prose(text: Column, least: int | Column = 6) -> Column:
    """F29."""
    t = R.trim(text)
    return (t != "") & ~R.like(t, "@|https?://") & (english_words(t) >= least) & (R.count(t, "[A-Za-z]") >= 30)


def name_list(text: Column) -> Column:
    """author-name list in running text."""

    def listed(t: Column) -> Column:
        parts = F.transform(R.split(F.replace(t, F.lit(" and "), F.lit(", ")), r",|;|\band\b"), lambda s: R.replace(s, r"^[\s*†‡§,;]+|[\s*†‡§,;]+$", ""))
        enough = lambda p: (F.size(p) >= 3) & (F.size(F.filter(p, lambda s: R.count(s, X.AUTHOR_TOKEN).between(2, 5))) >= F.greatest(F.lit(3), F.size(p) - 1))
        # Three parts need two marks between them, and three names of two words six capitals.
        worth = R.like(t, r"(?s)(?:,|;|\band\b).*(?:,|;|\band\b)") & R.like(t, "(?s)(?:[A-ZÀ-ÖØ-Þ].*){6}")
        return (t != "") & (F.length(t) <= 240) & worth & ~R.like(t, "@|https?://") & R.let(F.filter(parts, lambda s: s != ""), enough)

    return R.let(R.trim(text), listed)


def truncated(source: Column, text: Column) -> Column:
    """F31."""
    s, t = R.trim(source), R.trim(text)
    return (F.length(s) >= X.TRUNCATED_SOURCE) & (t != "") & (F.length(t) / F.length(s) < X.TRUNCATED_SHARE)


def surface(text: Column) -> Column:
    """Lower-case letters and digits, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def risk_score(masked: Column, prose: Column, tokens: Column) -> Column:
    """additive risk of masked text; ``prose`` is it without its tokens."""
    p = R.trim(R.replace(prose, r"\s+", " "))
    low, n, dense = F.lower(p), F.length(masked), tokens / F.greatest(F.length(masked), F.lit(1))
    phrase = F.lit(False)
    for x in X.RISK_PHRASES:
        phrase = phrase | low.contains(x)
    first = F.instr(masked, "⟦PM") - 1
    last = n - F.instr(F.reverse(masked), "MP⟦") - 2
    points = [(phrase, 3), (tokens >= 4, 2), (tokens >= 8, 2), (F.length(p) >= 180, 1), (dense >= 0.015, 1), (dense >= 0.03, 1), ((first >= 0) & (first <= n * 0.15), 1), ((first >= 0) & (last < n - 24), 1)]
    total = F.lit(0)
    for test, value in points:
        total = total + F.when(test, value).otherwise(0)
    return total


def formula_dense(score: Column, tokens: Column) -> Column:
    """F38."""
    return (tokens >= 4) & (score >= 6)


def slow_lane(kind: Column, chars: Column, tokens: Column, dense: Column) -> Column:
    """F39."""
    return (kind == "table") | (chars > 2400) | (tokens >= 5) | dense


def join_fragments(left: Column, right: Column) -> Column:
    """De-hyphenate between Latin letters, no space between ideographs."""
    a, b = R.replace(left, r"\s+$", ""), R.replace(right, r"^\s+", "")
    hyphen = R.like(a, f"[A-Za-z][{X.HYPHENS[1:]}-]$") & R.like(b, "^[A-Za-z]")
    joined = F.when(hyphen, F.concat(F.substring(a, F.lit(1), F.length(a) - 1), b)).when(R.like(a, X.CJK_EDGE + "$") & R.like(b, "^" + X.CJK_EDGE), F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))
    return F.when(F.coalesce(left, F.lit("")) == "", right).when(F.coalesce(right, F.lit("")) == "", left).otherwise(joined)


def join_lines(lines: Column) -> Column:
    """An ordered array of lines as one text. What divides two lines depends on these two alone, so it is decided for neighbours, in
    time that is linear in the text; blank lines don't count."""
    t = F.filter(F.transform(lines, R.trim), lambda x: x != "")
    following = F.concat(F.slice(t, 2, F.greatest(F.size(t), F.lit(1))), F.array(F.lit(None).cast("string")))

    def with_end(x: Column, after: Column) -> Column:
        hyphen = R.like(x, f"[A-Za-z][{X.HYPHENS[1:]}-]$") & R.like(after, "^[A-Za-z]")
        cjk = R.like(x, X.CJK_EDGE + "$") & R.like(after, "^" + X.CJK_EDGE)
        return F.when(after.isNull() | cjk, x).when(hyphen, F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(F.concat(x, F.lit(" ")))

    return R.replace(F.array_join(F.zip_with(t, following, with_end), ""), r"\s+", " ")


def escape_html(text: Column) -> Column:
    """X20."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape_html(text: Column) -> Column:
    """X20, in the order that undoes double escapes once."""
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def file_part(text: Column) -> Column:
    """Safe part of a file name."""
    return F.substring(F.regexp_replace(text, "[^a-zA-Z0-9._-]", "_"), 1, 60)


def redact(text: Column, registered: list[str] | None = None) -> Column:
    """Registered secrets first, then the patterns; a header's name stays."""
    for secret in registered or []:
        if len(secret) >= 4:
            text = F.replace(text, F.lit(secret), F.lit(X.REDACTED))
    for pattern, i, keep in X.SECRETS:
        text = R.replace(text, pattern, keep + X.REDACTED, i)
    return text


def error_code(status: Column, body: Column) -> Column:
    """HTTP status and body to an error code."""
    b = F.substring(F.coalesce(body, F.lit("")), 1, 200)
    return (
        F.when(~F.coalesce(status > 0, F.lit(False)), "NETWORK")
        .when(status.isin(401, 403), "INVALID_API_KEY")
        .when(status == 404, "INVALID_MODEL")
        .when((status == 429) & R.like(b, X.QUOTA, True), "QUOTA_EXCEEDED")
        .when(status == 429, "RATE_LIMITED")
        .when((status == 400) & R.like(b, X.REJECTED, True), "UNKNOWN")
        .when((status == 400) & R.like(b, "model", True), "INVALID_MODEL")
        .when(status == 402, "QUOTA_EXCEEDED")
        .when(status >= 500, "NETWORK")
        .otherwise("UNKNOWN")
    )


def retryable(code: Column) -> Column:
    """What may succeed another time."""
    return code.isin("NETWORK", "TIMEOUT", "RATE_LIMITED")


def failure_code(name: Column, message: Column) -> Column:
    """Transport failures by their words."""
    return (
        F.when((name == "AbortError") | R.like(message, "abort", True), "CANCELLED")
        .when(R.like(message, "timeout|timed out", True), "TIMEOUT")
        .when(R.like(F.concat(message, name), X.NETWORK, True), "NETWORK")
        .otherwise("UNKNOWN")
    )


def endpoint_allowed(url: Column, insecure: Column, local_only: Column) -> Column:
    """Other than HTTPS only to this machine or by choice; with local_only nothing else."""
    host, scheme = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    local = F.coalesce(host.isin("localhost", "127.0.0.1", "::1", "[::1]"), F.lit(False))
    return host.isNotNull() & (local | (~local_only & ((scheme == "https") | ((scheme == "http") & insecure))))


def base_url(url: Column) -> Column:
    """No white space around, no slashes at the end."""
    return R.replace(R.trim(url), "/+$", "")


def chat_url(url: Column) -> Column:
    """The completion endpoint under a base address."""
    u = base_url(url)
    return F.when(R.like(u, "/chat/completions$"), u).otherwise(F.concat(u, F.lit("/chat/completions")))


def timeout_ms(chars: Column, configured: Column) -> Column:
    """M15."""
    return F.least(F.lit(120_000), F.greatest(configured, 20_000 + 12 * chars))


def backoff_ms(base: Column, attempt: Column, jitter: Column, retry_after: Column) -> Column:
    """Jitter in 0..1 is given, so that results can be repeated."""
    return F.coalesce(retry_after.cast("double"), base * F.pow(F.lit(2.0), attempt - 1) * (0.75 + 0.5 * jitter))


def context_bleed(source_words: Column, text: Column, had_context: Column) -> Column:
    """far more Han characters than the source can account for."""
    return had_context & (source_words >= 8) & (R.count(text, X.HAN_WIDE) > F.greatest(F.lit(80.0), source_words * 2.4))


def trailing_context(text: Column) -> Column:
    """The last characters of a chunk."""
    return F.when(F.length(text) <= X.CONTEXT_CHARS, text).otherwise(F.substring(text, F.greatest(F.length(text) - X.CONTEXT_CHARS + 1, F.lit(1)), F.lit(X.CONTEXT_CHARS)))

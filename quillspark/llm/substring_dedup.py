"""Substring dedup by De Bruijn compaction.

Nodes of the graph are runs of ``K`` - 1 words, edges windows of ``K`` words from one node to the next; both are known by a hash, an edge's beginning with its node's.
(1) Every task hashes its windows with numpy and sends each edge (edge, word before it, document, position) to its node's part, packed: the parts of a task's message are
arrays, 12 bytes a window. Of documents that share an edge within a task only the smallest is sent on, as the others are repeated for certain; so a passage that a
third of all documents have costs a part one entry a task. (2) A part sorts its edges and finds those that start in several documents; the smallest document is the
edge's source. Of the repeated edges it counts those that leave and enter each node: over one of either and the node branches. (3) Repeated edges return to their documents,
where edges that follow one another in the document and in the source, with no branching node between, form one nonbranching path: (doc, start, length, source, source
start). (4) Paths that meet end to end, whatever their sources, compact into long spans by Spark joins with pointer doubling. (5) Source coordinates verify the spans'
paths: a document is asked only for prefix hashes at points of its own, which are no more than its words, so that a much-copied document has no long list; two
points give the hash of the words between them, which must be that of the path in the document that repeats them. Texts shuffle once.

A window of a document is repeated if its words also start in a document with a smaller doc_id, judged on the input; all words of repeated windows go.
A path that fails verification (a collision of hashes) is left out, and its document done again without it.

Defined cases: null or blank text has no words; fewer than ``K`` words: no window; a null doc_id counts as larger than any id, so such rows lose what
others have and never serve as source; rows with equal ids don't count against each other; of several places of a window in its source the first counts; an empty table
gives an empty result; a text of any length is handled whole (its windows are arrays of numbers); extra columns of any name pass through :func:`remove`."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K, CHUNK, LAST, NODE = 13, 1_000_000, (1 << 63) - 1, 40
_REST = np.uint64((1 << (64 - NODE)) - 1)


def tag(text: bytes) -> int:
    """Tells rows with one doc_id and different texts apart."""
    return zlib.crc32(text) >> 1


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def nodes(code: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes."""
    n = len(code) - size + 1
    h = np.zeros(max(0, n), np.uint64)
    for j in range(size):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= code[j : j + len(h)]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def edges(code: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of each window of k word hashes: ``NODE`` bits of its first k - 1 words, and the rest of all of them."""
    node = nodes(code[:-1], k - 1)
    last = (node ^ (code[k - 1 :] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
    return (node & ~_REST) | (last >> np.uint64(NODE))


def block_of(doc: np.ndarray, blocks: int) -> np.ndarray:
    return ((doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks


def _split(key: np.ndarray, n: int):
    """Index arrays of each key 0 .. n-1 that occurs, in stable order."""
    order = np.argsort(key, kind="stable")
    cuts = np.searchsorted(key[order], np.arange(n + 1))
    for i in range(n):
        if cuts[i] < cuts[i + 1]:
            yield i, order[cuts[i] : cuts[i + 1]]


def branching(h: np.ndarray, before: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For repeated edges sorted by hash (``first`` of each kind): whether the node they leave has over one such edge out, or over one in.

    An edge into the node is a word before it that at least two of the entries have (0: none)."""
    node = h & ~_REST
    heads = np.flatnonzero(first)
    starts = np.append(True, node[1:] != node[:-1]) if len(node) else first
    of = np.cumsum(starts) - 1
    kinds = np.bincount(of[heads], minlength=of[-1] + 1 if len(of) else 0)
    o = np.lexsort((before, of))
    pair = of[o].astype(np.int64) << 16 | before[o]
    new = np.append(True, pair[1:] != pair[:-1]) if len(pair) else first
    at = np.flatnonzero(new)
    entering = (np.diff(np.append(at, len(pair))) > 1) & ((pair[at] & 0xFFFF) > 0)
    into = np.bincount((pair[at] >> 16)[entering], minlength=len(kinds))
    return ((kinds > 1) | (into > 1))[of] if len(of) else first


def paths(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc, tag, start, n, run, source, source_tag, source_start): nonbranching paths of n repeated windows with one source and offset. ``run``: windows from here on
    with that source and offset, branches or not, on the first path of them; 0 on the others."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.col("text")).filter("text is not null")
    parts = blocks = max(2, 2 * common.partitions(docs))
    keys = common.even_keys(docs.sparkSession, parts)  # of parts, and of blocks as well

    def send(batches):
        memo = _Hashes()
        docs_, tags, codes, total = [], [], [], 0

        def flush():
            size = np.array([len(c) for c in codes], np.int64)
            code = np.concatenate(codes)
            doc, tg = np.array(docs_, np.int64), np.array(tags, np.int64)
            of = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
            h = edges(code, k)
            before = np.append(np.uint64(0), code[: len(h) - 1]).astype(np.uint16)
            before[pos[: len(h)] == 0] = 0
            whole = of[: len(h)] == of[k - 1 :]  # no window runs over the end of its document
            h, before, of, pos = h[whole], before[whole], of[: len(whole)][whole], pos[: len(whole)][whole]
            order = np.lexsort((doc[of], h)) if (np.diff(doc) < 0).any() else np.argsort(h, kind="stable")  # as a rule documents come in order
            first = np.ones(len(h), bool)
            hs = h[order]
            first[1:] = hs[1:] != hs[:-1]
            head = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
            low = order[head]  # the entry of the smallest document with the same edge
            sure = doc[of[order]] > doc[of[low]]
            mine = np.zeros(len(h), bool)
            mine[order[sure]] = True
            src = np.zeros(len(h), np.int64)
            src[order] = low
            i = np.flatnonzero(mine)
            yield from answer(doc[of[i]], tg[of[i]], pos[i] * 2, doc[of[src[i]]], tg[of[src[i]]], pos[src[i]])
            again = np.zeros(len(h), np.int64)
            again[src[i]] = 1  # known to be repeated, as documents of this task have it as well
            i = np.flatnonzero(~mine)
            part = ((h[i] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            for p, at in _split(part, parts):
                j = i[at]
                yield int(keys[p]), 0, h[j].tobytes() + before[j].tobytes(), common.pack(doc[of[j]], tg[of[j]], pos[j] * 2 + again[j])

        def answer(doc, tg, pos, src, src_tag, src_pos):
            for b, at in _split(block_of(doc, blocks), blocks):
                at = at[np.lexsort((pos[at], tg[at], doc[at]))]
                yield int(keys[b]), 1 + b, None, common.pack(doc[at], tg[at], pos[at], src[at], src_tag[at], src_pos[at])

        def batch(found):
            found = list(found)
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["part", "kind", "h", "data"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), common.text_bytes(b.column(1))):
                w = text.split()
                if len(w) < k:
                    continue
                docs_.append(doc), tags.append(tag(text)), codes.append(np.fromiter(map(memo.__getitem__, w), np.uint64, len(w)))
                total += len(w)
                if total >= CHUNK:
                    yield batch(flush())
                    docs_, tags, codes, total = [], [], [], 0
        if codes:
            yield batch(flush())

    def meet(batches):
        """One part: the edges that several documents have, sent on to the blocks of these."""
        for _, t in common.Runs(batches, "part"):
            back = [x for x in zip(t.column("kind").to_pylist(), t.column("data").to_pylist()) if x[0]]
            sent = [(h, d) for kind, h, d in zip(t.column("kind").to_pylist(), t.column("h").to_pylist(), t.column("data").to_pylist()) if not kind]
            out = [(int(keys[kind - 1]), data) for kind, data in back]
            if sent:
                h = np.concatenate([np.frombuffer(x, np.uint64, len(x) // 10) for x, _ in sent])
                before = np.concatenate([np.frombuffer(x, np.uint16, len(x) // 10, len(x) // 10 * 8) for x, _ in sent])
                doc, tg, pos = (np.concatenate(c) for c in zip(*(common.unpack(d, 3) for _, d in sent)))
                known, pos = pos & 1, pos >> 1
                order = np.argsort(h, kind="stable")
                hs = h[order]
                again = np.zeros(len(h), bool)
                again[1:] = hs[1:] == hs[:-1]
                again[:-1] |= again[1:]
                again |= known[order] > 0
                i = order[again]
                i = i[np.lexsort((pos[i], tg[i], doc[i], h[i]))]
                first = np.ones(len(i), bool)
                first[1:] = h[i[1:]] != h[i[:-1]]
                low = i[np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))] if len(i) else i
                turns = branching(h[i], before[i], first)
                later = doc[i] > doc[low]
                i, low, turns = i[later], low[later], turns[later]
                for b, at in _split(block_of(doc[i], blocks), blocks):
                    x, y = i[at], low[at]
                    s = np.lexsort((pos[x], tg[x], doc[x]))
                    x, y, t = x[s], y[s], turns[at[s]]
                    out.append((int(keys[b]), common.pack(doc[x], tg[x], pos[x] * 2 + t, doc[y], tg[y], pos[y])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["block", "data"])

    def compact(batches):
        """One block of documents: edges that follow one another become a path."""
        for _, t in common.Runs(batches, "block"):
            doc, tg, pos, src, src_tag, src_pos = (np.concatenate(c) for c in zip(*(common.unpack(d, 6) for d in t.column("data").to_pylist())))
            o = np.lexsort((pos, tg, doc))
            doc, tg, pos, src, src_tag, src_pos = (x[o] for x in (doc, tg, pos, src, src_tag, src_pos))
            turns, pos = pos & 1, pos >> 1
            start = np.ones(len(doc), bool)
            start[1:] = (doc[1:] != doc[:-1]) | (tg[1:] != tg[:-1]) | (pos[1:] != pos[:-1] + 1) | (src[1:] != src[:-1]) | (src_tag[1:] != src_tag[:-1]) | (src_pos[1:] != src_pos[:-1] + 1)
            run = np.flatnonzero(start)
            whole = np.zeros(len(doc), np.int64)
            whole[run] = np.diff(np.append(run, len(doc)))
            start |= turns > 0  # a path ends where another branches off or joins
            at = np.flatnonzero(start)
            n = np.diff(np.append(at, len(doc)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[at], tg[at], pos[at], n, whole[at], src[at], src_tag[at], src_pos[at])], ["doc", "tag", "start", "n", "run", "source", "source_tag", "source_start"])

    met = rows.mapInArrow(send, "part int, kind int, h binary, data binary").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(meet, "block int, data binary")
    met = common.materialize(met)
    out = common.materialize(met.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(compact, "doc long, tag long, start long, n long, run long, source long, source_tag long, source_start long"))
    common.drop(met)
    return out


class _Codes(dict):
    """Another hash of words than that of the windows."""

    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 13)
        return h


_BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_powers: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64, kept for the next text."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        x = np.full(max(n, 4096) * 2, base, np.uint64)
        x[0] = 1
        have = _powers[base] = np.cumprod(x)
    return have


def prefixes(words: list[bytes], memo: dict) -> np.ndarray:
    """Two polynomial hashes of the first 0, 1, .. words: differences of two, shifted back, depend only on the words between."""
    code = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    out = np.zeros((len(words) + 1, 2), np.uint64)
    for c, base in enumerate(_BASES):
        np.cumsum(code * power(base, len(words))[: len(words)], out=out[1:, c])
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out


def between(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of the words between points with prefix hashes ``a`` and ``b``, the first at ``start``."""
    back = [power(pow(x, -1, 1 << 64), int(start.max(initial=0)))[start] for x in _BASES]
    return (b - a) * np.stack(back, -1)


def spans(found: DataFrame, k: int = K, rounds: int = 6, most_rounds: int = 40) -> DataFrame:
    """(doc, tag, start, end): paths that meet end to end compacted into long spans of words, by joins.

    A path's tail is the node (doc, tag, start + n); it joins the path that starts there. Each node has one path in and one out at most, so chains
    don't branch. First ``rounds`` contractions: by a hash each path either takes its successor in or may be taken in, so that a quarter of the joints goes and the table
    shrinks. Then pointer doubling: every round doubles the stretch a path has taken in; those that another took in go at the end."""
    at = ["doc", "tag"]
    cur = common.materialize(found.select(*at, "start", (F.col("start") + F.col("n")).alias("end")).distinct())
    for r in range(rounds):
        takes = F.xxhash64(*at, "start", F.lit(r)).bitwiseAND(1) == 0
        a, b = cur.filter(takes), cur.filter(~takes).select(*at, F.col("start").alias("b"), F.col("end").alias("far"))
        met = a.withColumn("b", F.col("end")).join(b, [*at, "b"], "full")
        nxt = common.materialize(met.select(*at, F.coalesce("start", "b").alias("start"), F.coalesce("far", "end").alias("end")))
        common.drop(cur)
        cur = nxt
    for _ in range(most_rounds):  # each doubles the length, so 40 are enough for any text
        nxt = cur.select(*at, F.col("start").alias("end"), F.col("end").alias("far"))
        grown = cur.join(nxt, [*at, "end"], "left").select(*at, "start", F.coalesce("far", "end").alias("end"), F.col("far").isNotNull().alias("more"))
        grown = common.materialize(grown)
        if grown.filter("more").isEmpty():
            break
        common.drop(cur)
        cur = grown.select(*at, "start", "end")
        cur._quill_path = grown._quill_path
    else:
        raise RuntimeError(f"spans: not done after {most_rounds} rounds")
    # What lies inside a longer span of the same end has been taken in.
    return cur.groupBy(*at, "end").agg(F.min("start").alias("start")).select(*at, "start", (F.col("end") + k - 1).alias("end"))


PATH = ["start", "n", "source", "source_tag", "source_start"]


def needs(found: DataFrame, k: int) -> DataFrame:
    """(doc, tag, paths, spans, points): what each document is asked for: its own paths and the spans they compact into, and the words between which others repeat it.

    All three are bounded by the document's length. Paths that follow one another in the document and in the source are verified as one."""
    runs = found.filter("run > 0").select("doc", "tag", "start", F.col("run").alias("n"), *PATH[2:])
    own = runs.groupBy("doc", "tag").agg(F.sort_array(F.collect_list(F.struct(*PATH))).alias("paths"))
    long = spans(found, k).groupBy("doc", "tag").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    ends = F.explode(F.array(F.col("source_start"), F.col("source_start") + F.col("n") + (k - 1)))
    points = runs.select("source", "source_tag", ends.alias("point")).distinct()
    points = points.groupBy(F.col("source").alias("doc"), F.col("source_tag").alias("tag")).agg(F.collect_list("point").alias("points"))
    return own.join(long, ["doc", "tag"], "left").join(points, ["doc", "tag"], "full")


def keep_mask(n: int, start: np.ndarray, end: np.ndarray, spans: np.ndarray, bad: list | None) -> np.ndarray:
    """False for the words of long spans (rows: start, end); if some paths are bad, for those of all other paths."""
    keep = np.ones(n, bool)
    for a, b in spans.tolist() if not bad else zip(start[~np.isin(start, bad)].tolist(), end[~np.isin(start, bad)].tolist()):
        keep[a:b] = False
    return keep


_STRUCT = "array<struct<start: long, n: long, source: long, source_tag: long, source_start: long, a: long, b: long>>"


def _lists(column: pa.Array, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each row's list begins and ends among all items, and the items' fields."""
    at = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy()))
    items = column.flatten()
    return at, [(items.field(x) if names != [""] else items).to_numpy(zero_copy_only=False).astype(np.int64) for x in names]


def _listed(at: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names))


def read(rows: DataFrame, carry: list[str], extra: str, make, k: int) -> DataFrame:
    """Results of ``rows`` (carry, text, doc, tag, paths, spans, points, bad), and their hashes: told (point, a, b) and mine (paths with a, b)."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [(f.split()[0], kinds[f.split()[1]]) for f in extra.split(", ")]

    def run(batches):
        n, memo = len(carry), _Codes()
        for b in batches:
            own, found = _lists(b.column(n + 3), PATH)
            within, spans_ = _lists(b.column(n + 4), ["start", "end"])
            asked, (points,) = _lists(b.column(n + 5), [""])
            ends = found[0] + found[1] + (k - 1)
            spans_ = np.stack(spans_, 1)
            told, mine = np.zeros((len(points), 2), np.uint64), np.zeros((len(ends), 2), np.uint64)
            out = []
            for r, (text, bad) in enumerate(zip(common.text_bytes(b.column(n)), b.column(n + 6).to_pylist())):
                w = text.split()
                p, s, q = slice(own[r], own[r + 1]), slice(within[r], within[r + 1]), slice(asked[r], asked[r + 1])
                repeats = p.stop > p.start
                out.append(make(text, w, keep_mask(len(w), found[0][p], ends[p], spans_[s], bad) if repeats else None, s.stop - s.start))
                if repeats or q.stop > q.start:
                    sums = prefixes(w, memo)
                    told[q] = sums[points[q]]
                    if repeats:
                        mine[p] = between(sums[found[0][p]], sums[ends[p]], found[0][p])
            made = [pa.array([x[i] for x in out], t) for i, (_, t) in enumerate(fields)]
            told, mine = told.view(np.int64), mine.view(np.int64)
            more = [_listed(asked, [points, *told.T], ["point", "a", "b"]), _listed(own, [*found, *mine.T], [*PATH, "a", "b"])]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *made, b.column(n + 1), b.column(n + 2), *more], [*b.schema.names[:n], *[f for f, _ in fields], "__sd_doc", "__sd_tag", "__sd_told", "__sd_mine"])

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(carry)])
    return common.materialize(rows.mapInArrow(run, head + extra + f", __sd_doc long, __sd_tag long, __sd_told array<struct<point: long, a: long, b: long>>, __sd_mine {_STRUCT}"))


def unverified(done: DataFrame, k: int) -> DataFrame:
    """(source, source_tag, source_start, n, a, b) of paths whose source has other words at its coordinates. A passage that very many documents have is one row."""
    mine = done.select(F.explode("__sd_mine").alias("p")).select(*[f"p.{x}" for x in (*PATH[1:], "a", "b")]).distinct()
    told = done.select(F.col("__sd_doc").alias("source"), F.col("__sd_tag").alias("source_tag"), F.explode("__sd_told").alias("t")).select("source", "source_tag", "t.*").dropDuplicates(["source", "source_tag", "point"])
    at = lambda c, p: told.select("source", "source_tag", F.col("point").alias(c), F.col("a").alias(p + "a"), F.col("b").alias(p + "b"))
    both = mine.withColumn("source_end", F.col("source_start") + F.col("n") + (k - 1)).join(at("source_start", "s"), ["source", "source_tag", "source_start"]).join(at("source_end", "e"), ["source", "source_tag", "source_end"])

    def check(batches):
        for b in batches:
            x = {c: b.column(c).to_numpy() for c in b.schema.names}
            pair = lambda p: np.stack([x[p + "a"], x[p + "b"]], -1).view(np.uint64)
            wrong = (between(pair("s"), pair("e"), x["source_start"]) != pair("")).any(axis=1) if b.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(wrong)) for c in (*PATH[1:], "a", "b")], [*PATH[1:], "a", "b"])

    return both.select(*PATH[1:], "a", "b", "sa", "sb", "ea", "eb").mapInArrow(check, "n long, source long, source_tag long, source_start long, a long, b long")


def apply(docs: DataFrame, k: int, carry: list[str], extra: str, make) -> DataFrame:
    names = [f"__sd_c{i}" for i in range(len(carry))]  # carried columns may have any name
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)], "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(F.shiftright(F.crc32(F.col("text").cast("binary")), 1), F.lit(-1)).alias("tag"))
    found = paths(docs, k)
    asked = common.materialize(needs(found, k))
    columns = [*names, "text", "doc", "tag", "paths", "spans", "points", "bad"]
    rows = own.join(asked, ["doc", "tag"], "left")
    done = read(rows.withColumn("bad", F.lit(None).cast("array<long>")).select(*columns), names, extra, make, k)
    wrong = common.materialize(unverified(done, k))
    out = done
    if not wrong.isEmpty():  # a collision: these documents again, without the paths that aren't there
        mine = done.select("__sd_doc", "__sd_tag", F.explode("__sd_mine").alias("p")).select(F.col("__sd_doc").alias("doc"), F.col("__sd_tag").alias("tag"), "p.*")
        bad = common.materialize(mine.join(wrong, [*PATH[1:], "a", "b"], "left_semi").distinct().groupBy("doc", "tag").agg(F.collect_list("start").alias("bad")))
        again = read(rows.join(bad, ["doc", "tag"]).select(*columns), names, extra, make, k)
        out = done.join(bad.select(F.col("doc").alias("__sd_doc"), F.col("tag").alias("__sd_tag")), ["__sd_doc", "__sd_tag"], "left_anti").select(*done.columns).unionByName(again)
    made = [f.split()[0] for f in extra.split(", ")]
    return out.select(*names, *made).toDF(*carry, *made)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and n_spans (long repeated spans) of every row."""

    def make(text, w, kept, long):
        left = w if kept is None else [x for x, m in zip(w, kept.tolist()) if m]
        return len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest(), long

    return apply(docs.select("doc_id", "text"), K, ["doc_id"], "n_words long, n_removed long, kept_sha256 string, n_spans long", make)


def remove(docs: DataFrame, k: int = K) -> DataFrame:
    """``docs`` with the kept words of every text, joined by one space; texts that lose nothing stay as they are."""
    carry = [c for c in docs.columns if c != "text"]
    out = apply(docs, k, carry, "text string", lambda text, w, kept, long: ((text if kept is None else b" ".join(x for x, m in zip(w, kept.tolist()) if m)).decode("utf-8", "replace"),))
    return out.select(*docs.columns)


def repeated_spans(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc, start, end): the repeated spans of words in each document, compacted; end is exclusive."""
    return spans(paths(docs, k), k).select("doc", "start", "end")

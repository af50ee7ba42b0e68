"""Language-model scoring with Brown class-based bigrams.

P(w1 .. wn end) is the product of P(class of wi | class of the word before) * P(wi | its class). Exchange clustering gives every training word one of
``CLASSES`` classes: a word goes to the class that raises the likelihood of the training bigrams most, by its own counts of the classes before and after it.

* The at most ``HEAD`` words of the highest counts (the head) have a number each; texts are written once as numbers, and all later passes read these.
* The ``UNITS`` most frequent words move one at a time on the driver, until a sweep moves none or ``SWEEPS`` are over; all others are, class by class, fixed units there.
* Every other word of the head moves at once in a Spark pass: counts of (word, side, class) meet by word, and a word takes the class of the largest gain. The two
  steps take turns ``ROUNDS`` times.
* Words beyond the head (their table grows with the corpus and stays in Spark) then take their class the same way, from the classes of the head.

Within a class a word has (c + 0.5) / (total + 0.5 * (distinct + 1)), the last slot being for all unseen words; as these may be in any class, their classes are summed
over (forward algorithm). Transitions back off to class frequencies with ``KAPPA`` pseudo-counts; those between two words beyond the head aren't counted, but scored like all others.

The driver holds the head and one number a pair of units. Words beyond the head meet their counts by a shuffle: none of them is frequent, so no key is hot.

Tokens: words of the text with A-Z lower-cased, then one end token. Training documents: crc32(doc_id as text) mod 5 is not 1.
base_score is the unigram model of the same counts. Defined cases: null text is the end token alone; no training documents: N = V = 0, every base probability
is 1; words of equal count are ordered by their bytes, and of equal gains the class of the lowest number wins; texts of any length are scored whole; null doc_id counts as the
empty text in the hash; equal rows get equal scores; an empty table gives an empty result; extra columns don't matter."""

from __future__ import annotations

from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

HEAD, UNITS, CLASSES, SWEEPS, ROUNDS, KAPPA = 200_000, 1024, 64, 10, 2, 20.0
END = b"\n"  # no word has a line feed
STRIPES, CHUNK = 16, 4_000_000


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) over all training texts, the end token included."""

    def run(batches):
        n: Counter = Counter()

        def out():
            items = list(n.items())
            n.clear()
            for i in range(0, len(items), 50_000):
                k, v = zip(*items[i : i + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(v, pa.int64())], ["word", "n"])

        for b in batches:
            for text in common.text_bytes(b.column(0)):
                n.update(words(text))
                n[END] += 1
                if len(n) > 600_000:  # bounded memory; Spark sums the parts
                    yield from out()
        yield from out()

    return common.materialize(train.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


class Head:
    """The most frequent words, numbered by falling count and then by bytes; the end token comes last. Kept as bytes: a task makes its own dictionary."""

    def __init__(self, counts: DataFrame, most: int):
        # All words of at least a count that at most ``most`` words reach, found by a histogram of some hundred steps.
        step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
        own = counts.filter(F.col("word") != F.lit(END))
        steps = sorted(((r["s"], r["c"]) for r in own.groupBy(step.alias("s")).agg(F.count("*").alias("c")).collect()), reverse=True)
        room, lowest = most, None
        for s, c in steps:
            if c > room:
                break
            room, lowest = room - c, s
        found, n = [], np.zeros(0, np.int64)
        if lowest is not None:
            t = own.filter(step >= lowest).select("word", "n").toArrow()
            found, n = t.column("word").to_pylist(), t.column("n").to_numpy()
        order = sorted(range(len(found)), key=lambda i: (-n[i], found[i]))
        end = counts.filter(F.col("word") == F.lit(END)).first()
        self.words = b" ".join(found[i] for i in order)
        self.n = np.append(n[order].astype(np.int64), end["n"] if end else 0)
        self.size = len(order)  # the number of the end token

    def numbers(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words.split(b" "))} if self.size else {}


def encode(docs: DataFrame, head: Head, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, held_out, ids, tails): numbers of the words, -1 for one beyond the head, and those words in a row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), (common.crc_mod(id_col, 5) == 1).alias("held_out"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        get = shared.value.numbers().get
        for b in batches:
            ids, tails = [], []
            for text in common.text_bytes(b.column(3)):
                w = words(text)
                own = np.fromiter((get(x, -1) for x in w), np.int32, len(w))
                ids.append(own.tobytes())
                tails.append(b" ".join([w[i] for i in np.flatnonzero(own < 0).tolist()]))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ids, pa.binary()), pa.array(tails, pa.binary())], ["row", "doc_id", "held_out", "ids", "tails"])

    return common.materialize(rows.mapInArrow(run, f"row long, doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, ids binary, tails binary"))


def stream(column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a batch's texts in a row, the end token before, between and after them; and the texts' lengths."""
    own = [np.frombuffer(x, np.int32) for x in column.to_pylist()]
    size = np.array([len(x) for x in own], np.int64)
    every = np.concatenate(own) if own else np.zeros(0, np.int32)
    return np.insert(every, np.concatenate([[0], np.cumsum(size)]), end), size


def add_up(sent: DataFrame) -> np.ndarray:
    """Sum of arrays that tasks sent as (part, data): the parts' sums one after the other. Their number and size are parameters."""

    def run(batches):
        for part, t in common.Runs(batches, "part"):
            total = 0
            for data in t.column("data").to_pylist():
                total = total + common.unpack(data, 1)[0]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([common.pack(total)], pa.binary())], ["part", "data"])

    found = sent.repartition(STRIPES, "part").sortWithinPartitions("part").mapInArrow(run, "part int, data binary").collect()
    return np.concatenate([common.unpack(bytes(r["data"]), 1)[0] for r in sorted(found, key=lambda r: r["part"])]) if found else np.zeros(0, np.int64)


def _stripes(n: np.ndarray) -> pa.RecordBatch:
    cuts = np.array_split(n, STRIPES)
    return pa.RecordBatch.from_arrays([pa.array(range(STRIPES), pa.int32()), pa.array([common.pack(x) for x in cuts], pa.binary())], ["part", "data"])


def pair_counts(train: DataFrame, of: np.ndarray, size: int, end: int) -> np.ndarray:
    """Counts of neighbours by what ``of`` makes of a number (its last entry is for words beyond the head); the end token comes before the first word."""
    shared = train.sparkSession.sparkContext.broadcast(of.astype(np.int32))

    def run(batches):
        of, n = shared.value, np.zeros(size * size, np.int64)
        held, total = [], 0
        for b in batches:
            u = of[stream(b.column(0), end)[0]].astype(np.int64)
            held.append(u[:-1] * size + u[1:])
            total += len(u)
            if total > CHUNK // 2:
                n += np.bincount(np.concatenate(held), minlength=size * size)
                held, total = [], 0
        if held:
            n += np.bincount(np.concatenate(held), minlength=size * size)
        yield _stripes(n)

    found = add_up(train.select("ids").mapInArrow(run, "part int, data binary"))
    return (found if len(found) else np.zeros(size * size)).reshape(size, size).astype(float)


def f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(n: np.ndarray, of: np.ndarray, free: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[np.ndarray, int]:
    """New classes of units and the number of moves. Units 0 .. free-1 move, one at a time, among classes 1 .. classes-1; the others stay where ``of`` has them.

    Objective: sum of f(pair counts) - f(left) - f(right) over classes, f(x) = x log x; ``of`` may name one class more, of words without a class."""
    of = of.copy()
    every = classes + 1
    weight = n.sum(0) + n.sum(1)
    one = np.eye(every)[of]
    right, left = n @ one, n.T @ one  # counts of each unit with the class after, before it
    pair = one.T @ right
    k, moves = np.arange(every), 0
    for _ in range(sweeps):
        moved = 0
        for w in range(free):
            if not weight[w]:
                continue
            a, r, c, own = of[w], right[w].copy(), left[w].copy(), n[w, w]
            r[a] -= own
            c[a] -= own
            pair[a] -= r
            pair[:, a] -= c
            pair[a, a] -= own
            rows, cols, fp = pair.sum(1) + c, pair.sum(0) + r, f(pair)  # the other classes' sums hold w wherever it goes
            more = f(pair + r).sum(1) + f(pair + c[:, None]).sum(0) - fp.sum(1) - fp.sum(0)
            d = pair[k, k]
            more += f(d + r + c + own) - f(d) - (f(d + r) - f(d)) - (f(d + c) - f(d))
            out, into = r.sum() + own, c.sum() + own
            more -= f(rows + out) - f(rows) + f(cols + into) - f(cols)
            more[0] = more[classes] = -np.inf
            b = int(more.argmax())
            if 0 < a < classes and more[b] <= more[a] + 1e-9:
                b = a
            pair[b] += r
            pair[:, b] += c
            pair[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                right[:, a] -= n[:, w]
                right[:, b] += n[:, w]
                left[:, a] -= n[w]
                left[:, b] += n[w]
        moves += moved
        if not moved:
            break
    return of, moves


def choose(word: np.ndarray, side: np.ndarray, context: np.ndarray, n: np.ndarray, own: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The class of the largest gain for each word 0 .. len(own)-1, all at once against the class pairs ``pair``.

    Cells (word, side, context class, n) are sorted by word; side 0 is the class before. ``own``: the words' classes as ``pair`` counts them (the last: none).
    A word is taken out of its own class first, cell by cell."""
    every = len(pair)
    gain = np.zeros((len(own), every))
    by = np.stack([pair, pair.T])  # by side: contexts in rows, targets in columns
    for lo in range(0, len(word), 100_000):
        w, s, c, k = (x[lo : lo + 100_000] for x in (word, side, context, n))
        cell = by[s, c]
        at = np.arange(len(w))
        cell[at, own[w]] -= k
        np.maximum(cell, 0, out=cell)
        np.add.at(gain, w[np.flatnonzero(np.diff(w, prepend=-1))], np.add.reduceat(f(cell + k[:, None]) - f(cell), np.flatnonzero(np.diff(w, prepend=-1)), axis=0))
    for s in (0, 1):
        total = np.bincount(word[side == s], n[side == s], len(own))
        sums = np.repeat(by[s].sum(0)[None, :], len(own), 0)
        sums[np.arange(len(own)), own] -= total
        np.maximum(sums, 0, out=sums)
        gain -= f(sums + total[:, None]) - f(sums)
    gain[:, 0] = gain[:, every - 1] = -np.inf
    return gain.argmax(1)


def sweep(train: DataFrame, of: np.ndarray, pair: np.ndarray, end: int, parts: int) -> np.ndarray:
    """New classes of the numbers ``UNITS`` .. end-1, by counts of (word, side, class) that meet by word."""
    every = CLASSES + 1
    per = -(-end // parts)
    shared = train.sparkSession.sparkContext.broadcast((of, pair))

    def send(batches):
        of, _ = shared.value
        held, total = [], 0

        def flush():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(key, np.arange(parts + 1) * (per * 2 * every))
            at = [i for i in range(parts) if cut[i] < cut[i + 1]]
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([common.pack(key[cut[i] : cut[i + 1]], n[cut[i] : cut[i + 1]]) for i in at], pa.binary())], ["part", "data"])

        for b in batches:
            u = stream(b.column(0), end)[0]
            c = of[u]
            i = np.flatnonzero((u >= UNITS) & (u < end))
            word = (u[i] % parts).astype(np.int64) * per + u[i] // parts
            held += [word * 2 * every + c[i - 1], (word * 2 + 1) * every + c[i + 1]]
            total += len(i)
            if total > CHUNK // 4:
                yield flush()
                held, total = [], 0
        if total:
            yield flush()

    def meet(batches):
        of, pair = shared.value
        for part, t in common.Runs(batches, "part"):
            key, n = (np.concatenate(c) for c in zip(*(common.unpack(d, 2) for d in t.column("data").to_pylist())))
            key, at = np.unique(key, return_inverse=True)
            n = np.bincount(at, n)
            word, cell = key // (2 * every), key % (2 * every)
            met, word = np.unique(word, return_inverse=True)
            number = (met - part * per) * parts + part
            best = choose(word, cell // every, cell % every, n, of[number], pair)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(best, pa.int32())], ["number", "class"])

    sent = train.select("ids").mapInArrow(send, "part int, data binary")
    found = sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(meet, "number int, class int").toArrow()  # at most HEAD rows
    out = of.copy()
    out[found.column("number").to_numpy()] = found.column("class").to_numpy()
    return out


def tail_occurrences(encoded: DataFrame, of: np.ndarray, end: int) -> DataFrame:
    """(row, ord, word, l, r): every word beyond the head in its place, with the classes of its neighbours (``CLASSES`` for such a word itself)."""
    shared = encoded.sparkSession.sparkContext.broadcast(of)

    def run(batches):
        of = shared.value
        for b in batches:
            u, size = stream(b.column(1), end)
            c = of[u].astype(np.int16)
            i = np.flatnonzero(u < 0)
            each = [x.split(b" ") for x in b.column(2).to_pylist()]
            row = np.repeat(b.column(0).to_numpy(), [len(x) for x in each])
            order = np.arange(len(i)) - np.repeat(np.cumsum([len(x) for x in each]) - [len(x) for x in each], [len(x) for x in each])
            word = [w for x in each for w in x]
            for lo in range(0, len(i), 50_000):
                j = i[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(row[lo : lo + 50_000]), pa.array(order[lo : lo + 50_000], pa.int64()), pa.array(word[lo : lo + 50_000], pa.binary()), pa.array(c[j - 1]), pa.array(c[j + 1])], ["row", "ord", "word", "l", "r"])

    return encoded.filter(F.length("tails") > 0).select("row", "ids", "tails").mapInArrow(run, "row long, ord long, word binary, l short, r short")


def tail_classes(train: DataFrame, of: np.ndarray, pair: np.ndarray, end: int) -> DataFrame:
    """(word, n, class, l, r) of every training word beyond the head; l and r list the classes beside it, fewer than the head's least count."""
    shared = train.sparkSession.sparkContext.broadcast(pair)
    each = tail_occurrences(train, of, end).groupBy("word").agg(F.count("*").alias("n"), F.collect_list("l").alias("l"), F.collect_list("r").alias("r"))

    def run(batches):
        pair = shared.value
        every = len(pair)
        for b in batches:
            n = b.column(1).to_numpy()
            word = np.repeat(np.arange(len(n)), n)
            key = np.concatenate([(word * 2 + s) * every + b.column(2 + s).flatten().to_numpy(zero_copy_only=False) for s in (0, 1)])
            key, k = np.unique(key, return_counts=True)
            best = choose(key // (2 * every), key // every % 2, key % every, k.astype(float), np.full(len(n), every - 1), pair)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.int32()), b.column(2), b.column(3)], ["word", "n", "class", "l", "r"])

    return common.materialize(each.mapInArrow(run, "word binary, n long, class int, l array<short>, r array<short>"))


def tail_sums(tail: DataFrame) -> np.ndarray:
    """Rows: pair counts with the class before, pair counts with the class after, (count, words) of each class."""
    every = CLASSES + 1

    def run(batches):
        out = np.zeros((2 * every + 2, every), np.int64)
        for b in batches:
            n, c = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
            at = np.repeat(c, n)
            for s, key in enumerate((b.column(2).flatten().to_numpy() * np.int64(every) + at, at * every + b.column(3).flatten().to_numpy())):
                out[s * every : (s + 1) * every] += np.bincount(key, minlength=every * every).reshape(every, every)
            for k, x in enumerate((n, n > 0)):
                out[2 * every + k] += np.bincount(c, x, every).astype(np.int64)
        yield _stripes(out.reshape(-1))

    found = add_up(tail.select("n", "class", "l", "r").mapInArrow(run, "part int, data binary"))
    return (found if len(found) else np.zeros((2 * every + 2) * every)).reshape(2 * every + 2, every).astype(float)


def train_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The encoded documents and the model of those that aren't held out."""
    counts = word_counts(docs.filter(common.crc_mod(id_col, 5) != 1).select(F.col(text_col).alias("text")))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = Head(counts, HEAD)
    common.drop(counts)
    encoded = encode(docs, head, id_col, text_col)
    train = encoded.filter(~F.col("held_out"))
    end, free = head.size, min(UNITS, head.size)
    none, every, parts = CLASSES, CLASSES + 1, max(2, 2 * common.partitions(encoded))
    # Numbers' classes; the last entry is for words beyond the head.
    of = np.full(end + 2, none, np.int64)
    of[:free] = 1 + np.arange(free) % (CLASSES - 1)
    of[end] = 0
    moved = []
    for _ in range(ROUNDS):
        # Units: the words that move, then one for each class of all others.
        unit = free + of
        unit[:free] = np.arange(free)
        start = np.concatenate([of[:free], np.arange(every)])
        n = pair_counts(train, unit, free + every, end)
        new, moves = exchange(n, start, free)
        of[:free] = new[:free]
        one = np.eye(every)[new]
        pair = one.T @ n @ one
        if end > free:
            after = sweep(train, of, pair, end, parts)
            moves += int((after != of).sum())
            of = after
        moved.append(moves)
    between = pair_counts(train, of, every, end)
    tail = tail_classes(train, of, between, end)
    sums = tail_sums(tail)
    between += sums[:every] + sums[every : 2 * every]
    between = between[:none, :none]
    number = of[: end + 1]
    count, words_ = (np.bincount(number, x, every)[:none] + sums[2 * every + k, :none] for k, x in enumerate((head.n, head.n > 0)))
    room = count + 0.5 * (words_ + 1)
    step = (between + KAPPA * room / room.sum()) / (between.sum(1, keepdims=True) + KAPPA)
    step, room = np.log10(step), np.log10(room)
    return {"encoded": encoded, "head": head, "class": of, "tail": tail, "step": step, "room": room, "total": int(total), "distinct": int(distinct), "moved": moved}


def run_logs(n: np.ndarray, c: np.ndarray, left: np.ndarray, right: np.ndarray, begins: np.ndarray, shares: np.ndarray, room: np.ndarray) -> np.ndarray:
    """log10 probability of every run of neighbours beyond the head and of the step to the word after it.

    Line i has count n[i] and class c[i]; unseen words (count 0) may be in any class, so their classes are summed over (forward algorithm)."""
    size = np.diff(np.append(begins, len(n)))
    out = np.zeros(len(begins))
    unseen = 0.5 / room
    ahead = shares[left[begins]]  # of each run, the probability of each class for its next word
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        i = begins[live] + k
        now = ahead[live]
        known = n[i] > 0
        now[~known] *= unseen
        pick = np.flatnonzero(known)
        p = now[pick, c[i[pick]]] * (n[i[pick]] + 0.5) / room[c[i[pick]]]
        now[pick] = 0
        now[pick, c[i[pick]]] = p
        total = now.sum(1)
        out[live] += np.log10(total)
        now = (now / total[:, None]) @ shares
        ahead[live] = now
        done = size[live] == k + 1
        out[live[done]] += np.log10(now[done, right[i[done]]])
    return out


def score(model: dict) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every encoded row."""
    encoded, of, end, none = model["encoded"], model["class"], model["head"].size, CLASSES
    logs = np.append(np.log10(model["head"].n + 0.5), 0.0)
    seen = np.append(model["head"].n > 0, False)
    room = np.append(model["room"], 0.0)
    step = np.zeros((none + 1, none + 1))  # of a word beyond the head and its neighbours the other part has the transitions
    step[:none, :none] = model["step"]
    base_room = log10(model["total"] + 0.5 * (model["distinct"] + 1))
    shared = encoded.sparkSession.sparkContext.broadcast((of, logs, seen, room, step))

    def local(batches):
        of, logs, seen, room, step = shared.value
        for b in batches:
            u, size = stream(b.column(3), end)
            c = of[u]
            at = np.cumsum(size + 1) - (size + 1)
            both = logs[u[1:]]
            own = [size + 1, np.add.reduceat(seen[u[1:]].astype(np.int64), at), np.add.reduceat(both, at) - (size + 1) * base_room, np.add.reduceat(both - room[c[1:]] + step[c[:-1], c[1:]], at)] if len(size) else [[]] * 4
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(x, t) for x, t in zip(own, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]], ["row", "doc_id", "held_out", "n_tokens", "known", "base", "model"])

    kind = dict(encoded.dtypes)["doc_id"]
    rows = encoded.select("row", "doc_id", "held_out", "ids").mapInArrow(local, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, model double")

    def beyond(batches):
        """Sorted by (row, ord); runs of neighbours beyond the head are scored together."""
        shares, room = 10.0 ** shared.value[4][:none, :none], 10.0 ** shared.value[3][:none]
        rest = None
        for b in batches:
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
            begins = np.flatnonzero((rest[4] != none) | (rest[1] == 0))
            if len(begins) < 2:
                continue
            whole, rest = [x[: begins[-1]] for x in rest], [x[begins[-1] :] for x in rest]  # the last run may go on in the next batch
            yield summed(whole, begins[:-1], shares, room)
        if rest is not None and len(rest[0]):
            yield summed(rest, np.flatnonzero((rest[4] != none) | (rest[1] == 0)), shares, room)

    def summed(lines, begins, shares, room):
        row, _, n, c, _, _ = lines
        at = np.flatnonzero(np.diff(row, prepend=row[0] - 1))
        part = np.zeros(len(row))
        part[begins] = run_logs(n, c.astype(np.int64), lines[4].astype(np.int64), lines[5].astype(np.int64), begins, shares, room)
        return pa.RecordBatch.from_arrays([pa.array(row[at]), *[pa.array(np.add.reduceat(x, at)) for x in ((n > 0).astype(np.int64), np.log10(n + 0.5), part)]], ["row", "more", "logs", "part"])

    met = tail_occurrences(encoded, of, end).join(model["tail"].select("word", "n", "class"), "word", "left")
    met = met.select("row", "ord", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", F.lit(none)).alias("class"), "l", "r")
    rest = met.repartition("row").sortWithinPartitions("row", "ord").mapInArrow(beyond, "row long, more long, logs double, part double")
    rest = rest.groupBy("row").agg(*[F.sum(x).alias(x) for x in ("more", "logs", "part")])
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return rows.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + zero("more")).alias("n_known"),
        F.lit(model["total"]).cast("long").alias("train_tokens"),
        (F.col("base") + zero("logs")).alias("base_score"),
        (F.col("model") + zero("part")).alias("score"),
    )


def report(docs: DataFrame) -> DataFrame:
    return score(train_model(docs))

"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator on documents."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
import xxhash

from quillspark.llm import classlm, exact_dedup, huffman, langid, mixing, packing, quality, simhash, substring_dedup, tokens

from .fixture import empty, frame, rows, words

OPERATORS = [substring_dedup, langid, huffman, classlm, quality, simhash, packing, mixing, exact_dedup]


def mod(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


@pytest.mark.parametrize("op", OPERATORS, ids=lambda m: m.__name__.rpartition(".")[2])
def test_empty_table(spark, op):
    assert op.report(empty(spark)).collect() == []


@pytest.mark.parametrize("op", OPERATORS, ids=lambda m: m.__name__.rpartition(".")[2])
def test_only_null_texts(spark, op):
    data = [(i, None, None, None, None, *[None] * 10) for i in (1, None, 2)]
    assert len(op.report(frame(spark, data)).collect()) == 3


def test_substring_dedup_by_brute_force(spark):
    data = rows()
    owner = {}
    big = 1 << 63
    for i, t, *_ in data:
        w = words(t)
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            owner[k] = min(owner.get(k, big), big if i is None else i)
    want = Counter()
    for i, t, *_ in data:
        w = words(t)
        gone = set()
        for j in range(len(w) - 12):
            if owner[tuple(w[j : j + 13])] < (big if i is None else i):
                gone |= set(range(j, j + 13))
        left = [x for j, x in enumerate(w) if j not in gone]
        want[i, len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.report(frame(spark)).collect())
    assert got == want


@pytest.mark.parametrize("bits", [6, 12])
def test_substring_collisions_remove_nothing(spark, monkeypatch, bits):
    """With hashes of a few bits nearly all windows seem repeated: source coordinates tell them apart."""
    data = [r for r in rows(600)][:20]
    mask = np.uint64(((1 << bits) - 1) << (64 - bits))
    monkeypatch.setattr(substring_dedup, "edges", lambda code, k=13, e=substring_dedup.edges: e(code, k) & mask)
    owner = {}
    for i, t, *_ in data:
        w = words(t)
        for j in range(len(w) - 12):
            owner.setdefault(tuple(w[j : j + 13]), set()).add(1 << 63 if i is None else i)
    for r in substring_dedup.report(frame(spark, data)).collect():
        if r.doc_id in (303, 304):
            continue
        w = words(next(t for i, t, *_ in data if i == r.doc_id))
        gone = set()
        for j in range(len(w) - 12):
            if min(owner[tuple(w[j : j + 13])]) < (1 << 63 if r.doc_id is None else r.doc_id):
                gone |= set(range(j, j + 13))
        assert r.n_removed <= len(gone)


def test_branching_nodes():
    """Edges of three nodes: one with two ways out, one with two ways in, one with a single way."""
    node = lambda n, e: np.uint64(n << 24 | e)
    h = np.array([node(1, 1), node(1, 1), node(1, 2), node(1, 2), node(2, 1), node(2, 1), node(2, 1), node(2, 1), node(3, 1), node(3, 1)], np.uint64)
    before = np.array([5, 5, 5, 5, 6, 6, 7, 7, 8, 9], np.uint16)  # words 8 and 9 come before node 3 once each: not repeated
    first = np.append(True, h[1:] != h[:-1])
    assert substring_dedup.branching(h, before, first).tolist() == [True] * 8 + [False] * 2


def test_paths_end_at_branches(spark):
    a, b, c = ([f"{x}{i}" for i in range(16)] for x in "abc")
    docs = spark.createDataFrame([(1, " ".join(a + b)), (2, " ".join(a + c)), (3, " ".join(a + b)), (4, " ".join(a + c))], "doc_id long, text string").repartition(4, "doc_id")
    got = {(r.doc, r.start, r.n) for r in substring_dedup.paths(docs.coalesce(1).repartition(4), 13).collect()}
    assert {d for d, _, _ in got} == {2, 3, 4}
    spans = {(r.doc, r.start, r.end) for r in substring_dedup.repeated_spans(docs).collect()}
    assert (3, 0, 32) in spans and (4, 0, 32) in spans and (2, 0, 16) in spans


def test_prefix_hashes_depend_on_the_words_between():
    memo = substring_dedup._Codes()
    a, b = [b"x", b"y", b"z", b"x", b"y"], [b"q", b"q", b"x", b"y", b"q"]
    p, q = substring_dedup.prefixes(a, memo), substring_dedup.prefixes(b, memo)
    at = lambda s, i, j: substring_dedup.between(s[[i]], s[[j]], np.array([i])).tolist()
    assert at(p, 0, 2) == at(p, 3, 5) == at(q, 2, 4) != at(q, 1, 3) and at(p, 1, 2) != at(p, 0, 1)


def test_substring_remove_carries_any_column(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    names = "doc_id long, text string, doc string, tag string, paths string, spans string, start int, __sd_c0 long, want string"
    data = [(i, f"a{i} {passage} b{i}", f"D{i}", f"T{i}", "p", None, i, -i, "w") for i in range(5)] + [(None, None, "D", None, "p", "s", 9, 9, "w"), (7, "short", None, "T", None, "s", 8, 8, None)]
    out = substring_dedup.remove(spark.createDataFrame(data, names))
    assert out.columns == [x.split()[0] for x in names.split(", ")]
    want = Counter((r[0], f"a{r[0]} b{r[0]}" if r[0] in range(1, 5) else r[1] or "", *r[2:]) for r in data)
    assert Counter((r[0], r[1] or "", *r[2:]) for r in out.collect()) == want
    out = substring_dedup.remove(frame(spark))
    assert out.columns == frame(spark).columns
    carried = lambda r: (r[0], *r[2:])
    assert Counter(map(carried, out.collect())) == Counter(map(carried, frame(spark).collect()))


def test_spans_compact_paths_of_several_sources(spark):
    a = [f"a{i}" for i in range(20)]
    b = [f"b{i}" for i in range(20)]
    docs = spark.createDataFrame([(1, " ".join(a + b)), (2, " ".join(b)), (3, " ".join(["x"] + a + b + ["y"])), (0, " ".join(b[5:]))], "doc_id long, text string")
    got = {(r.doc, r.start, r.end) for r in substring_dedup.repeated_spans(docs).collect()}
    assert (3, 1, 41) in got  # windows of documents 0 and 1 follow one another: one span
    assert all(d != 0 for d, _, _ in got)


def test_language_id(spark):
    got = langid.report(frame(spark)).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    for i in (400, 401, 402, 405, 406):
        assert by[i].lang_pred == "und" and by[i].score == 0
    assert all(0 <= r.score <= 1 and (r.lang_pred in ("und", "en", "fr", "de")) and r.held_out == (mod(r.doc_id, 4) == 2) for r in got)


def test_language_rejection_by_brute_force(spark):
    """Nearest centroid by cosine over all centroids; beyond the centroid's reach a text is flagged."""
    docs = frame(spark, [r for r in rows(3000)] + [(700 + i, "zqxj wvkq xzzq jjqx " * 20 + str(i), "en", "s", 1, *[None] * 10) for i in (2, 5)])
    model = langid.train(docs.filter("doc_id between 100 and 111"))
    want = Counter()
    for r in docs.collect():
        n = langid.grams((r.text or "").encode())
        if n is None:
            want[r.doc_id, "und", 0.0, True] += 1
            continue
        tf = {i: (1 + np.log(c)) * model["idf"][i] for i, c in enumerate(n) if c}
        size = sum(v * v for v in tf.values()) ** 0.5 or 1
        cos = [sum(v * c[i] for i, v in tf.items()) / size for c in model["centroids"]]
        j = int(np.argmax(cos))
        want[r.doc_id, model["langs"][j], round(min(1, max(0, cos[j])), 3), bool(cos[j] < model["least"][j])] += 1
    got = langid.predict(docs, model).collect()
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 3), r.rejected) for r in got) == want
    assert all(r.rejected for r in got if r.doc_id and r.doc_id >= 700) and not any(r.rejected for r in got if r.doc_id in range(100, 112))


def test_huffman_round_trip(spark):
    data = rows()
    memo = tokens.memo(tokens.default_path("word_bpe_49k.json"), "words")
    got = huffman.report(frame(spark, data)).collect()
    want = Counter()
    for i, t, *_ in data:
        ids = np.array(memo.tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert ids == sorted(ids)


def test_class_lm_counts_and_base(spark):
    data = rows()
    c = Counter()
    for i, t, *_ in data:
        if mod(i, 5) != 1:
            c.update(w.lower() for w in words(t))
            c["end"] += 1
    n, v = sum(c.values()), len(c)
    base = lambda w: log10((c[w] + 0.5) / (n + 0.5 * (v + 1)))
    want = sorted((str(i), mod(i, 5) == 1, len(words(t)) + 1, sum(c[w.lower()] > 0 for w in words(t)) + 1, n, round(sum(base(w.lower()) for w in words(t)) + base("end"), 5)) for i, t, *_ in data)
    for head in (classlm.HEAD, 20):
        before, classlm.HEAD = classlm.HEAD, head
        got = classlm.report(frame(spark)).collect()
        classlm.HEAD = before
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
        assert all(r.score < 0 for r in got)


@pytest.mark.parametrize("head, units", [(100_000, 1024), (100_000, 8), (20, 8), (0, 8)])
def test_class_lm_score_by_brute_force(spark, monkeypatch, head, units):
    monkeypatch.setattr(classlm, "HEAD", head)
    monkeypatch.setattr(classlm, "UNITS", units)
    data = rows(3000)
    m = classlm.train_model(frame(spark, data))
    beyond = {bytes(r.word): r["class"] for r in m["tail"].collect()}
    of = {w: int(m["class"][i]) for w, i in m["head"].numbers().items()} | beyond | {"end": 0}
    texts = [(i, [w.lower() for w in words(t)] + ["end"]) for i, t, *_ in data]
    count, k = Counter(), classlm.CLASSES
    between = np.zeros((k, k))
    for i, w in texts:
        if mod(i, 5) != 1:
            count.update(w)
            for a, b in zip(["end", *w], w):
                if not (a in beyond and b in beyond):
                    between[of[a], of[b]] += 1
    assert set(count) == set(of) and all(0 < c < k for w, c in of.items() if w != "end")  # every training word has a class of its own
    room = np.array([sum(count[w] for w in of if of[w] == c) + 0.5 * (sum(of[w] == c for w in of) + 1) for c in range(k)])
    step = (between + classlm.KAPPA * room / room.sum()) / (between.sum(1, keepdims=True) + classlm.KAPPA)
    assert np.allclose(step.sum(1), 1)
    want = []
    for i, w in texts:
        state, log = np.eye(k)[0], 0.0
        for x in w:
            state = state @ step
            state = state * (0.5 / room) if not count[x] else state * np.eye(k)[of[x]] * (count[x] + 0.5) / room
            log += log10(state.sum())
            state /= state.sum()
        want.append((str(i), len(w), round(log, 4)))
    got = classlm.score(m).collect()
    assert sorted((str(r.doc_id), r.n_tokens, round(r.score, 4)) for r in got) == sorted(want)


def objective(n, of, classes):
    one = np.eye(classes)[of]
    pair = one.T @ n @ one
    f = classlm.f
    return f(pair).sum() - f(pair.sum(0)).sum() - f(pair.sum(1)).sum()


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(0)
    n = rng.integers(0, 5, (30, 30)).astype(float)
    of = np.append(1 + np.arange(25) % 7, [0, 8, 3, 4, 5])  # 25 units move; one of the others is without a class
    new, moves = classlm.exchange(n, of, 25, classes=8, sweeps=100)
    assert moves and (new[25:] == of[25:]).all() and (new[:25] > 0).all() and (new[:25] < 8).all()
    best = objective(n, new, 9)
    assert best >= objective(n, of, 9)
    for w in range(25):
        for c in range(1, 8):
            assert objective(n, np.where(np.arange(30) == w, c, new), 9) <= best + 1e-6


def test_choose_takes_the_class_of_the_largest_gain():
    rng = np.random.default_rng(1)
    every, m = 6, 40
    n = rng.integers(0, 4, (m, m)).astype(float)
    np.fill_diagonal(n, 0)  # the sweep at once counts a word's bigrams with itself by its old class
    of = rng.integers(1, every, m)
    of[0] = 0
    pair = np.eye(every)[of].T @ n @ np.eye(every)[of]
    cells = [(w, s, c, (n[:, w] if s == 0 else n[w])[of == c].sum()) for w in range(m) for s in (0, 1) for c in range(every)]
    w, s, c, k = (np.array(x) for x in zip(*[x for x in cells if x[3]]))
    got = classlm.choose(w, s, c, k, of, pair)
    for i in range(1, m):
        others = np.arange(m) != i
        rest = np.eye(every)[of[others]].T @ n[np.ix_(others, others)] @ np.eye(every)[of[others]]
        gains = []
        for b in range(1, every - 1):
            g = 0.0
            for side, own in ((0, pair), (1, pair.T)):
                x = np.array([(n[:, i] if side == 0 else n[i])[of == d].sum() for d in range(every)])
                y = own[:, b] - (of[i] == b) * x
                g += (classlm.f(y + x) - classlm.f(y)).sum() - classlm.f(y.sum() + x.sum()) + classlm.f(y.sum())
            gains.append(g)
        assert rest.sum() <= pair.sum() and gains[got[i] - 1] == pytest.approx(max(gains))


def test_exchange_finds_planted_classes():
    # Words 0-9 are always followed by 10-19 and these by 0-9; 20 is the end token.
    n = np.zeros((21, 21))
    n[:10, 10:20] = n[10:20, :10] = 7
    n[20, :10] = n[10:20, 20] = 1
    of = np.append(1 + np.arange(20) % 2, 0)
    of[:2] = 2
    of, _ = classlm.exchange(n, of, 20, classes=3, sweeps=10)
    assert len(set(of[:10])) == 1 and len(set(of[10:20])) == 1 and of[0] != of[10]


def brute_base(text):
    w = words(text)
    chars = sum(len(x.decode()) for x in w)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    where = defaultdict(list)
    for j in range(len(w) - 7):
        where[tuple(w[j : j + 8])].append(j)
    inside = {k for v in where.values() if len(v) > 1 for j in v for k in range(j, j + 8)}
    return len(w), chars, symbols, dup, len(inside)


def test_quality_base_by_brute_force(spark):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.report(frame(spark)).collect())
    want = Counter()
    for i, t, *_ in rows():
        n = brute_base(t)
        want[(i, *n, n[0] < 20 or 100 * n[4] > 30 * n[0])] += 1
    assert got == want
    for t in ("a b c d e f g h " * 3, "x y\nx y\n\nx y", "a " * 9, "q w e r t y u i o a b c d e f g h i q w e r t y u i"):
        assert quality.base(t.encode(), words(t)) == brute_base(t)


def brute_class(c):
    if ord(c) > 127:
        return 9
    if c in "aeiou":
        return 0
    if c.islower():
        return 1
    if c.isupper():
        return 2
    if c.isdigit():
        return 3
    if c in ".,;:!?'\"-()":
        return 4
    return 6 if c == " " else 7 if c == "\n" else 8 if ord(c) < 32 or ord(c) == 127 else 5


def brute_distance(p, q):
    keys = set(p) | set(q)
    a, b = sum(p.values()) or 1, sum(q.values()) or 1
    total = 0.0
    for k in keys:
        x, y = p.get(k, 0) / a, q.get(k, 0) / b
        for z in (x, y):
            total += z * np.log2(z / ((x + y) / 2)) / 2 if z else 0
    return max(0.0, total) ** 0.5


def brute_verdicts(data):
    """(base failed, kept, both distances) of every (text, lang), by definition."""
    chars, words_ = defaultdict(Counter), defaultdict(Counter)
    bad = []
    for t, lang in data:
        n = brute_base(t)
        bad.append(n[0] < 20 or 100 * n[4] > 30 * n[0])
        if t is not None and lang is not None and not bad[-1]:
            chars[lang].update(map(brute_class, t))
            words_[lang].update(words(t))
    common_ = {lang: {w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON]} for lang, c in words_.items()}
    fold = lambda c, known: Counter({k: sum(n for w, n in c.items() if (w if w in known else None) == k) for k in [*known, None]})
    refs = [(chars[lang], common_[lang], fold(words_[lang], common_[lang])) for lang in chars]
    out = []
    for (t, _), failed in zip(data, bad):
        if failed or not refs:
            out.append((failed, not failed, None, None))
            continue
        w = words(t)
        far = min(brute_distance(Counter(map(brute_class, t)), c) for c, _, _ in refs)
        far_words = min(brute_distance(fold(Counter(w), known), ref) for _, known, ref in refs)
        short = sum(len(x.decode()) for x in w) < quality.LEAST_CHARS or len(w) < quality.LEAST_WORDS
        stray = far > quality.FAR + quality.FAR_SHORT * len(w) ** -0.5 or far_words > quality.FAR_WORDS + quality.FAR_WORDS_SHORT * len(w) ** -0.5
        out.append((failed, short or not stray, round(far, 6), round(far_words, 6)))
    return out


@pytest.mark.parametrize("langs", [True, False])
def test_quality_verdict_by_brute_force(spark, langs):
    rng = random.Random(8)
    odd = " ".join("".join(rng.choice("XQ#7@;") for _ in range(6)) for _ in range(80))  # like no reference
    data = [r for r in rows(3000)] + [(900 + i, odd + f" {i}", None, "s", 1, *[None] * 10) for i in range(3)]
    data = [r if langs else (*r[:2], None, *r[3:]) for r in data]
    want = Counter((r[0], *v) for r, v in zip(data, brute_verdicts([(r[1], r[2]) for r in data])))
    figure = lambda x: None if x is None else round(x, 6)
    got = quality.report(frame(spark, data)).collect()
    assert Counter((r.doc_id, r.base_failed, r.kept, figure(r.char_distance), figure(r.word_distance)) for r in got) == want
    assert any(not r.kept and not r.base_failed for r in got) == langs


def test_quality_keep_keeps_columns(spark):
    out = quality.keep(frame(spark))
    assert out.columns == frame(spark).columns
    verdict = Counter()
    for r, v in zip(rows(), brute_verdicts([(r[1], r[2]) for r in rows()])):
        verdict[r] += v[1]
    assert Counter(tuple(r) for r in out.collect()) == +verdict
    want = Counter(r.doc_id for r in quality.report(frame(spark)).collect() if r.kept)
    assert Counter(r.doc_id for r in out.collect()) == want


def test_jensen_shannon():
    p, q = np.array([1.0, 0]), np.array([0, 1.0])
    assert quality.distance(p, q) == pytest.approx(1) and quality.distance(p, p * 3) == 0


def brute_fingerprint(text):
    w = [x.lower() for x in words(text)]
    s = [b" ".join(w[j : j + 3]) for j in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_by_brute_force(spark):
    data = rows(2000)
    fp = [brute_fingerprint(r[1]) for r in data]
    of = list(range(len(data)))
    for _ in of:
        for a in range(len(data)):
            for b in range(len(data)):
                if bin(fp[a] ^ fp[b]).count("1") <= 2:
                    of[a] = min(of[a], of[b])
    least = {}
    for k, r in zip(of, data):
        if r[0] is not None:
            least[k] = min(least.get(k, 1 << 62), r[0])
    want = Counter((r[0], f"{f:016x}", least.get(k)) for r, f, k in zip(data, fp, of))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.report(frame(spark, data)).collect()) == want
    kept = simhash.deduplicate(frame(spark, data))
    assert kept.columns == frame(spark).columns and kept.count() == len(set(of))


def test_simhash_deduplicate_carries_any_column(spark):
    data = [(3, "a b c d", 7, "x", None), (1, "A b c D", 8, None, "u"), (2, "e f g h", 9, "z", "v"), (None, None, 1, "n", "w")]
    out = simhash.deduplicate(spark.createDataFrame(data, "doc_id long, text string, __sh_row long, fp string, __sh_c0 string"))
    assert out.columns == ["doc_id", "text", "__sh_row", "fp", "__sh_c0"]
    assert Counter(map(tuple, out.collect())) == Counter([data[1], data[2], data[3]])


def test_simhash_tiles_lose_no_link(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([centre ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(30)]))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2
    label = np.arange(len(fp))
    for _ in range(len(fp)):
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long").repartition(3)
    from quillspark.llm import common

    for tile in (1, 4, 30, 8192):
        roots = {r.node: r.root for r in common.components(simhash.links(df, 2, tile)).collect()}
        got = {}
        for x, k in zip(fp.view(np.int64).tolist(), label):
            got.setdefault(roots.get(x, x), set()).add(int(k))
        assert all(len(v) == 1 for v in got.values()) and len(got) == len(set(label.tolist()))


def test_simhash_tiles_hold_their_keys():
    rng = np.random.default_rng(5)
    n = np.where(rng.random(17**4) < 0.02, rng.integers(1, 200, 17**4), 0)
    first, cuts = simhash.tiles_of(n, 100)
    held = np.zeros(int((first + cuts).max()), np.int64)
    for k in np.flatnonzero(n):
        assert cuts[k] == -(-n[k] // 100)
        if cuts[k] == 1:
            held[first[k]] += n[k]
        else:
            assert held[first[k] : first[k] + cuts[k]].sum() == 0
            held[first[k] : first[k] + cuts[k]] = 1000
    assert held.min() > 0 and held[held < 1000].max() <= 100


def test_components_of_long_chains(spark):
    from quillspark.llm import common

    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5001), (5001, 5000), (6000, 6000)]
    roots = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({roots[i] for i in range(301)}) == 1 and len({roots[i] for i in range(1000, 1400)}) == 1 and len(set(roots.values())) == 3


def test_packing(spark):
    data = rows()
    memo = tokens.memo(tokens.default_path("byte_bpe_50k.json"), "bytes")
    got = packing.report(frame(spark, data)).collect()
    want = Counter()
    for i, t, *_ in data:
        ids = np.array(memo.tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) - 1024 * ((len(ids) - 1) // 1024)
        for p, (lo, hi) in enumerate(zip([0, *range(first, len(ids), 1024)], range(first, len(ids) + 1, 1024))):
            want[i, p, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    for s in by.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by) <= -(-sum(r.length for r in got) // 1024) + 1


def test_mixing(spark):
    got = mixing.report(frame(spark)).collect()
    assert len(got) == len(rows())
    size = {r[0]: len(words(r[1])) for r in rows()}
    assert all(r.size == size[r.doc_id] for r in got if r.doc_id not in (None, 303, 304))
    assert all(r.taken <= 3 * r.size for r in got)
    again = Counter((r.doc_id, r.size, r.taken) for r in mixing.report(frame(spark).repartition(5)).collect())
    assert again == Counter((r.doc_id, r.size, r.taken) for r in got)


def test_mixing_hits_targets_and_weights(spark):
    data = [(i, "w " * (1 + i % 50), f"s{i % 5}", float(i % 3)) for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, q double")
    for weight in (None, "q"):
        got = mixing.plan(docs, weight_col=weight).collect()
        taken = defaultdict(int)
        for r in got:
            taken[r.source] += r.taken
        for r in got:
            assert abs(taken[r.source] - r.target) <= 50
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(sum(1 + i % 50 for i in range(3000)))
    assert mixing.apply(docs).count() == sum(r.copies for r in mixing.plan(docs).collect())


def test_mixing_apply_carries_any_column(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i), f"s{i % 2}", i, f"c{i}", -i) for i in range(50)], "doc_id long, text string, source string, __mx_row long, __mx_c0 string, size int")
    times = {r.doc_id: r.copies for r in mixing.plan(docs).collect()}
    out = mixing.apply(docs)
    assert out.columns == docs.columns
    assert Counter(tuple(r) for r in out.collect()) == Counter({tuple(r): times[r.doc_id] for r in docs.collect() if times[r.doc_id]})


def test_mixing_includes_by_unequal_probability(spark):
    """Many sources alike: documents of each weight are taken as often as their inclusion probability says, which plain random order wouldn't give."""
    rng = random.Random(2)
    sizes = [rng.choice([2, 5, 9, 20, 40, 100, 300]) for _ in range(40)]
    data = [(1000 * s + i, "w " * n, f"s{s:03}") for s in range(240) for i, n in enumerate(sizes)]
    got = mixing.plan(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    extra, want, n = defaultdict(float), defaultdict(float), Counter()
    plain = {}
    for r in got:
        k = (int(r.source[1:]) % 3, r.size)
        extra[k] += r.copies - r.whole
        want[k] += r.p
        n[k] += 1
        plain.setdefault(r.source, []).append(r)
    differ = 0
    for k in n:
        p = want[k] / n[k]
        assert abs(extra[k] / n[k] - p) <= 0.04 + 4 * (p * (1 - p) / n[k]) ** 0.5, k
    assert max(want[k] / n[k] for k in n) - min(want[k] / n[k] for k in n) > 0.3  # unequal indeed
    for source, docs in plain.items():
        u = lambda r: int(hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest()[:13], 16)
        left = docs[0].target - sum(r.whole * r.size for r in docs)
        by_u = set()
        for r in sorted((r for r in docs if r.p > 0), key=u):
            if left > 0 and left * 2 >= r.size:
                by_u.add(r.doc_id)
            left -= r.size
        differ += by_u != {r.doc_id for r in docs if r.copies > r.whole}
    assert differ > 120


def test_mixing_weights_follow_the_bound(spark):
    """Brute force: lambda = min(3, c * weight) with the words of the source as expected."""
    docs = spark.createDataFrame([(i, "w " * (1 if i % 2 else 1000), "a" if i < 30 else "b") for i in range(400)], "doc_id long, text string, source string")
    got = mixing.plan(docs).collect()
    for s in "ab":
        mine = [r for r in got if r.source == s]
        lo, hi = 0.0, 3.0
        for _ in range(100):
            c = (lo + hi) / 2
            lo, hi = (c, hi) if sum(r.size * min(3, c * r.size.bit_length()) for r in mine) < mine[0].target else (lo, c)
        for r in mine:
            want = min(3, lo * r.size.bit_length())
            assert (r.p == pytest.approx(want % 1, abs=1e-6) or want % 1 > 1 - 1e-6 or want % 1 < 1e-6) and want - 1 - 1e-6 <= r.copies <= want + 1 + 1e-6


def test_mixing_caps_small_sources(spark):
    docs = spark.createDataFrame([(i, "w", "b") for i in range(90)] + [(100 + i, "w", "a") for i in range(2)] + [(200, "w", None)], "doc_id long, text string, source string")
    target = {r.source: (r.target, r.source_size) for r in mixing.plan(docs).collect()}
    assert target["a"] == (6.0, 2) and target[None] == (3.0, 1) and target["b"][0] == pytest.approx(84)


def test_exact_dedup_by_brute_force(spark):
    data = rows()
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = defaultdict(list)
    for r in data:
        groups[norm(r[1])].append(r)
    want = Counter()
    for k, g in groups.items():
        best = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for r in g:
            want[r[0], best[0], len(g), hashlib.sha256(k.encode()).hexdigest()] += 1
    got = exact_dedup.report(frame(spark)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    left = exact_dedup.deduplicate(frame(spark))
    assert left.columns == frame(spark).columns and left.count() == len(groups)


@pytest.mark.parametrize("bits, pieces", [(24, 8192), (2000, 1), (1, 8192)])
def test_exact_dedup_in_ranges(spark, monkeypatch, bits, pieces):
    """Many ranges of one piece each, and a filter so full that it lets most single rows shuffle, give the same rows."""
    a = Counter(tuple(r) for r in exact_dedup.report(frame(spark)).collect())
    monkeypatch.setattr(exact_dedup, "BITS_A_ROW", bits)
    monkeypatch.setattr(exact_dedup, "RANGE", pieces)
    assert a == Counter(tuple(r) for r in exact_dedup.report(frame(spark)).collect())
    assert exact_dedup.deduplicate(frame(spark)).count() == sum(k[3] * n for k, n in a.items())


def test_bloom_filter_lets_single_rows_pass(spark):
    docs = spark.createDataFrame([(i, f"text {i // 2 if i < 1000 else i}") for i in range(21_000)], "doc_id long, text string")
    rows, total = exact_dedup.prepared(docs, [], "doc_id", "text")
    hit = {r["__xd_id"] for r in exact_dedup.possibly_repeated(rows, total).filter("__xd_hit").collect()}
    assert hit >= set(range(1000)) and len(hit) < 1000 + 200  # no repeated row is missed, hardly a single one shuffles


def test_exact_dedup_carries_any_column(spark):
    names = ["doc_id", "text", "__xd_row", "__xd_sha", "__xd_hit", "__xd_c0", "slot"]
    data = [(1, "a b", 7, "s", True, "p", 1), (2, "ab", 8, "t", None, "q", 2), (3, "c", 9, None, False, "r", 3)]
    out = exact_dedup.deduplicate(spark.createDataFrame(data, "doc_id long, text string, __xd_row long, __xd_sha string, __xd_hit boolean, __xd_c0 string, slot long"))
    assert out.columns == names and sorted(tuple(r) for r in out.collect()) == [data[0], data[2]]

"""Held-out accuracy, planted cases, round trips, and the pipeline against a brute-force version."""

import hashlib
import html
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import classlm, exact_dedup, htmlcrf, huffman, langid, mixing, packing, quality, simhash, tokens

from .fixture import frame, rows, words
from .test_edges import brute_fingerprint, brute_verdicts

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def crf():
    return htmlcrf.model()


def test_crf_on_held_out_pages(crf):
    wrong = total = bad = 0
    for page, main in htmlcrf.labelled_pages(120, seed=4242):
        found, y = htmlcrf.label(page, main)
        z = crf.viterbi(crf.scores(htmlcrf.features(found)))
        wrong += sum(a != b for a, b in zip(y, z))
        total += len(y)
        bad += y != z
    assert wrong <= 0.01 * total and bad <= 12


def test_crf_viterbi_is_the_best_path(crf):
    rng = np.random.default_rng(1)
    for n in range(1, 8):
        s = rng.normal(size=(n, 2))
        score = lambda y: sum(s[i, v] for i, v in enumerate(y)) + sum(crf.t[a, b] for a, b in zip(y, y[1:]))
        best = max(([int(b) for b in f"{k:0{n}b}"] for k in range(2**n)), key=score)
        assert crf.viterbi(s) == best


@pytest.mark.parametrize(
    "page",
    [None, "", "   ", "<", "<<<>>>", "</p></div>", "<p", "<!-- open", "<script>var a='<p>x</p>'", "&amp;&#x41;&bogus;", "<div>" * 3000 + "deep" + "</div>" * 10, "x" * 200_000, "<a href='<p>'>", '<p class="a>b">t', "\x00<p>\x01"],
)
def test_crf_survives_any_markup(crf, page):
    assert isinstance(htmlcrf.extract(page, crf), str)


def test_crf_typical_page(crf):
    page = """<html><head><title>T</title></head><body><header><p>Site</p><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav></header>
    <div class="cookie-notice">We use cookies &amp; more.</div><article><h1>Head &amp; shoulders</h1><p>First  paragraph
    with <b>bold</b> text.<p>Second &lt;one&gt;.<script>x()</script><ul><li>Point one is here.</li></ul></article><aside class="sidebar"><p>Related things to read.</p></aside>
    <section class="comments"><h2>Comments</h2><p>Nice one, I agree.</p></section><form><label>Mail</label><button>Go</button></form><footer>&copy; 2020 Site</footer></body></html>"""
    assert htmlcrf.extract(page, crf) == "Head & shoulders\nFirst paragraph with bold text.\nSecond <one>.\nPoint one is here."


def test_html_report(spark):
    pages = spark.createDataFrame([(1, "u", "<article><h1>Hi there</h1><p>Some text of it.</p></article>", "x"), (None, None, None, "y"), (1, "u", "", "z")], "page_id long, url string, html string, text string")
    got = htmlcrf.report(pages).collect()
    assert len(got) == 3 and all(r.n_chars == len(r.text) for r in got) and {r.text for r in got} == {"Hi there\nSome text of it.", ""}
    assert htmlcrf.report(pages.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_html_on_the_pages(spark):
    import re

    for r in htmlcrf.report(spark.read.parquet(f"{DATA}/pages.parquet")).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search("<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:p|h1)\b[^>]*>", body)]
        assert r.text == "\n".join(p for p in parts if p)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.99 * len(got)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_quality_against_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.report(docs).join(labels, "doc_id").filter("not base_failed").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.2 * len(bad)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_class_model_beats_unigrams_on_held_out_texts(spark):
    got = [r for r in classlm.report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_packing_is_near_the_bound(spark):
    got = packing.report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // 1024) * 1.005 + 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_packing_needs_no_more_than_best_fit_decreasing(spark):
    got = packing.report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    lengths = [r.length for r in got]
    down = packing.best_fit(lengths, sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True), 1024)
    assert len({r.sequence_id for r in got}) <= len(down)


def test_evolution_saves_bins():
    """Against best-fit decreasing, over a few draws of lengths that leave it room."""
    saved = 0
    for seed in range(6):
        rng = random.Random(seed)
        lengths = [rng.choice((rng.randint(130, 420), rng.randint(250, 600))) for _ in range(240)]
        down = packing.best_fit(lengths, sorted(range(240), key=lengths.__getitem__, reverse=True), 1024)
        best = packing.evolve(lengths, [], 1024, seed, 200)
        assert sorted(i for b in best for i in b[1:]) == list(range(240)) and all(b[0] == sum(lengths[i] for i in b[1:]) <= 1024 for b in best)
        assert len(best) <= len(down)
        saved += len(down) - len(best)
    assert saved > 0


def test_crossover_keeps_every_piece_once():
    rng = random.Random(1)
    lengths = [rng.randint(1, 1000) for _ in range(200)]
    a, b = (packing.best_fit(lengths, rng.sample(range(200), 200), 1024) for _ in range(2))
    for _ in range(50):
        a, b = b, packing.cross(a, b, lengths, 1024, rng)
        assert sorted(i for x in b for i in x[1:]) == list(range(200)) and all(x[0] == sum(lengths[i] for i in x[1:]) <= 1024 for x in b)


def test_packing_in_many_shards(spark, monkeypatch):
    """Levels, migration and the last shard at a small shard size place every piece once, within the bound's reach."""
    monkeypatch.setattr(packing, "SHARD", 300)
    rng = random.Random(3)
    cut = spark.createDataFrame([(i, 0, 0, rng.choice((1024, rng.randint(1, 1024), rng.randint(1, 300))), 0) for i in range(3000)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(cut).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    assert len(got) == 3000
    for rows_ in by.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by) <= -(-sum(r.length for r in got) // 1024) * 1.01 + 1


def test_huffman_codes():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 100, 5000):
        counts = (rng.zipf(1.3, n) % 10**9).astype(np.int64) + 1
        lengths = huffman.code_lengths(counts)
        assert lengths.max() <= huffman.BITS and (n == 1 or sum(2.0**-x for x in lengths) == pytest.approx(1))
        codes = huffman.canonical(lengths)
        assert len({(int(a), int(b)) for a, b in zip(lengths, codes)}) == n
        ids = rng.integers(0, n, 3000)
        stream, points = huffman.encode(ids, lengths, codes)
        sym, size = huffman.table(lengths, codes, huffman.BITS)
        assert (huffman.decode(stream, points, len(ids), sym, size) == ids).all()
        k = 5  # a checkpoint alone is enough to go on from
        if len(points) > k:
            tail = huffman.decode(stream, points[k:], len(ids) - k * huffman.STEP, sym, size)
            assert (tail == ids[k * huffman.STEP :]).all()


def test_package_merge_is_optimal_without_a_limit():
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21])
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert (counts * huffman.code_lengths(counts)).sum() == cost
    assert huffman.code_lengths(counts, 3).max() == 3 and sum(2.0**-x for x in huffman.code_lengths(counts, 3)) == 1


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_memo_gives_the_librarys_ids(name, kind):
    rng = random.Random(7)
    parts = ["a", "B", " ", "  ", "\n", "\t", "\x0b", "\r", "0", "12", "é", "é", " ", "日本", "\x1c", "\x85", ".", ",", "'s", "'", "!", "İ", "ß", "👍", "<|endoftext|>", " the", " of", "word", "Word,", "\x00", "٣", "²", "…"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))).encode() for _ in range(3000)]
    memo = tokens.memo(tokens.default_path(name), kind)
    before, tokens.MOST = tokens.MOST, 500
    try:
        for i in range(0, 3000, 300):
            assert memo.encode(texts[i : i + 300]) == memo.whole(texts[i : i + 300])
    finally:
        tokens.MOST = before


def brute_mix(data):
    """Copies of each (id, text, source), by definition: targets by water-filling, copies by Pareto order."""
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, room = {}, set(order), float(sum(sizes.values()))
    while True:
        total = sum(weight[s] for s in free)
        full = {s for s in free if total and room * weight[s] / total > 3 * sizes[s]}
        if not full:
            target |= {s: room * weight[s] / total for s in free}
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            room -= 3 * sizes[s]
        free -= full
    out = Counter()
    for s in order:
        mine = [(i, t, len(words(t))) for i, t, x in data if x == s]
        lo, hi = 0.0, 4.0
        for _ in range(200):
            c = (lo + hi) / 2
            lo, hi = (c, hi) if sum(n * min(3, c * max(1, n.bit_length())) for *_, n in mine) < target[s] else (lo, c)
        times = lambda n: min(3.0, hi * max(1, n.bit_length())) if sizes[s] else 0.0
        if target[s] >= 3 * sizes[s] - 1e-6:
            times = lambda n: 3.0 if sizes[s] else 0.0
        need, ranked = target[s], []
        for i, t, n in mine:
            whole = int(times(n) + 1e-9)
            p = max(0.0, times(n) - whole)
            need -= whole * n
            key = str(i) if i is not None else "null:" + hashlib.md5((t or "").encode()).hexdigest()
            u = (int(hashlib.md5(f"mix-1:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            ranked.append((u / (1 - u) / (p / (1 - p)) if p > 1e-9 else None, i, n, t, whole))
        for odds, i, n, t, whole in sorted(ranked, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2])):
            extra = odds is not None and need > 1e-6 and 2 * need >= n
            if odds is not None:
                need -= n
            out[i, t, s] += whole + extra
    return out


def test_pipeline_by_brute_force(spark, tmp_path):
    """Every stage, and the whole, against what its contract says of the rows that the stage before kept."""
    import corpus_pipeline

    data = [r for r in rows(3000)]
    frame(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    docs = frame(spark, data)
    seen = lambda df: Counter((r.doc_id, r.text, r.source) for r in df.collect())
    kept = stages["quality_rules"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    left = Counter()
    for r, v in zip(data, brute_verdicts([(r[1], r[2]) for r in data])):
        left[r[0], r[1], r[3]] += v[1]
    left = +left
    assert seen(kept) == left
    exact = stages["exact_dedup"](spark, kept, str(tmp_path))
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = defaultdict(list)
    for r, n in left.items():
        groups[norm(r[1])] += [r] * n
    want = Counter(min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0)) for g in groups.values())
    assert exact.columns == docs.columns and seen(exact) == want
    near = stages["simhash_near_dedup"](spark, exact, str(tmp_path))
    items = list(want)
    prints = [brute_fingerprint(r[1]) for r in items]
    of = list(range(len(items)))
    for _ in items:
        of = [min(of[b] for b in range(len(items)) if bin(prints[a] ^ prints[b]).count("1") <= 2) for a in range(len(items))]
    first = {}
    for r, k in sorted(zip(items, of), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        first.setdefault(k, r)
    left = Counter(first.values())
    assert near.columns == docs.columns and seen(near) == left
    mixed = stages["mix_sources"](spark, near, str(tmp_path))
    times = +brute_mix(list(left.elements()))
    assert mixed.columns == docs.columns and seen(mixed) == times
    tok = tokens.memo(tokens.default_path("byte_bpe_50k.json"), "bytes").tok
    pieces = Counter()
    for (i, t, _), n in times.items():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        head = len(ids) - 1024 * ((len(ids) - 1) // 1024)
        for p, (lo, hi) in enumerate(zip([0, *range(head, len(ids), 1024)], range(head, len(ids) + 1, 1024))):
            pieces[i, p, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())] += n
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == pieces
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append(r)
    assert all(sum(r.length for r in s) <= 1024 for s in by.values())


@pytest.mark.parametrize("data", [[], [(i, None, None, None, None, *[None] * 10) for i in (1, None, 2)]], ids=["empty", "nulls"])
def test_pipeline_of_nothing(spark, tmp_path, data):
    import corpus_pipeline

    docs = frame(spark, data) if data else frame(spark).limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_only_known_modules():
    assert {m.__name__.rpartition(".")[2] for m in (classlm, exact_dedup, htmlcrf, huffman, langid, mixing, packing, quality, simhash)} <= {f[:-3] for f in os.listdir(os.path.dirname(quality.__file__))}

"""Expected values of scans, bands, folds, refreshes and residue rules, written out."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import geometry as G
from quillspark.functions import similarity
from quillspark.functions import text as T
from quillspark.operators import chunks, layout, masking, ordered, pagewise, policies
from quillspark.sources import readers


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def cells(spark, rows):
    return spark.createDataFrame([(1, 0, c, float(y) - 4, float(y) + 4) for c, ys in rows.items() for y in ys], "doc_id long, page int, cluster string, y1 double, y2 double")


def test_rows_are_shared_within_the_tolerance_not_by_a_grid(spark):
    got = policies.shared_rows(cells(spark, {"a": [4.9, 14.9, 24.9], "b": [5.1, 15.1, 25.1], "c": [100, 110, 120]}), 10.0, 2).collect()
    assert [(r.a, r.b, r.rows) for r in got] == [("a", "b", 2)]  # 4.9 and 14.9 are one band (10 apart), 24.9 another


def test_three_far_rows_are_shared(spark):
    got = policies.shared_rows(cells(spark, {"a": [0, 50, 100, 100, 101], "b": [10, 40, 110], "c": [0, 61, 100]}), 10.0).collect()
    assert sorted((r.a, r.b, r.rows) for r in got) == [("a", "b", 3)]


def test_bands_by_fold_equal_bands_in_python(spark):
    rng = random.Random(1)
    for _ in range(5):
        values = [round(rng.uniform(0, 200), 1) for _ in range(40)]
        assert spark.range(1).select(policies.bands(F.array(*map(F.lit, values)), 10.0)).first()[0] == pagewise.bands(values, 10.0)


def test_extractions_wait_for_a_slot_and_late_results_are_dropped(spark):
    rows = [("x", 1, 0, 30), ("x", 2, 0, 5), ("x", 3, 1, 20), ("x", 4, 2, 1), ("y", 1, 7, 21)]
    got = {(r.lane, r.seq): (r.start, r.end, r.late) for r in policies.finished(spark.createDataFrame(rows, "lane string, seq long, asked long, seconds long")).collect()}
    # 3 starts when 2 ends; 4 waits for 3, as 1 keeps its slot beyond the limit.
    assert got == {("x", 1): (0, 30, True), ("x", 2): (0, 5, False), ("x", 3): (5, 25, False), ("x", 4): (25, 26, False), ("y", 1): (7, 28, True)}


def test_refresh_clears_the_failures_of_its_page_only(spark):
    failures, page = (spark.createDataFrame([(h,) for h in x], "hash string") for x in ("abc", "bd"))
    kept = lambda level: sorted(r.hash for r in policies.refreshed_failures(failures, page, level).collect())
    assert kept("none") == ["a", "b", "c"] and kept("normal") == ["a", "c"] and kept("force") == []


def test_repairs_are_taken_only_if_valid_and_clean(spark):
    old = spark.createDataFrame([("1", "old"), ("2", "old"), ("3", "old"), ("4", "old")], "id string, text string")
    new = spark.createDataFrame([("1", "good"), ("2", ""), ("3", "still bad")], "id string, text string")
    got = policies.accept_repair(old, new, F.col("new") != "", ~F.col("new").contains("bad"))
    assert {r.id: r.text for r in got.collect()} == {"1": "good", "2": "old", "3": "old", "4": "old"}


SOURCE = "The patients were followed for two years and the outcome was recorded at every visit of the study."
HAN = "患者被随访两年并在每次访视时记录结果"


@pytest.mark.parametrize(
    "source, text, translated, mixed",
    [
        (SOURCE, HAN * 3, True, False),
        (SOURCE, "", False, False),
        (SOURCE, SOURCE, False, False),
        (SOURCE, HAN * 6 + " were followed for two years and the outcome was recorded at every visit of the study", False, True),
        (SOURCE, HAN * 6 + " the outcome was recorded at every visit", True, False),  # seven words: under twelve
        ("Only five words are here", "anything at all", True, False),
        ("Anna B. Smith, Carl D. Jones, Emma F. Brown", "Anna B. Smith, Carl D. Jones, Emma F. Brown", True, False),
        (SOURCE * 3, HAN, False, False),  # a stub of a long source
        ("A short sentence of seven words here", "结果 sentence of seven", False, False),
        ("A short sentence of seven words here", "这是一个译文 seven", True, False),
    ],
)
def test_translated_or_not(spark, source, text, translated, mixed):
    assert one(spark, similarity.looks_translated(F.col("s"), F.col("t"), F.lit("zh-CN")), s=source, t=text) is translated
    assert one(spark, similarity.copied_residue(F.col("s"), F.col("t")), s=source, t=text) is mixed


@pytest.mark.parametrize("text, want", [("and then they all went home", True), ("and then they all went", False), ("and then THEY all went home", False), ("结果 and then (they) all, went home. 结束", True), ("and then don't all went home", False), ("see http://and.then/they all went home again", False), ("a and then they all went home", True)])
def test_six_plain_words_are_residue(spark, text, want):
    assert one(spark, similarity.english_residue(F.col("t")), t=text) is want


@pytest.mark.parametrize("words, han, had, want", [(8, 81, True, True), (8, 80, True, False), (7, 500, True, False), (100, 240, True, False), (100, 241, True, True), (8, 81, False, False)])
def test_context_bleed_limits(spark, words, han, had, want):
    assert one(spark, T.context_bleed(F.col("w"), F.col("t"), F.col("h")), w=words, t="译" * han, h=had) is want


@pytest.mark.parametrize("text, kind, want", [("[12, 13]", "paragraph", True), ("(3–5).", "paragraph", True), ("exactly 12 c", "paragraph", True), ("Exactly 13 ch", "paragraph", False), ("continues the sentence of another block", "paragraph", True), ("Begins on its own.", "paragraph", False), ("x", "heading", False), ("  ", "paragraph", False)])
def test_shards(spark, text, kind, want):
    assert one(spark, T.shard(F.col("t"), F.col("k")), t=text, k=kind) is want
    assert pagewise.is_shard(pagewise.Item("i", pagewise.Box(0, 0, 1, 1), text, kind)) is want


def test_glyphs_become_text(spark):
    def glyph(pos, c, space=False, line=False, ignorable=None):
        return ("d", 0, pos, c, (0.0, 0.0, 5.0, 10.0), "F", 10.0, ignorable, space, line, False)

    rows = [glyph(0, "t"), glyph(1, "w"), glyph(2, "o"), glyph(3, "-", line=True), glyph(4, "p"), glyph(5, "x", ignorable=True), glyph(6, "s", space=True), glyph(7, "中", line=True), glyph(8, "文")]
    assert readers.page_text(readers.glyphs(spark.createDataFrame(rows, readers.CHARS))).first().text == "twops 中文"


def test_span_files_give_rows(spark):
    files = spark.createDataFrame([("d", 3, 612.0, 792.0, [("a", [1.0, 2.0, 3.0, 12.5], None), ("b", [4.0, 2.0, 6.0, 12.0], 9.0)])], readers.SPAN_FILE)
    got = [(r.doc_id, r.page, r.pos, r.text, r.rect.x1, r.font_size) for r in readers.span_rows(files).collect()]
    assert got == [("d", 3, 0, "a", 1.0, 10.5), ("d", 3, 1, "b", 4.0, 9.0)]


def test_pages_follow_without_a_mark(spark):
    rows = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, None), (2, 0, "z")], "doc_id long, page int, text string")
    assert {r.doc_id: r.text for r in readers.whole_text(rows).collect()} == {1: "ac", 2: "z"}


def test_gaps_and_gutters(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("x1", "y1", "x2", "y2"), v)])
    a, b = box(0, 0, 100, 50), box(120, 20, 220, 90)
    value = lambda c: spark.range(1).select(c).first()[0]
    assert value(G.gap_x(a, b)) == 20 and value(G.gap_y(a, b)) == 0 and value(G.gap_y(a, box(0, 70, 9, 80))) == 20 and value(G.share_x(a, box(50, 0, 90, 1))) == 1
    assert value(G.in_gutter(a, b, F.array(box(105, 30, 115, 40)))) and not value(G.in_gutter(a, b, F.array(box(105, 51, 115, 60))))
    assert value(G.in_gutter(a, b, F.array(box(105, 51, 115, 60)), 2.0)) and not value(G.in_gutter(a, box(90, 0, 200, 50), F.array(box(0, 0, 500, 500))))


def test_longest_literals_come_first(spark):
    c = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(t).alias("text")) for i, t in enumerate(["ab", "abcd", "cd", "wxyz", "a"])])
    assert spark.range(1).select(layout.longest_first(c)).first()[0] == ["abcd", "wxyz", "ab", "cd", "a"]


@pytest.mark.parametrize("run", ["x = y + z / 2", "a_b^c = {d}", "∑", "E=mc", "12%", "alpha beta = gamma delta + (x)", "α ≤ β", "=+-", "a=b=c=d", "word = (other)"])
def test_formula_rules_agree(spark, run):
    assert one(spark, T.formula_run(F.col("t")), t=run) is masking.is_formula(run)


def test_masking_skips_only_texts_without_runs(spark):
    texts = ["plain words only", "n = 12 of them", "as shown [3]", "5 ± 2", "costs $x$ more", "<b0>bold</b0> word", "⟦PM3⟧ stays", None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("m", masking.protect_udf(F.col("t"))).withColumn("back", masking.restore_udf(F.col("m.text"), F.col("m.placeholders"))).collect()
    for r in rows:
        text, found = masking.protect(r.t or "")
        assert (r.m.text, [(p.token, p.original) for p in r.m.placeholders], r.m.prose) == (text, found, masking.prose(r.t or "")) and r.back == (r.t or "")


def test_a_long_key_streams_through_in_order(spark):
    n = 60_000
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("seq"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("key"))
    seen = ordered.fold(rows, ["key"], ["seq"], "seq long, place long", lambda: {"n": 0}, lambda s, r: [s.update(n=s["n"] + 1) or {"seq": r["seq"], "place": s["n"]}])
    wrong = seen.selectExpr("key", "seq", "place", "row_number() over (partition by key order by seq) as want").filter("place <> want").count()
    assert wrong == 0 and seen.count() == n
    total = ordered.fold(rows, ["key"], ["seq"], "rows int", lambda: {"rows": 0}, lambda s, r: s.update(rows=s["rows"] + 1) or (), lambda s: [s])
    assert {r.key: r.rows for r in total.collect()} == {"a": n - n // 3, "b": n // 3}
    assert ordered.fold(rows.limit(0), ["key"], ["seq"], "rows int", dict, lambda s, r: (), lambda s: [{"rows": 1}]).collect() == []


def test_chunks_of_a_long_document(spark):
    sizes = [random.Random(4).choice((10, 500, 3000, 9000)) for _ in range(3000)]
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "doc_id long, ord int, n int")
    want, chunk, used, count = [], 0, 0, 0
    for n in sizes:
        if count and (used + n > 8000 or count == 24):
            chunk, used, count = chunk + 1, 0, 0
        used, count = used + n, count + 1
        want.append(chunk)
    got = chunks.greedy(rows, ["doc_id"], ["ord"], F.col("n")).orderBy("ord").collect()
    assert [r.chunk for r in got] == want

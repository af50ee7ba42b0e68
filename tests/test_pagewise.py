from quillspark.operators import chunks
from quillspark.operators import pagewise as P

B = P.Box


def it(i, x1, y1, x2, y2, text="some body text here", **kw):
    return P.Item(i, B(x1, y1, x2, y2), text, **kw)


def test_rows_from_baselines():
    rows = P.baseline_rows([it("b", 50, 100, 80, 110), it("a", 10, 101, 40, 111), it("c", 10, 80, 40, 90)])
    assert [[i.id for i in r] for r in rows] == [["a", "b"], ["c"]]


def test_bands_keep_their_first_member_as_anchor():
    assert P.bands([0, 6, 11, 30], 10) == [0, 11, 30]


def test_two_columns_and_gutter():
    left, right = [B(50, y, 290, y + 10) for y in range(100, 300, 12)], [B(310, y, 550, y + 10) for y in range(100, 300, 12)]
    assert P.columns(left + right, 612, 792) == [(50, 290), (310, 550)]
    assert P.gutters([[a, b] for a, b in zip(left, right)], 612) == [300]
    assert P.gutters([[left[0], right[0]]] * 5, 612) == []
    assert P.assign_columns([left[0], right[0], B(60, 0, 280, 1), B(50, 0, 550, 1)]) == [0, 1, 0, 2]


def test_bridged_chain_splits_at_its_channel():
    boxes = [B(50, y, 290, y + 10) for y in range(0, 200, 12)] + [B(300, y, 550, y + 10) for y in range(0, 200, 12)] + [B(200, 500, 400, 510)]
    assert len(P.columns(boxes, 612)) == 2


def test_regions_grow_and_keep_apart():
    a, b, c = it("a", 50, 100, 290, 140, "first part of"), it("b", 50, 55, 290, 98, "a sentence goes on."), it("c", 310, 100, 550, 140, "other column")
    out = P.coalesce([a, b, c])
    assert [i.members or [i.id] for i in out] == [["a", "b"], ["c"]] and out[0].text == "first part of a sentence goes on."
    far = it("d", 50, 10, 290, 30, "Far below it stands alone.")
    assert len(P.coalesce([a, far])) == 2


def test_hyphens_and_blank_lines():
    a, b = it("a", 0, 50, 100, 60, "two-"), it("b", 0, 38, 100, 48, "part")
    assert P.fuse(a, b).text == "twopart"
    assert P.separator(it("a", 0, 50, 100, 60, "Done."), it("b", 0, 30, 100, 40)) == "\n\n"
    assert P.separator(it("a", 0, 50, 100, 60, "Done."), it("b", 0, 38, 100, 48)) == " "


def test_caption_takes_nearest_and_shards_go_home():
    cap = it("c", 50, 100, 290, 110, "Figure 1. A thing", type="caption")
    low, near = it("l", 60, 70, 280, 84, "and the end of it."), it("n", 60, 86, 280, 98, "with more words")
    out = P.coalesce([cap, low, near])
    assert out[0].members == ["c", "n", "l"]
    host, shard = it("h", 50, 100, 290, 140, "A full sentence of the host."), it("s", 50, 70, 290, 80, "[12]")
    assert P.is_shard(shard) and [i.members for i in P.coalesce([host, shard])] == [["h", "s"]]


def test_modules():
    blocks = [it("h", 0, 0, 1, 1, "Methods", type="heading", column=0), it("p", 0, 0, 1, 1, column=0), it("q", 0, 0, 1, 1, column=1), it("f", 0, 0, 1, 1, "Figure 1", type="caption", column=1), it("r", 0, 0, 1, 1, "References", type="heading", column=1), it("x", 0, 0, 1, 1, type="heading", column=1)]
    assert [(k, m) for _, k, m in P.modules(blocks)] == [("heading", ["h", "p"]), ("column-continuation", ["q"]), ("figure", ["f"]), ("references", ["r", "x"])]


def test_table_grid_and_numeric_columns():
    cells = [it(f"{r}{c}", 60 + 90 * c, 100 + 16 * r, 110 + 90 * c, 110 + 16 * r, ["Name", "n"][c] if r == 0 else ["Alpha beta", "1.5"][c]) for r in range(5) for c in range(2)]
    found = P.tables([i for i in cells if P.tabular(i.text)] + [i for i in cells if not P.tabular(i.text)], 10)
    assert len(found) == 1
    grid = {(c["row"], c["col"]): c for c in P.grid(cells)}
    assert len(grid) == 10 and grid[0, 0]["kind"] == "text" and grid[3, 1]["kind"] == "data" and grid[2, 0]["text"] == "Alpha beta"


def test_wide_table_with_far_columns_is_one():
    cells = [it(f"{r}{c}", x, 100 + 16 * r, x + 30, 110 + 16 * r, f"{r}.{c}") for r in range(4) for c, x in enumerate((50, 125, 200))]
    assert len(P.tables(cells, 10)) == 1


def test_flow_sweep_and_push():
    items = [{"id": "a", "column": 0, "top": 10, "height": 30, "left": 0, "width": 100}, {"id": "b", "column": 0, "top": 20, "height": 10, "left": 0, "width": 100}, {"id": "c", "column": 0, "top": 500, "height": 10, "left": 0, "width": 100, "anchor": False}]
    got = {p["id"]: p["top"] for p in P.flow(items, [{"column": 0, "top": 45, "bottom": 60}], 792, 4)}
    assert got == {"a": 10, "b": 60, "c": 74}
    assert [p["top"] for p in P.push_down(items, 4)] == [10, 44, 500]
    assert P.sweep([("a", B(0, 0, 100, 20)), ("b", B(0, 10, 100, 30)), ("s", B(95, 5, 200, 15))], [], 4) == {"a": 0, "s": 5, "b": 24}


def test_ink_and_images():
    ink = [[False] * 5, [False, True, False, False, False], [False, False, True, False, False], [False] * 5, [True] * 5]
    assert P.ink_spans(ink, 10, 0, 4) == [(10, 30, 10, 30)]
    ops = [{"op": "save"}, {"op": "transform", "m": [100, 0, 0, 50, 10, 20]}, {"op": "paint"}, {"op": "restore"}, {"op": "transform", "m": [5, 0, 0, 5, 0, 0]}, {"op": "paint"}]
    assert P.image_boxes(ops) == [B(10, 20, 110, 70)]


def test_sentences_wrapping_and_fitting():
    assert P.sentences("See Fig. 2 for more. It works! 是的。好 e.g. this; That.") == ["See Fig. 2 for more.", "It works!", "是的。", "好 e.g. this;", "That."]
    assert P.wrap("aaa bbb ccc", 7, len) == ["aaa bbb", "ccc"] and P.wrap("abcdefgh", 3, len) == ["abc", "def", "gh"]
    size, lines, clipped = P.fit("one two three four five six seven", 60, 30, 10, 8, lambda s, f: len(s) * f * 0.6)
    assert clipped and lines[-1].endswith("…") and size >= 8
    assert P.distribute("One one. Two two. Three.", [1, 1]) == ["One one.", "Two two. Three."]


def test_formula_glyphs():
    glyphs = [{"c": c, "font": 10} for c in "ab "] + [{"c": c, "font": 10, "font_name": "CMMI10"} for c in "xy"] + [{"c": "(", "font": 10}, {"c": "t", "font": 10, "font_name": "CMMI10"}, {"c": ")", "font": 10}, {"c": " ", "font": 10}, {"c": "z", "font": 10}]
    assert P.formula_runs(glyphs, 10) == ["xy(t)"]


def test_column_runs():
    lines = [B(50, 100, 290, 110), B(50, 88, 290, 98), B(310, 100, 550, 110)]
    assert [len(r) for r in P.column_runs(lines)] == [2, 1]


def test_results_do_not_depend_on_partitions(spark):
    from quillspark.plans import state_queries as Q

    rows = [(d, p, o, f"text {o}.", 50.0, 700.0 - 12 * o, 290.0, 710.0 - 12 * o) for d in range(4) for p in range(2) for o in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, page int, ord int, text string, x1 double, y1 double, x2 double, y2 double")

    def run(page):
        for n, i in enumerate(P.coalesce([P.item(r) for r in page])):
            yield {"region": n, "chars": len(i.text)}

    schema = "doc_id long, page int, region int, chars int"
    a = sorted(map(tuple, P.run(df.repartition(1), run, schema).collect()))
    assert a == sorted(map(tuple, P.run(df.repartition(8).orderBy("x1"), run, schema).collect())) and a
    assert Q.queries()


def test_module_pack_and_sentence_split():
    assert chunks.module_pack([[10, 10], [10, 90], [95]], 100, 24) == [[(0, 0), (0, 1)], [(1, 0), (1, 1)], [(2, 0)]]
    assert chunks.module_pack([[60, 60], [10]], 100, 24) == [[(0, 0)], [(0, 1), (1, 0)]]
    assert chunks.split_sentences("aa. bb. cc.", 8) == ["aa. bb. ", "cc."] and "".join(chunks.split_sentences("x" * 25, 10)) == "x" * 25

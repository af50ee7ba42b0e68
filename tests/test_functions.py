"""Rules on small inputs with hand-made expectations."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import hashing, similarity
from quillspark.functions import text as T
from quillspark.operators import chunks, exchange, layout, policies
from quillspark.sources import readers


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


@pytest.mark.parametrize("text, want", [("1234", "other"), ("ab", "other"), ("结果显示该方法", "zh"), ("plain words here", "en"), ("Ελληνικά κείμενο", "other"), ("结果 with some words in it", "en")])
def test_language(spark, text, want):
    assert one(spark, T.language(T.stats(F.col("t"))), t=text) == want


@pytest.mark.parametrize(
    "text, want",
    [("  ", "empty"), ("Received: 2 May 2020", "label"), ("open access", "banner"), ("supported by grant no. AB-1", "grant"), ("1, 2, 3", "marks"), ("A Bee MD, C Dee PhD, E Eff MSc", "degrees"), ("was accepted by us on 3 May 2020", "dates"), ("under a creative commons deed", "copyright"), ("write to a.b@c.org", "correspondence"), ("https://x.org/y", "doi"), ("Department of Things", "affiliation"), ("The results of this study were clear.", None)],
)
def test_metadata(spark, text, want):
    assert one(spark, T.metadata_reason(F.col("t")), t=text) == want


def test_shapes(spark):
    assert one(spark, T.ends_sentence(F.col("t")), t="He left.”") and not one(spark, T.ends_sentence(F.col("t")), t="He left:")
    assert one(spark, T.ordered_list_start(F.col("t")), t="1. item") and not one(spark, T.ordered_list_start(F.col("t")), t="1.1 item")
    assert one(spark, T.tabular(F.col("t")), t="12.5 ± 3 | 4%") and not one(spark, T.tabular(F.col("t")), t="A full sentence about nothing in particular that goes on.")
    assert one(spark, T.redact(F.col("t")), t="Authorization: Bearer abcdefghij and sk-ant-abcdefghijkl") == "Authorization: [REDACTED] and [REDACTED]"
    assert one(spark, T.unescape_html(T.escape_html(F.col("t"))), t="<a href='x'>&</a>") == "<a href='x'>&</a>"
    assert one(spark, T.join_fragments(F.col("a"), F.col("b")), a="exam-", b=" ple") == "example" and one(spark, T.join_fragments(F.col("a"), F.col("b")), a="中", b="文") == "中文"


def test_two_lane_hash(spark):
    def brute(text):
        a, b = 0x811C9DC5, 0xCBF29CE4
        units = text.encode("utf-16-le")
        for i in range(len(units) // 2):
            c = units[2 * i] | units[2 * i + 1] << 8
            a = (a ^ c) * 0x01000193 & 0xFFFFFFFF
            b = (b ^ ((c * 31 + i & 0xFFFF) ^ (c >> 8))) * 0x01000197 & 0xFFFFFFFF
        return f"{a:08x}{b:08x}"

    for t in ("", "hello", "日本語", "a\U0001f600b", "x" * 500):
        assert one(spark, hashing.two_lane(F.col("t")), t=t) == brute(t)
    assert one(spark, hashing.two_lane(F.col("t")), t="hello").startswith("4f9f2cab")


def test_similarity(spark):
    assert similarity.multiset_dice("night", "nacht") == 0.25 and similarity.multiset_dice("aaa", "aa") == pytest.approx(2 / 3)
    src = "The patients were followed for two years and the outcome was recorded at every visit of the study."
    cases = {src: False, "患者被随访两年，并在研究的每次访视时记录结果，这是完整的译文内容。": True, "患": True, "患者被随访 followed for two years and the outcome was recorded at every visit of the study 结果": False}
    for t, want in cases.items():
        assert one(spark, similarity.looks_translated(F.col("s"), F.col("t"), F.lit("zh-CN")), s=src, t=t) is want
    assert one(spark, similarity.looks_translated(F.col("s"), F.col("t"), F.lit("zh-CN")), s=src * 3, t="患") is False
    assert one(spark, similarity.looks_translated(F.col("s"), F.col("t"), F.lit("de")), s=src, t="x") is True
    assert one(spark, similarity.copy_dominant(F.col("s"), F.col("t")), s=src, t=src.upper() + "!") is True
    assert one(spark, similarity.english_residue(F.col("t")), t="结果 and then they all went home 结束") is True
    pairs = one(spark, similarity.term_pairs(F.col("s"), F.col("t")), s="RCT of HF", t="随机对照试验 (RCT) 和 心力衰竭（HF） 置信区间 (CI)")
    assert [(p["source"], p["target"]) for p in pairs] == [("RCT", "随机对照试验"), ("HF", "心力衰竭")]


def test_chunk_fold(spark):
    got = spark.sql("select array(5000, 2000, 2000, 9000) as s").select(chunks.fold(F.col("s"))).first()[0]
    assert got == [0, 0, 1, 2]
    assert spark.range(1).select(chunks.fold(F.array_repeat(F.lit(1), 50))).first()[0] == [0] * 24 + [1] * 24 + [2] * 2


def test_medians(spark):
    m = lambda *x: spark.range(1).select(layout.upper_median(F.array(*map(F.lit, x)))).first()[0]
    assert m(7.0, 8.5, 10.0, 10.0) == 10.0 and m(3.0) == 3.0
    rows = spark.createDataFrame([(1, 0, s) for s in (8.5, 10.0, 8.4, 10.1)], "doc_id int, page int, font double")
    assert layout.dominant_size(rows, F.col("font")).first()["dominant"] == 10.0


def test_answers():
    assert exchange.entries('noise ```json\n{"translations":[{"id":"a","translatedText":"x"},{"id":1}]}\n```') == [{"id": "a", "text": "x"}]
    assert exchange.entries('{"translations":[{"id":"a","transl') is None and exchange.entries("none") is None
    assert exchange.entries('say {"translations":[{"id":"a","translatedText":"}{"}]} end') == [{"id": "a", "text": "}{"}]
    assert exchange.plain_answer('Translation: "hello"') == "hello" and exchange.plain_answer("Please provide the text") is None and exchange.plain_answer("") is None
    assert exchange.plain_answer('{"translations":[{"id":"a","translatedText":"x"}]}') == "x"


def test_ladder_answers_everything_once(spark):
    rows = [(f"b{i}", f"text number {i % 30}") for i in range(60)]
    got = exchange.ladder(spark.createDataFrame(rows, "id string, text string")).collect()
    assert len(got) == 60 and {r.id for r in got} == {i for i, _ in rows} and max(r.round for r in got) > 0


def test_caches(spark):
    base = {k: "x" for k in exchange.KEY}
    schema = ", ".join(f"{k} string" for k in exchange.KEY) + ", schema_version int, translations array<struct<id: string, text: string>>, created_at long"
    row = lambda page, v, t, at: tuple({**base, "page": page}.values()) + (v, t, at)
    cache = spark.createDataFrame([row("1", 5, [("a", "old")], 1), row("1", 5, [("a", "new")], 2), row("2", 4, [("a", "x")], 1), row("3", 5, [("a", None)], 1)], schema)
    asked = spark.createDataFrame([tuple({**base, "page": p}.values()) for p in ("1", "2", "3", "4")], ", ".join(f"{k} string" for k in exchange.KEY))
    got = {r.page: r.translations and r.translations[0].text for r in exchange.page_hits(asked, cache).collect()}
    assert got == {"1": "new", "2": None, "3": None, "4": None}


def test_readers(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"source": "s", "page": 1, "pageWidth": 612, "pageHeight": 792, "items": [{"text": "a", "rect": [0, 0, 10, 9]}, {"text": "b", "rect": [0, 0, 10, 9], "fontSize": 7}]}')
    assert [(r.text, r.font_size) for r in readers.spans(spark, str(tmp_path / "p.json")).collect()] == [("a", 9.0), ("b", 7.0)]
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "ok").write_bytes(b"hello")
    (tmp_path / "bin" / "bad").write_bytes(b"\xff")

    def parser(content):
        return [{"page": 0, "page_width": 1.0, "page_height": 1.0, "pos": 0, "text": content.decode(), "rect": {"x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0}, "font_size": 1.0}]

    got = readers.documents_of(spark, str(tmp_path / "bin"), parser).collect()
    assert sorted((r.text or "", bool(r._corrupt)) for r in got) == [("", True), ("hello", False)]
    rules = readers.glossary_json(spark.createDataFrame([('[{"source": " a ", "target": "b"}, {"source": "", "target": "x"}, {"source": "c", "target": "d", "mode": "suggested"}]',), ("broken",)], "json string"))
    assert sorted(map(tuple, rules.collect())) == [("a", "b", "required"), ("c", "d", "suggested")]


def test_policies(spark):
    assert policies.explanation_sections("1. **Summary**: a\nmore\nMethod - b", ("Summary", "Method")) == [("Summary", "a\nmore"), ("Method", "b")]
    assert policies.explanation_sections("just text", ("Summary",)) == [("", "just text")]
    old = spark.createDataFrame([('{"provider": "p", "model": "m"}',), ('{"profiles": [{"provider": "q"}]}',), ("{",)], "json string")
    assert sorted(r.provider for r in policies.profiles(old).collect()) == ["p", "q"]
    assert one(spark, policies.rejected_parameter(F.col("t")), t="Unsupported parameter: 'temperature' is not supported") == "temperature"


def test_contract(spark):
    schema = "doc_id int, page int, ord int, id string, reading_index int, table_row int, table_col int, x1 double, y1 double, x2 double, y2 double, member_ids array<string>, mode string, placeholders array<string>"
    rows = [(1, 0, 0, "a", 0, None, None, 0.0, 0.0, 1.0, 1.0, None, None, None), (1, 0, 1, "a", 5, 1, None, 0.0, 0.0, 0.0, 1.0, [], "preserve", ["x"])]
    got = sorted(r.rule for r in layout.contract(spark.createDataFrame(rows, schema)).collect())
    assert got == ["duplicate id", "duplicate id", "empty box", "half a table cell", "no members", "preserved block with placeholders", "reading index not dense"]

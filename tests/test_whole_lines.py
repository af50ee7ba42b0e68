"""x10_span_text joins whole block texts."""

import re

from quillspark.plans import layout_queries, pages


def test_lines_hold_whole_texts(spark, tmp_path):
    texts = ["\n".join(f"line {i} of  document {d} with\tmore than twelve characters" + (" 中文" if i % 2 else "") for i in range(9)) for d in range(6)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for b in sorted(pages.blocks(spark, str(tmp_path)).collect(), key=lambda b: (b.doc_id, b.page, b.x1, b.ord)):
        out, right = want.get((b.doc_id, b.page), ("", None))
        joined = re.search("[一-鿿]$", out) and re.match("[一-鿿]", b.text)
        if right is not None and b.x1 - right > 1.8 and not re.search(r"\s$", out) and not joined:
            out += " "
        want[b.doc_id, b.page] = out + b.text, b.x1 + b.k % 90
    got = {(r.doc_id, r.page): r.value for r in layout_queries.line_texts(spark, str(tmp_path)).collect()}
    assert got == {k: re.sub(r"\s+", " ", t).strip() for k, (t, _) in want.items()}
    assert any("with more than twelve characters" in v for v in got.values())


def test_only_ideographs_join_without_a_space(spark):
    from pyspark.sql import functions as F

    from quillspark.functions import geometry

    def value(*texts):
        items = F.array(*[F.struct(F.lit(20.0 * i).alias("x1"), F.lit(20.0 * i + 9).alias("x2"), F.lit(t).alias("text")) for i, t in enumerate(texts)])
        return spark.range(1).select(geometry.span_text(items, F.lit(10.0))).first()[0]

    assert value("中", "文") == "中文" and value("组。", "文") == "组。 文" and value("a\t", "b") == "a b" and value("a  b", " c") == "a b c"

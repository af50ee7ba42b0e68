"""m08_expansion has a row for every block that isn't full width."""

from quillspark.plans import pages, policy_queries


def test_pages_without_full_width_blocks(spark, tmp_path):
    texts = ["\n".join(f"line {i}" for i in range(9 + d % 4)) for d in range(20)]  # a last page of a few blocks
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    b = pages.blocks(spark, str(tmp_path)).collect()
    wide = {(x.doc_id, x.page) for x in b if x.column == -1}
    got = {(r.doc_id, r.page, r.ord): r for r in policy_queries.expansion(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted((x.doc_id, x.page, x.ord) for x in b if x.column != -1)
    free = [x for x in b if x.column != -1 and (x.doc_id, x.page) not in wide]
    assert free
    for x in free:  # the page's edge and the size alone bound it
        r = got[x.doc_id, x.page, x.ord]
        assert r.right == max(0, min(612 * 0.9 - x.x2, (x.x2 - x.x1) * 0.6))
        assert r.down == max(0, min(792 * 0.95 - x.y2, max(x.font * 2.8, (x.y2 - x.y1) * 0.5)))
        assert r.hit is False

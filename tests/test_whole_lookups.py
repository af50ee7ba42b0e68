"""s08_page_cache looks up every document."""

from quillspark.plans import state_queries


def test_page_cache_looks_up_every_document(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i}", f"l{i % 3}", f"src{i % 4}") for i in range(60)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.cached) for r in state_queries.page_cache(spark, str(tmp_path)).collect())
    # No entry, half an entry and another schema version are misses.
    assert got == [(i, f"l{i % 3}" if i % 5 and i % 6 not in (1, 2) else None) for i in range(60)]

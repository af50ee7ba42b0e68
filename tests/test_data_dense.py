"""f28_data_dense counts the digits that 35 % of the letters ask for exactly, as its SQL does."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.plans import text_queries


@pytest.mark.parametrize("letters, least", [(1, 6), (17, 6), (20, 7), (179, 62), (180, 63), (200, 70), (340, 119), (360, 126), (1300, 455), (20_000, 7000)])
def test_least_digits(spark, letters, least):
    rows = spark.createDataFrame([("x" * letters + "7" * n,) for n in (least - 1, least)], "t string")
    assert [r.dense for r in rows.select(T.data_dense(F.col("t")).alias("dense")).collect()] == [False, True]


def test_query_equals_its_sql_at_the_limit(spark, tmp_path):
    # Lines of a document stand alone, behind a sample and before one: all digits around the limit reach it in each place.
    texts = ["\n".join("x" * letters + "7" * (letters * 35 // 100 + k) for k in range(-9, 4)) for letters in range(100, 801, 20)] + [None, "", "12", "no digits"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, text_queries.queries()["f28_data_dense"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        assert got == sorted(c.execute(text_queries.oracle_sql()["f28_data_dense"]).fetchall())
    assert {value for _, _, value in got} == {False, True}

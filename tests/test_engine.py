"""End to end: blocks to stored answers, and a second run that asks nothing."""

from pyspark.sql import functions as F

from quillspark.operators import exchange
from quillspark.plans.engine import Engine

asked: list = []


def rows(spark):
    data = [(1, 0, 0, "A title of the page", 50.0, 60.0, 550.0, 90.0, -1, 20.0, 1, "Bold"), (1, 0, 1, "Left text goes on, with a value (P<0.05) in the middle of a sentence.", 50.0, 100.0, 290.0, 130.0, 0, 10.0, 3, "Body"), (1, 0, 2, "Right text of the other column stands here and is prose.", 310.0, 100.0, 550.0, 130.0, 1, 10.0, 3, "Body"), (1, 0, 3, "Left again, lower on the page than the rest of it.", 50.0, 140.0, 290.0, 170.0, 0, 10.0, 3, "Body"), (1, 0, 4, "12", 300.0, 780.0, 310.0, 790.0, -1, 8.0, 1, "Body"), (1, 0, 5, "© 2020 Somebody", 50.0, 700.0, 290.0, 710.0, 0, 7.0, 1, "Body")]
    return spark.createDataFrame(data, "doc_id int, page int, ord int, text string, x1 double, y1 double, x2 double, y2 double, `column` int, font double, lines int, font_name string")


def test_blocks(spark):
    got = Engine().blocks(rows(spark)).orderBy("reading_index").collect()
    assert [(r.ord, r.type) for r in got] == [(0, "title"), (1, "paragraph"), (3, "paragraph"), (2, "paragraph")]


def test_second_run_asks_nothing(spark):
    engine = Engine(target="de")
    blocks = engine.blocks(rows(spark))
    first = engine.answers(blocks).cache()
    assert first.filter("accepted").count() == 4 and first.filter(F.col("answer").contains("P<0.05")).count() == 1 and first.filter(F.col("answer").contains("PM0")).count() == 0
    store = engine.store(first).cache()
    assert store.count() == 4

    def refuse(batch):
        raise AssertionError("nothing is left to ask")

    again = Engine(target="de", service=exchange.Service("none", refuse)).answers(blocks, store)
    assert {(r.id, r.answer) for r in again.collect()} == {(r.id, r.answer) for r in first.collect()}
    assert engine.report(blocks, first).count() == 1


def test_services():
    assert exchange.batch_answer(["a", "b"], 2) == ["a", "b"] and exchange.batch_answer([["a", "en"]], 1) == ["a"] and exchange.batch_answer("a", 1) == ["a"]
    try:
        exchange.batch_answer(["a"], 2)
        raise AssertionError
    except ValueError:
        pass
    assert exchange.bounded([3, 1, 2], lambda x: x * 2, 2) == [6, 2, 4]
    assert exchange.explain(exchange.SERVICES["stand-in"], "a b") == "b a"

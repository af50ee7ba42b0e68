from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.operators import masking as M

SAMPLE = "The effect (P<0.05, n = 1,234) [12, 13] and 95% CI 1.2–3.4, 2.1 ± 0.3 and $x^2$; E = mc^2 + (a*b)/{c|d} ⟦PM3⟧."


def test_masks_in_order_and_numbers_after_tokens_that_are_there():
    text, found = M.protect(SAMPLE)
    assert [o for _, o in found[:7]] == ["⟦PM3⟧", "$x^2$", "[12, 13]", "P<0.05", "95% CI 1.2–3.4", "2.1 ± 0.3", "n = 1,234"]
    assert found[0][0] == "⟦PM4⟧" and "P<0.05" not in text
    assert M.restore(text, found) == SAMPLE


def test_restores_what_it_masked():
    assert M.restore(*M.protect(SAMPLE)) == SAMPLE


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["P<0.05", "[1, 2]", " (3)", "$a$", "x", " = ", "n=5", "±", "1.5", "⟦PM2⟧", "word ", ".", "\n", "≤", "{|}"]), max_size=14).map("".join))
def test_round_trip(text):
    masked, found = M.protect(text)
    assert M.restore(masked, found) == text
    assert M.verify(masked, found)[0] == [] or any(t in o for t, _ in found for _, o in found)


def test_variants_come_back_once():
    text, found = M.protect("a [12] b")
    token = found[0][0]
    assert M.restore("x [[ PM 0 ]] y", found) == "x [12] y" and token == "⟦PM0⟧"
    assert M.restore("x 【PM０】 y 【PM０】", found) == "x [12] y 【PM０】"
    assert M.restore("x PM0 y", found) == "x [12] y" and M.verify("x PM01", found)[0] == [token]
    assert M.verify("⟦PM0⟧ ⟦PM9⟧", found) == ([], ["⟦PM9⟧"])


def test_formula_runs():
    assert M.is_formula("a ≤ b") and M.is_formula("(a+b)/{c}") and not M.is_formula("plain words = two") and not M.is_formula("ab")


def test_spark_agrees(spark):
    from pyspark.sql import functions as F

    rows = [(SAMPLE,), ("",), (None,), ("no formula",)]
    out = spark.createDataFrame(rows, "t string").withColumn("m", M.protect_udf("t")).withColumn("back", M.restore_udf(F.col("m.text"), F.col("m.placeholders"))).withColumn("fast", M.restore_exact(F.col("m.text"), F.col("m.placeholders")))
    for r in out.collect():
        assert r.back == (r.t or "") and r.fast == (r.t or "")
    reg = M.registry(spark.createDataFrame([("a [12] b", "x ⟦PM0⟧"), ("a [12] b", "x")], "t string, a string"), "t", "a").collect()
    assert sorted((r.accepted, r.restored) for r in reg if r.accepted) == [(True, "x [12]")] and sum(r.accepted for r in reg) == 1


def test_styles():
    assert M.style_runs([("long plain text here", "plain"), ("Key", "bold"), ("Key", "bold"), ("1", "bold")]) == [("Key", "bold")]
    text = M.mark_styles("a Key point", [("Key", "bold")])
    assert text == "a <b0>Key</b0> point" and M.parse_styles(text) == ("a Key point", [("Key", "b")])

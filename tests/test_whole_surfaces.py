"""x17_dice compares whole surfaces, held against brute force."""

from collections import Counter

import pytest

from quillspark.functions import similarity
from quillspark.plans import layout_queries


def brute(a, b):
    x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
    return 2 * sum(min(n, y[g]) for g, n in x.items()) / (len(a) + len(b) - 2)


def test_dice_sees_text_beyond_400_characters(spark, tmp_path):
    opening = " ".join(f"opening{i}" for i in range(60))
    bodies = [" ".join(f"{w}{i}" for i in range(300)) for w in ("alpha", "quick", "zebu")]
    texts = [f"{opening} {b}" for b in bodies] + [f"another start {bodies[2]}"]
    assert len(opening) > 400
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in layout_queries.dice_of_neighbours(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2]
    for i, r in got.items():
        assert r.dice == pytest.approx(brute(texts[i], texts[i + 1])) and r.copied == (r.dice >= 0.82)
    assert not got[0].copied and not got[1].copied  # one opening, other bodies
    assert got[2].copied == (brute(texts[2], texts[3]) >= 0.82)


def test_long_and_short_strings_count_alike():
    for a, b in (("abc " * 200, "bca " * 150), ("aé " * 300, "ae " * 300), ("a" * 900, "a"), ("a" * 900, "aa"), ("x y\x7f" * 200, "y x\x00" * 200)):
        want = brute(a, b) if min(len(a), len(b)) > 1 else 0
        assert similarity.multiset_dice(a, b) == similarity.multiset_dice(b, a) == pytest.approx(want)

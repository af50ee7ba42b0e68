"""A small table with every awkward case, and the helpers of these tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, n string, shard long, doc string, tag string, kept string, h string, fp string, word string"


def prose(rng, n):
    syllables = "an er on the in ti or re st ou".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows(long_words=30_000):
    rng = random.Random(5)
    out = []

    def add(i, text, lang="en", source="s1"):
        out.append((i, text, lang, source, len(text or ""), i and i % 7, "x", None, 3, "d", "t", "k", None, "f", "w"))

    base = [prose(rng, 60) for _ in range(12)]
    for i, t in enumerate(base):
        add(100 + i, t, "en" if i % 2 else "fr", f"s{i % 4}")
    add(5, base[0], "en", "s2")  # exact copy with a smaller id
    add(300, base[1] + " ", "en", "s2")  # equal but for white space, longer
    add(301, base[2].upper(), None, None)
    add(302, base[3] + " extra tail", "de", "s3")
    add(303, base[4][: len(base[4]) // 2] + " " + base[5], "de", "ü")
    add(303, base[6], "de", "ü")  # an id met twice
    add(304, base[7], "de", "ü")
    add(304, base[7], "de", "ü")  # a whole row met twice
    for i, t in ((400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "two words"), (405, " "), (406, "*** ### 1234")):
        add(i, t)
    add(None, base[8])
    add(None, None)
    add(407, "αβγ \U0001f600 日本語 é \x00 x" * 5, None, "S1")
    add(408, prose(rng, long_words) + " " + base[9], "en", "s0")
    add(409, "w" * 50_000, "en", "s0")
    add(410, "a " * 5000, "en", "s0")
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()

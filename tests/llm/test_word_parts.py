"""Words are learnt without the marks that end them; ids are the library's."""

import itertools
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillspark.llm import tokens

RUNS = ["###", "$$$", "%%%", "&&&", "***", ".", "!!", ",###", "?%%%", ".)", '"', "-", "=<>", "|>"]


@pytest.fixture(scope="module")
def path():
    return tokens.default_path("word_bpe_49k.json")


def check(memo, tok, texts):
    got = [np.frombuffer(x, memo.type).tolist() for x in memo.encode([t.encode() for t in texts])]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_is_learnt_once_whatever_ends_it(path):
    memo, tok = tokens.WordMemo(path), Tokenizer.from_file(path)
    words = ["".join(x) for x in itertools.product(("the", "ing", "tion", "é", "sch", "ña", "ł"), repeat=3)]
    check(memo, tok, [" ".join(w + r for w in words) for r in ["", *RUNS]])
    assert len(memo.ids) == len(words) + len(RUNS)


def test_marks_behind_anything(path):
    stems = ["a", "Word", "ÉTÉ", "straße", "it's", "it'", "x×", "y÷", "é", "a1", "7", "Å", "KK", "İ", "ı", "Ⱥa", "Ⱦ", "ǅ", "ª", "µm", "ΣΣ", "ЖЖ", "한", "中", "…", "#", "a#b", "a##̸", "a≮", "\x00", "a\x00", " ", "a ", "", "\U0001d400", "ͅ", "<|ENDOFTEXT", "a" * 40, "é" * 20]
    ends = [*RUNS, "", "'", "'s", "#'s", "'#", "#̸", "≠", "# ", "#\x00", "#" * 5000, "#1", "1#", "#a", "#é#"]
    gaps = [" ", "\n", "\t", "  ", " ̸", " ́", "\r\n", " ", " '"]
    memo, tok = tokens.WordMemo(path), Tokenizer.from_file(path)
    check(memo, tok, [s + e for s in stems for e in ends])
    rng = random.Random(5)
    for _ in range(20):
        check(memo, tok, ["".join(rng.choice(stems) + rng.choice(ends) + rng.choice(gaps) for _ in range(rng.randint(0, 30))) for _ in range(100)])


def test_a_long_run_of_marks(path):
    memo, tok = tokens.WordMemo(path), Tokenizer.from_file(path)
    check(memo, tok, ["a" + "#" * 300_000 + " b", "#" * 300_000])

"""Texts with added tokens, held against the library as it comes."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillspark.llm import huffman, packing, tokens

from .fixture import frame

TEXTS = ["end of it <|endoftext|> next", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "plain text.", "<|ENDOFTEXT|> in capitals", "", "Odd\t<|endoftext|>\n\nspaces", "<|EndOfText|>", "<|endoftext |>", "<|endoftext|", "word, <|endoftext|>."]


def library(name):
    return Tokenizer.from_file(tokens.default_path(name))


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_memo_gives_added_tokens(name, kind):
    memo, tok = tokens.memo(tokens.default_path(name), kind), library(name)
    for texts in (TEXTS, TEXTS[::-1], TEXTS[3:6]):
        got = [np.frombuffer(x, memo.type).tolist() for x in memo.encode([t.encode() for t in texts])]
        assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_operators_give_added_tokens(spark):
    docs = frame(spark, [(i, t, "en", "s", len(t), *[None] * 10) for i, t in enumerate(TEXTS)])
    for op, name, end in ((huffman, "word_bpe_49k.json", 1), (packing, "byte_bpe_50k.json", 2)):
        tok = library(name)
        want = {i: np.array(tok.encode(t, add_special_tokens=False).ids + [end], "<u4") for i, t in enumerate(TEXTS)}
        got = {r.doc_id: r for r in op.report(docs).collect()}
        assert {i: r.ids_crc32 for i, r in got.items()} == {i: zlib.crc32(x.tobytes()) for i, x in want.items()}
        at = 0
        for i, r in sorted(got.items()):
            if op is huffman:
                assert (r.start, r.n_tokens) == (at, len(want[i]))
                at += r.n_tokens
            else:
                assert (r.piece, r.start, r.length) == (0, 0, len(want[i]))

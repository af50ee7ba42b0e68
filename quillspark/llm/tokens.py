"""Token ids of whole texts with the tokenizers library, by way of a bounded memo of words.

Both tokenizers here split a text before merging, and never merge across a white-space boundary. So a text is cut where a cut
cannot matter, each distinct part is encoded once by the library, and the parts' ids are joined; a text with any unusual white
space or an added token is encoded whole. The memo lives in the worker process and never changes a result. It holds two generations of at most ``MOST`` parts (words: twice as many):
when the young one is full it becomes the old one, from which parts come back when they are met again."""

from __future__ import annotations

import gc
import json

import numpy as np
import pandas as pd

MOST = 150_000
#: White space other than single spaces and line feeds (UTF-8), and runs of it.
_ODD = (b"  ", b"\n\n", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], "<u8")
#: Marks that no contraction starts with.
_MARKS = b".,;:!?"


def _spelling() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 on, in order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SPELL = _spelling()
_WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_BREAK = np.isin(np.arange(256), list(b" \n\r"))
_MARK = np.isin(np.arange(256), list(_MARKS))
_LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
#: ASCII marks but the apostrophe, which starts contractions.
_SIGN = np.array([32 < i < 127 and not chr(i).isalnum() and i != 39 for i in range(256)])
#: Code points up to U+024F of a space, and of letters that are their own normal form and whose one small letter takes as many bytes.
_PLAIN = np.array([i == 32 or chr(i).isalpha() and len(chr(i).lower()) == 1 and len(chr(i).lower().encode()) == len(chr(i).encode()) for i in range(0x250)] + [False])
_SPELL_ROW = {b: c for b, c in _SPELL.items() if b != 32}


def single_marks(b: np.ndarray, white: np.ndarray) -> np.ndarray:
    """Where a single mark follows an ASCII letter and ends a word: a part of its own, as no token goes from a letter to a mark."""
    out = np.zeros(len(b), bool)
    mark = np.flatnonzero(_MARK[b])
    mark = mark[mark > 0]
    after = np.minimum(mark + 1, len(b) - 1)
    out[mark[_LETTER[b[mark - 1]] & (white[b[after]] | (mark + 1 == len(b)))]] = True
    return out


def last_marks(b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the run of ASCII marks that ends a word begins, if a Latin letter is before it: no token goes from a letter to a mark, and no mark
    forms a character with what is beside it here. ``ends``: of the words, each behind a byte that isn't white."""
    sign = _SIGN[b]
    begin = np.flatnonzero(sign[1:] & ~sign[:-1]) + 1  # of every run but one at the start, which has no letter before it
    last = ends[sign[ends - 1]] - 1
    if not len(begin):
        return begin
    at = begin[np.searchsorted(begin, last[last >= begin[0]], "right") - 1]
    before, lead = b[at - 1], b[np.maximum(at - 2, 0)]
    two = (lead >= 0xC3) & (lead <= 0xC8) & (before >= 0x80) & (before < 0xC0) & (at > 1)  # U+00C0 to U+023F
    sign = (lead == 0xC3) & ((before == 0x97) | (before == 0xB7))  # two of them are none
    dotted = (lead == 0xC4) & (before == 0xB0)  # U+0130: its small form ends with a mark
    return at[_LETTER[before] | (two & ~sign & ~dotted)]


_made: dict[tuple[str, str], "Memo"] = {}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def memo(path: str, kind: str) -> Memo:
    """One per worker process. kind: ``bytes`` (byte-level, spaces belong to the next word) or ``words`` (white space dropped)."""
    if (path, kind) not in _made:
        _made[path, kind] = (ByteMemo if kind == "bytes" else WordMemo)(path)
    return _made[path, kind]


class Memo:
    share = 1  # of MOST

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            model = f.read()
        self.tok = Tokenizer.from_str(model)
        own = json.loads(model)
        self.added = [x["content"].encode() for x in own.get("added_tokens") or ()]
        own = own["model"]
        self.suffix = own.get("end_of_word_suffix") or ""
        self.length = np.zeros(self.tok.get_vocab_size(), np.int64)  # bytes of each token: one character stands for each
        for token, i in own["vocab"].items():
            self.length[i] = len(token.removesuffix(self.suffix))
        # The same merges behind a mere split at spaces, for words that need no other splitting.
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in own["merges"]]
        plain = Tokenizer(models.BPE(vocab=own["vocab"], merges=merges, cache_capacity=0, **({"end_of_word_suffix": self.suffix} if self.suffix else {})))
        plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.plain = plain
        del own, model, merges
        gc.collect()  # the parsed file is several times the models' size
        self.size = self.tok.get_vocab_size()
        self.type = "<u2" if self.size < 65_536 else "<u4"
        self.width = int(self.type[-1])
        self.ids: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def whole(self, texts: list[bytes]) -> list[bytes]:
        found = self.tok.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(x.ids, self.type).tobytes() for x in found]

    def bare(self, words: list[bytes]) -> list[bytes]:
        """Like ``whole`` for parts of texts without added tokens: what lower-casing made to look like one is none."""
        self.tok.encode_special_tokens = True
        try:
            return self.whole(words)
        finally:
            self.tok.encode_special_tokens = False

    def join(self, text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts text[start:end] in a row, and the number of ids of each.

        Equal parts are found with numpy: one of up to 16 bytes is two integers. Only different parts are looked up, and only new ones learnt."""
        if len(self.ids) > MOST * self.share:
            self.old, self.ids = self.ids, {}
        size = ends - starts
        short = np.flatnonzero(size <= 16)
        long = np.flatnonzero(size > 16)
        words = np.ndarray((len(text) + 1,), "<u8", text + bytes(24), strides=(1,))
        n = size[short]
        low, high = words[starts[short]] & _MASK[np.minimum(n, 8)], words[np.minimum(starts[short] + 8, len(text))] & _MASK[np.maximum(n - 8, 0)]
        key = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F) + n.astype(np.uint64))
        key ^= key >> np.uint64(29)
        of, different = pd.factorize(key)
        first = np.empty(len(different), np.int64)
        first[of[::-1]] = np.arange(len(of) - 1, -1, -1)
        wrong = np.flatnonzero((low != low[first][of]) | (high != high[first][of]) | (n != n[first][of])) if len(of) else of
        which = np.empty(len(size), np.int64)  # of each part, the different part it is
        which[short] = of
        single = np.concatenate([short[wrong], long])  # looked up one by one
        which[single] = len(first) + np.arange(len(single))
        at = np.concatenate([short[first], single])
        parts = [text[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist())]
        found = list(map(self.ids.get, parts))
        gaps = [i for i, x in enumerate(found) if x is None]
        if gaps:
            need = {parts[i] for i in gaps}
            back = need & self.old.keys()
            self.ids.update((w, self.old[w]) for w in back)
            self.learn(list(need - back))
            for i in gaps:
                found[i] = self.ids[parts[i]]
        ids, count = np.frombuffer(b"".join(found), self.type), np.fromiter(map(len, found), np.int64, len(found)) // self.width
        begin, n = (np.cumsum(count) - count)[which], count[which]
        where = np.repeat(begin - (np.cumsum(n) - n), n)
        where += np.arange(len(where))
        return ids[where], n

    def spelled(self, word: bytes) -> str | None:
        """A word of letters, and marks after it, as the merges spell it, its parts divided by a space; None for any other word."""
        raise NotImplementedError

    def spell(self, words: list[bytes]) -> list[str | None]:
        return list(map(self.spelled, words))

    def learn(self, words: list[bytes]) -> None:
        spelled = self.spell(words)
        self.learn_hard([w for w, x in zip(words, spelled) if x is None])
        words, spelled = [w for w, x in zip(words, spelled) if x is not None], [x for x in spelled if x is not None]
        for i in range(0, len(words), 50_000):  # one encoding of all in a row, cut where the tokens' bytes add up to a word's
            part, row = words[i : i + 50_000], spelled[i : i + 50_000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(row)], add_special_tokens=False)[0].ids, self.type)
            size = np.fromiter(map(len, row), np.int64, len(row)) - np.fromiter((" " in x for x in row), np.int64, len(row))
            cuts = (np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(size)) + 1) * self.width
            data, cuts = ids.tobytes(), cuts.tolist()
            self.ids.update(zip(part, map(data.__getitem__, map(slice, [0, *cuts], cuts))))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian bytes of ``self.type``; texts in slices, so that few are held at once. One that holds an added token is encoded whole."""
        out = []
        i = 0
        while i < len(texts):
            j, held = i, 0
            while j < len(texts) and held < 4_000_000:
                held += len(texts[j])
                j += 1
            part = texts[i:j]
            special = [any(x in t for x in self.added) for t in part]
            whole = iter(self.whole([t for t, s in zip(part, special) if s]))
            rest = iter(self.some([t for t, s in zip(part, special) if not s]))
            out += [next(whole) if s else next(rest) for s in special]
            i = j
        return out


class ByteMemo(Memo):
    """GPT-2 style byte-level BPE: a single space between two other characters always starts a part, a single line feed is one."""

    def __init__(self, path: str):
        super().__init__(path)
        self.feed = self.whole([b"\n"])[0]

    def some(self, texts: list[bytes]) -> list[bytes]:
        """Parts are cut before single spaces and line feeds; a part after a line feed keeps it, the first one has a carriage return before it
        as a mark (no text cut here has one)."""
        everything = b"\x01".join(texts)
        there = [x for x in _ODD if x in everything]
        plain = [bool(t) and t[:1] not in b" \n" and t[-1:] not in b" \n" and not any(x in t for x in there) for t in texts]
        odd = iter(self.whole([t for t, p in zip(texts, plain) if not p]))
        text = b"".join([b"\r" + t for t, p in zip(texts, plain) if p])
        if not text:
            return list(odd)
        b = np.frombuffer(text, np.uint8)
        starts = np.flatnonzero(_BREAK[b] | single_marks(b, _BREAK))
        ids, n = self.join(text, starts, np.append(starts[1:], len(text)))
        data, total = ids.tobytes(), np.cumsum(n) - n
        cuts = np.append(total[b[starts] == 13], len(ids)) * self.width
        cut = iter([data[i:j] for i, j in zip(cuts.tolist(), cuts[1:].tolist())])
        return [next(cut) if p else next(odd) for p in plain]

    def spelled(self, word: bytes) -> str | None:
        if word[1:].isalpha() and word[0] == 32:
            return "\u0120" + word[1:].decode()
        stem = word.rstrip(_MARKS)
        marks = word[len(stem) :]
        if word[:1] != b" ":
            return None
        if stem[1:].isalpha():
            letters = stem[1:].decode()
        else:
            try:
                letters = stem[1:].decode("utf-8")
            except UnicodeDecodeError:
                return None
            if not letters.isalpha():
                return None
            letters = stem[1:].decode("latin-1").translate(_SPELL)
        return f"\u0120{letters} {marks.decode()}" if marks else "\u0120" + letters

    def learn_hard(self, words: list[bytes]) -> None:
        starts = [w for w in words if w[0] in b"\r\n"]
        self.ids.update((w, (self.feed if w[:1] == b"\n" else b"") + x) for w, x in zip(starts, self.whole([w[1:] for w in starts])))
        words = [w for w in words if w[0] not in b"\r\n"]
        self.ids.update(zip(words, self.whole(words)))


class WordMemo(Memo):
    """BPE with word ends whose splitting drops white space: every word stands alone, and so does the run of marks that ends it.

    Its memo is twice as large: texts have more different words than it holds, and learning one again takes longest."""

    share = 2

    def learn(self, words: list[bytes]) -> None:
        """Words of letters are spelled in a row, one byte a character, so that no word is handled alone but to be cut out again."""
        rest = [w for w in words if not w.isalpha()]
        words = [w for w in words if w.isalpha()]
        if rest:
            latin, hard = self.latin(rest)
            words += latin
            if hard:
                self.ids.update(zip(hard, self.bare(hard)))
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            row = b" ".join(part).lower()
            row = row.decode() if row.isascii() else row.decode().lower().encode().decode("latin-1").translate(_SPELL_ROW)
            ids = np.array(self.plain.encode_batch_fast([row], add_special_tokens=False)[0].ids, self.type)
            cuts = (np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))) + 1) * self.width
            data, cuts = ids.tobytes(), cuts.tolist()
            self.ids.update(zip(part, map(data.__getitem__, map(slice, [0, *cuts], cuts))))

    def latin(self, words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Words of the letters of ``_PLAIN``, and the others."""
        row = np.frombuffer(b" ".join(words).decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        other = np.zeros(len(words), bool)
        other[(np.cumsum(row == 32))[~_PLAIN[np.minimum(row, len(_PLAIN) - 1)]]] = True
        other = other.tolist()
        return [w for w, x in zip(words, other) if not x], [w for w, x in zip(words, other) if x]

    def some(self, texts: list[bytes]) -> list[bytes]:
        text = b" ".join(texts).lower()  # A-Z alone; the library lowers all letters anyway
        if not text:
            return [b""] * len(texts)
        b = np.frombuffer(text, np.uint8)
        edge = np.flatnonzero(np.diff(_WHITE[b], prepend=True, append=True))
        mark = last_marks(b, edge[1::2])
        starts, ends = np.sort(np.append(edge[::2], mark), kind="stable"), np.sort(np.append(edge[1::2], mark), kind="stable")
        ids, n = self.join(text, starts, ends)
        data, total = ids.tobytes(), np.append(0, np.cumsum(n))
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        cuts = (total[np.searchsorted(starts, begin)] * self.width).tolist()
        return [data[i:j] for i, j in zip(cuts, cuts[1:])]

"""HTML main-text extraction: a linear-chain conditional random field over the DOM's leaf blocks.

A tolerant scanner walks the whole html once, keeps the stack of open elements, and cuts the text into leaf blocks at block-level tags. Scripts, styles, comments,
heads, lists of options and the insides of raw elements (svg, canvas, video, noscript, ...) make no text; all other text, hidden or in a button too, belongs to a block,
and what is kept is the chain's decision. Each block has features: its ancestors' tags and words of their class, id and role (nearest and all), whether it is
hidden, and of its text (length, share of links and buttons, marks, stop phrases, position). A chain of main / other labels with log-linear weights is trained by gradient ascent on
the exact conditional likelihood (forward-backward), on labelled pages that :func:`labelled_pages` writes from templates with random parts, and
decodes by Viterbi. Training takes some seconds on the driver, once a session, is deterministic, and needs no page of the input.

Time is linear in the page: a tag that the page's end cuts off, a quote or a raw element that is never closed are each searched for once, and a block's
ancestors are one :class:`Context`, which holds only what the model knows and is shared by all blocks and pages that have the same. A block's score is the sum
of its context's and of that of what its text and place say; each is summed once from the named features. Stop phrases are searched for in the page's whole text.

Defined cases: null or empty html, or no main block: empty text; equal rows get equal results; both labels equally likely: other; broken markup never fails (a stray < is text, open elements
end with the page, but a raw element other than a script or style that is never closed hides
nothing; a reference to a number of any length is decoded); an empty table gives an empty result; extra columns don't matter; pages of any length are handled whole."""

from __future__ import annotations

import bisect
import functools
import html
import itertools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The whole tag if its quotes are values without < and >; the start of a comment or declaration. Nothing is tried twice (*+, ?+).
_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"'=]*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+')?+)*+[^<>"'=]*+>)?+|[!?])""")
_TO_VALUE = re.compile(r"[^>=]*")
_ATTR = re.compile(r"([^\s/>=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")  # one attribute after the other, whatever its name
_REFERENCE = re.compile(r"(&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?))")
_DIGIT = re.compile("[0-9]")
_NAME = re.compile(r"[a-z]+", re.I)
# HTML element groups.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title noscript template textarea iframe svg canvas object audio video xmp noembed noframes plaintext".split())
CONTROL = frozenset("select option optgroup datalist".split())  # of forms; any other element ends them
HIDDEN = CONTROL | {"head", "annotation", "annotation-xml"}  # the last two are inside formulas, whose own text is seen
OF_HEAD = frozenset("head title meta link base script style noscript template".split())
NESTED = frozenset("svg canvas object audio video template".split())  # raw elements whose content has tags
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
HOLDS_P = frozenset(("td", "th", "button", "object"))  # a paragraph outside of these is not ended from within
_COUNTED = HIDDEN | HOLDS_P | {"p"}  # what the scanner keeps places or numbers of


def _attributes(rest: str) -> tuple[list[tuple[str, str]], bool]:
    """Names and values of a start tag's attributes, and whether the tag closes itself (a slash in a bare value does not)."""
    found, bare = [], False
    for a in _ATTR.finditer(rest):
        value = a[2] or ""
        bare = a.end() == len(rest) and value[:1] not in ("", '"', "'")
        found.append((a[1].lower(), value.strip("\"'").lower()))
    return found, rest.endswith("/") and not bare


class _Tokens:
    """Tags and the ends of raw elements of a page. Whatever the page lacks from some place on is searched for once, so that all tags together take linear time."""

    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        self.without: set[str] = set()  # strings and raw elements' end tags that don't come any more
        self.plain = False  # after a tag that ends with the page, quotes don't matter
        self.of: dict[int, int] | None = None

    def find(self, what: str, pos: int) -> int:
        if what in self.without:
            return -1
        at = self.page.find(what, pos)
        if at < 0:
            self.without.add(what)
        return at

    def close_of(self, pos: int) -> int:
        """Place of the ``>`` of a tag whose name ends at ``pos``, or -1; values in quotes may hold one."""
        page, at = self.page, pos
        while not self.plain:
            at = _TO_VALUE.match(page, at).end()
            if at >= self.size:
                self.plain = True
            elif page[at] == ">":
                return at
            else:
                at += 1
                while at < self.size and page[at].isspace():
                    at += 1
                if at < self.size and page[at] in "\"'":
                    at = max(at, self.find(page[at], at + 1)) + 1
        return self.find(">", pos)

    def next(self, pos: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, tag in lower case or "", attributes) of the first tag, comment or declaration from ``pos`` on."""
        page = self.page
        while m := _TAG.search(page, pos):
            slash, tag, rest = m.groups()
            pos, end = m.span()
            if rest:
                return pos, end, slash, tag.lower(), rest[:-1]
            if tag:
                at = self.close_of(end)
                if at >= 0:
                    return pos, at + 1, slash, tag.lower(), page[end:at]
            elif page.startswith("<!--", pos):
                end = self.find("-->", pos + 4)
                return pos, end + 3 if end >= 0 else self.size, "", "", ""
            else:
                end = self.find(">", pos)
                if end >= 0:
                    return pos, end + 1, "", "", ""
            pos += 1
        return None

    def first(self, tag: str, pos: int) -> int | None:
        """End of a raw text that begins at ``pos``: its first end tag."""
        if "</" + tag in self.without:
            return None
        m = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.page, pos)
        if not m:
            self.without.add("</" + tag)
        return m.end() if m else None

    def nested(self, pos: int) -> int | None:
        """End of the element of ``NESTED`` whose start tag ends at ``pos``: the end tag of its own depth."""
        if self.of is None:
            self.of = {}
            opened: dict[str, list[int]] = {tag: [] for tag in NESTED}
            own, at = _Tokens(self.page), 0
            while m := own.next(at):
                _, at, slash, tag, rest = m
                if tag in NESTED:
                    if not slash:
                        if not (tag == "svg" and _attributes(rest)[1]):
                            opened[tag].append(at)
                    elif opened[tag]:
                        self.of[opened[tag].pop()] = at
                elif tag in RAW and not slash:
                    at = own.first(tag, at) or (self.size if tag in ("script", "style") else at)
        return self.of.get(pos)


class Context:
    """What a block's ancestors say: tags of the two nearest block elements, tags and names of all, names of the two nearest. ``score`` is for the model."""

    __slots__ = ("tags", "inside", "names", "own", "near", "framed", "score")

    def __init__(self, tags: tuple = (), inside: tuple = (), names: tuple = (), own: tuple = (), near: tuple = ()):
        self.tags, self.inside, self.names, self.own, self.near = tags, inside, names, own, near
        self.framed = "content" if "article" in inside or "main" in inside else "page"
        self.score: tuple[float, float] | None = None

    def features(self) -> list[str]:
        tags = self.tags
        f = ["bias", f"tag={tags[0] if tags else '-'}", f"up={tags[1] if len(tags) > 1 else '-'}"]
        f += [f"in={t}" for t in self.inside]
        f += [f"name={w}" for w in self.names]
        f += [f"near={w}" for w in dict.fromkeys(self.near)]
        if "!hidden" in self.names:
            f.append(f"hidden in {self.framed}")
        return f


class Contexts:
    """Contexts and the steps between them. Pages share them, as few differ; a page that has more than ``most`` begins anew, and needs no more memory."""

    def __init__(self, known: frozenset | None = None, most: int = 4096):
        self.known, self.most = known, most
        self.top = Context()
        self.all: dict[tuple, Context] = {}
        self.steps: dict[tuple, Context] = {}
        self.read: dict[str, tuple] = {}

    def names(self, rest: str) -> tuple:
        """Names of a start tag's attributes that are known (None: all)."""
        found = self.read.get(rest)
        if found is None:
            each: dict[str, None] = {}
            for key, value in _attributes(rest)[0]:
                if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                    each["!hidden"] = None
                elif key in ("class", "id", "role", "itemprop", "aria-label"):
                    each |= dict.fromkeys(_NAME.findall(value))
            found = tuple(w for w in each if self.known is None or w in self.known)
            if len(rest) <= 100:  # what is kept is short
                if len(self.read) >= self.most:
                    self.read.clear()
                self.read[rest] = found
        return found

    def step(self, c: Context, tag: str, names: tuple) -> Context:
        """The context inside a block element that stands in ``c``."""
        found = self.steps.get((c, tag, names))
        if found is None:
            if len(self.steps) >= self.most:
                self.steps.clear()
                self.all.clear()
            inside = c.inside if tag in c.inside else (*c.inside, tag)
            key = ((tag, *c.tags[:1]), inside, tuple(dict.fromkeys(c.names + names)) if names else c.names, names, c.own + names)
            found = self.steps[c, tag, names] = self.all.get(key) or self.all.setdefault(key, Context(*key))
        return found


class Block:
    """Text; number of words; characters of it in links and in buttons; where it stands."""

    __slots__ = ("text", "words", "linked", "pressed", "context")

    def __init__(self, text: str, words: int, linked: int, pressed: int, context: Context):
        self.text, self.words, self.linked, self.pressed, self.context = text, words, linked, pressed, context

    @property
    def names(self) -> tuple:
        return self.context.names


@functools.lru_cache(maxsize=1024)
def _decoded(reference: str) -> str:
    try:
        return html.unescape(reference)
    except ValueError:  # more digits than int() takes; past the last character nine say as much
        return html.unescape(f"&#{reference[2:].strip(';').lstrip('0')[:9] or 0};")


def _unescape(text: str) -> str:
    """As html.unescape; each reference is looked up."""
    out = _REFERENCE.split(text)
    out[1::2] = [_decoded(x) if len(x) < 40 else _decoded.__wrapped__(x) for x in out[1::2]]  # what is kept is short
    return "".join(out)


def blocks(page: str, contexts: Contexts | None = None) -> list[Block]:
    """Leaf blocks with text, in page order, with names of attributes as ``contexts`` know them (None: all)."""
    contexts = contexts or Contexts()
    out: list[Block] = []
    tokens = _Tokens(page)
    tags: list[str] = []  # open elements
    places: list[Context] = [contexts.top]  # outside of all, and inside each
    paragraphs: list[int] = []  # places of paragraphs, of what holds paragraphs
    holders: list[int] = []
    opened: dict[str, int] = {"a": 0, "button": 0, "head": 0}
    parts: list[str] = []
    hidden = linked = pressed = 0

    def close() -> None:
        nonlocal linked, pressed
        if parts:
            text = "".join(parts)
            parts.clear()
            words = (_unescape(text) if "&" in text else text).split()
            if words:
                out.append(Block(" ".join(words), len(words), linked, pressed, places[-1]))
            linked = pressed = 0

    def add(text: str) -> None:
        nonlocal linked, pressed
        if not hidden:
            parts.append(text)
            if opened["a"]:
                linked += len(text)
            if opened["button"]:
                pressed += len(text)

    def pop() -> str:
        nonlocal hidden
        tag = tags.pop()
        places.pop()
        opened[tag] -= 1
        if tag in _COUNTED:
            hidden -= tag in HIDDEN
            for at in (paragraphs, holders):
                if at and at[-1] == len(tags):
                    at.pop()
        return tag

    pos, size = 0, len(page)
    while m := tokens.next(pos):
        start, end, slash, tag, rest = m
        if start > pos:
            add(page[pos:start])
        pos = end
        if not tag:
            continue
        if slash:
            if opened.get(tag):
                if tag in BLOCK:
                    close()
                while pop() != tag:
                    pass
            continue
        block = tag in BLOCK
        if block:
            close()
        if opened["head"] and tag not in OF_HEAD:
            while pop() != "head":
                pass
        while tags and tags[-1] in CONTROL and tag not in CONTROL:
            pop()
        if tag == "br":
            add(" ")
        if tag in VOID:
            continue
        if paragraphs and tag in CLOSES_P and (not holders or holders[-1] < paragraphs[-1]):
            to = paragraphs[-1]
            while len(tags) > to:
                pop()
        if tag in SELF_CLOSING and tags and tags[-1] in SELF_CLOSING[tag]:
            pop()
            while tag in ("tr", "dd", "dt") and tags and tags[-1] in SELF_CLOSING[tag]:
                pop()
        if tag in RAW:  # its content makes no text; without an end tag only scripts and styles go on to the end
            if not (tag == "svg" and _attributes(rest)[1]):
                end = tokens.nested(pos) if tag in NESTED else tokens.first(tag, pos)
                pos = end or (size if tag in ("script", "style") else pos)
            continue
        if tag in _COUNTED:
            hidden += tag in HIDDEN
            if tag == "p":
                paragraphs.append(len(tags))
            if tag in HOLDS_P:
                holders.append(len(tags))
        tags.append(tag)
        places.append(contexts.step(places[-1], tag, contexts.names(rest) if rest else ()) if block else places[-1])
        opened[tag] = opened.get(tag, 0) + 1
    if pos < size:
        add(page[pos:])
    close()
    return out


# In lower case; none can reach over the line ends between blocks.
STOP = tuple("cookie,subscri,newsletter,sign in,sign up,signin,signup,log in,login,copyright,©,all rights,privacy,terms of,advert,sponsor,read more,share this,share on,follow us,related,comment,reply,replies,posted by,impressum,datenschutz,menu,next page,previous,home page".split(","))


def _lower(text: str) -> str:
    """In lower case, of the same length; letters as re.IGNORECASE takes them."""
    if not text.isascii():
        text = text.replace("İ", "i").replace("ı", "i").replace("ſ", "s")
    return text.lower()


def _stopped(found: list[Block]) -> list[bool]:
    """Which blocks hold a phrase of ``STOP``, each searched for in the whole page at once."""
    hit = [False] * len(found)
    page = _lower("\n".join([b.text for b in found]))
    starts = [0, *itertools.accumulate(len(b.text) + 1 for b in found)]
    for phrase in STOP:
        at = page.find(phrase)
        while at >= 0:
            i = bisect.bisect_right(starts, at)
            hit[i - 1] = True
            at = page.find(phrase, starts[i])
    return hit


def _signs(found: list[Block]) -> list[tuple]:
    """What each block's text and place in the page say; there are some thousand different ones."""
    out, n = [], len(found)
    h1 = next((i for i, b in enumerate(found) if b.context.tags[:1] == ("h1",)), None)
    for i, (b, stop) in enumerate(zip(found, _stopped(found))):
        text, size, pressed, share = b.text, len(b.text), b.pressed, b.linked / len(b.text)
        out.append(
            (
                min(6, b.words.bit_length()),
                0 if share < 0.05 else 1 if share < 0.4 else 2 if share < 0.9 else 3,
                None if not pressed else 0 if pressed < 0.4 * size else 1 if pressed < 0.9 * size else 2,
                "." if text[-1] in ".!?…。" else ":" if text[-1] in ":;," else "-",
                b.context.framed if stop else None,
                size < 60 and bool(_DIGIT.search(text) if text.isascii() else any(map(str.isdigit, text))),
                None if h1 is None else "before" if i < h1 else "at" if i == h1 else "after",
                "first" if i == 0 else "last" if i == n - 1 else "inner",
            )
        )
    return out


def _of_sign(sign: tuple) -> list[str]:
    words, links, buttons, end, stop, digits, h1, place = sign
    f = [f"words={words}", f"links={links}"]
    if buttons is not None:
        f.append(f"buttons={buttons}")
    f.append(f"end={end}")
    if stop:
        f += [f"stop={words // 2}", f"stop in {stop}"]
    if digits:
        f.append("digits")
    if h1:
        f.append(f"h1={h1}")
    f.append(place)
    return f


def features(found: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    return [b.context.features() + _of_sign(s) for b, s in zip(found, _signs(found))]


class Crf:
    """Two labels (0 other, 1 main); weights of features by label and of label pairs."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.known = frozenset(f.partition("=")[2] for f in names if f.startswith(("name=", "near=")))
        self.w, self.t = np.zeros((len(names), 2)), np.zeros((2, 2))
        self.contexts, self.of_sign = Contexts(self.known), {}

    def sum(self, row: list[str]) -> tuple[float, float]:
        a, b = self.w[[k for k in map(self.names.get, row) if k is not None]].sum(0).tolist()
        return a, b

    def of(self, found: list[Block]) -> list[tuple[float, float]]:
        """Scores of blocks in this model's contexts: those of their features, as :func:`features` names them, but each context and sign is summed once."""
        out, signs = [], self.of_sign
        for b, sign in zip(found, _signs(found)):
            c = b.context.score
            if c is None:
                c = b.context.score = self.sum(b.context.features())
            s = signs.get(sign)
            if s is None:
                s = signs[sign] = self.sum(_of_sign(sign))
            out.append((c[0] + s[0], c[1] + s[1]))
        return out

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        get, w = self.names.get, self.w
        return np.array([w[[k for k in map(get, r) if k is not None]].sum(0) for r in rows]).reshape(-1, 2)

    def viterbi(self, s: np.ndarray | list[tuple[float, float]]) -> list[int]:
        if not len(s):
            return []
        t, best, back = self.t.tolist(), s[0], []
        for a, b in s[1:]:
            p, q = best[0] + t[0][0], best[1] + t[1][0]
            u, v = best[0] + t[0][1], best[1] + t[1][1]
            back.append((int(q > p), int(v > u)))
            best = [max(p, q) + a, max(u, v) + b]
        label = int(best[1] > best[0])
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def gradient(s: np.ndarray, t: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of labels y under scores s (block, label) and t (label before, label), and its derivatives by s and t."""
    n = len(s)
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    a[0] = s[0]
    for i in range(1, n):
        m = a[i - 1][:, None] + t
        a[i] = s[i] + np.logaddexp(m[0], m[1])
    for i in range(n - 2, -1, -1):
        m = t + (s[i + 1] + b[i + 1])[None, :]
        b[i] = np.logaddexp(m[:, 0], m[:, 1])
    z = np.logaddexp(*a[-1])
    pairs = -np.exp(a[:-1, :, None] + t + (s[1:] + b[1:])[:, None, :] - z).sum(0)
    np.add.at(pairs, (y[:-1], y[1:]), 1)
    return s[np.arange(n), y].sum() + t[y[:-1], y[1:]].sum() - z, np.eye(2)[y] - np.exp(a + b - z), pairs


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4) -> Crf:
    """Maximum conditional likelihood by AdaGrad, page by page in a fixed order."""
    names = {f: i for i, f in enumerate(sorted({f for rows, _ in pages for r in rows for f in r}))}
    crf = Crf(names)
    gw, gt = np.full(crf.w.shape, 1e-2), np.full((2, 2), 1e-2)
    index = [([np.array([names[f] for f in r]) for r in rows], np.array(y)) for rows, y in pages]
    for _ in range(rounds):
        for rows, y in index:
            if not rows:
                continue
            _, d, pairs = gradient(np.array([crf.w[r].sum(0) for r in rows]), crf.t, y)
            for r, g in zip(rows, d):
                g = g - decay * crf.w[r]
                gw[r] += g * g
                crf.w[r] += rate * g / np.sqrt(gw[r])
            gt += pairs * pairs
            crf.t += rate * pairs / np.sqrt(gt)
    return crf


def labelled_pages(n: int = 600, seed: int = 9) -> list[tuple[str, list[str]]]:
    """(html, main blocks) of generated pages: varied frames, navigation, notices, forms, adverts, sidebars, comments, and articles."""
    rng = random.Random(seed)
    syllable = "an er on the in ti or re st ou la de ne mi so ra ka lu po ve".split()

    def word() -> str:
        return "".join(rng.choice(syllable) for _ in range(rng.randint(1, 4)))

    def phrase(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(rng.randint(lo, hi)))

    def sentence() -> str:
        return phrase(3, 18).capitalize() + rng.choice("....?!")

    def prose(lo: int = 1, hi: int = 7) -> str:
        return " ".join(sentence() for _ in range(rng.randint(lo, hi)))

    def named(tag: str, names: list[str], chance: float = 0.8) -> str:
        if rng.random() > chance:
            return f"<{tag}>"
        key = rng.choice(["class", "class", "class", "id"])
        return f'<{tag} {key}="{rng.choice(names)}{rng.choice(["", "", "-" + word(), " " + word()])}">'

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{phrase(1, 3).capitalize()}</a></li>' for _ in range(k))

    def menu() -> str:
        if rng.random() < 0.7:
            return f"<nav>{'<ul>' + links(rng.randint(2, 9)) + '</ul>'}</nav>"
        return named("div", ["menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar"], 1) + "<ul>" + links(rng.randint(2, 9)) + "</ul></div>"

    def header() -> str:
        return rng.choice(["<header>", named("div", ["header", "masthead", "banner", "site-header"], 1)[:-1] + ">"]) + f"<p>{phrase(1, 5).capitalize()}</p>" + (menu() if rng.random() < 0.4 else "") + "</header></div>"

    def notice() -> str:
        text = rng.choice(["We use cookies. ", "Cookie notice: ", "Subscribe to our newsletter. ", "This site uses cookies. ", ""]) + prose(1, 2)
        box = named("div", ["cookie", "cookies", "notice", "consent", "banner", "popup", "modal", "alert", "gdpr", "newsletter", "subscribe", "paywall"], 1)
        if rng.random() < 0.3:
            box = box[:-1] + rng.choice([" hidden>", ' aria-hidden="true">', ' style="display: none">'])
        return box + rng.choice([text, f"<p>{text}</p>"]) + (f"<button>{phrase(1, 2)}</button>" if rng.random() < 0.4 else "") + "</div>"

    def advert() -> str:
        tag = rng.choice(["div", "div", "aside", "section", "p"])
        return named(tag, ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "ad-slot"], 1) + prose(1, 3) + f"</{tag}>"

    def form() -> str:
        return f'<form action="/{word()}"><label>{phrase(1, 3)}</label><input name="q"><p>{prose(1, 1)}</p><button>{phrase(1, 2)}</button></form>'

    def side() -> str:
        tag = rng.choice(["aside", "aside", "div", "section"])
        inner = f"<h3>{phrase(1, 4).capitalize()}</h3><ul>{links(rng.randint(2, 6))}</ul>" if rng.random() < 0.6 else f"<h3>{phrase(1, 4)}</h3><p>{prose(1, 4)}</p>"
        return (named(tag, ["sidebar", "side", "related", "widget", "recommended", "trending", "author-box", "share", "social", "toc", "more", "popular", "tags", "bio"], 0.4 if tag == "aside" else 1)) + inner + f"</{tag}>"

    def comments() -> str:
        tag = rng.choice(["section", "div", "ol"])
        each = "".join(rng.choice(["{0}<p>{1}</p></div>", "<div class=\"comment\"><b>{2}</b><p>{1}</p></div>", "<article class=\"comment\"><p>{1}</p></article>", "<li>{1}</li>"]).format(named("div", ["comment", "reply", "response"], 1), prose(1, 4), word()) for _ in range(rng.randint(1, 5)))
        return named(tag, ["comments", "comment-list", "responses", "discussion", "replies", "disqus", "reactions", "reader-comments"], 1) + (f"<h2>{rng.choice(['Comments', phrase(1, 3), 'Reader comments', '3 comments'])}</h2>" if rng.random() < 0.7 else "") + each + f"</{tag}>"

    def footer() -> str:
        text = rng.choice(["&copy; ", "Copyright ", "", "&copy; 2020 "]) + word() + ".example.com &middot; " + prose(1, 2)
        return rng.choice([f"<footer>{text}</footer>", f"<footer><p>{text}</p><ul>{links(3)}</ul></footer>", named("div", ["footer", "site-footer", "bottom", "colophon", "copyright", "legal"], 1) + f"<p>{text}</p></div>"])

    def tail() -> str:
        tag = rng.choice(["footer", "header", "div", "ul"])
        if rng.random() < 0.15:
            return named("div", ["share", "social", "buttons", "actions", "toolbar"], 0.8) + "".join(f"<button>{phrase(1, 2)}</button> " for _ in range(rng.randint(1, 4))) + "</div>"
        open_ = f"<{tag}>" if tag in ("footer", "header") else named(tag, ["meta", "byline", "share", "social", "tags", "pager", "author", "breadcrumb"], 1)
        return open_ + (f"<p>{phrase(1, 6)}</p>" if tag != "ul" else links(rng.randint(1, 5))) + f"</{tag}>"

    def article() -> tuple[str, list[str]]:
        main, parts = [], []

        def put(open_: str, text: str, close: str) -> None:
            main.append(text)
            shown = html.escape(text, quote=False) if rng.random() < 0.7 else text
            if " " in shown and rng.random() < 0.06:  # what stands within a sentence
                a, b = shown.split(" ", 1)
                shown = rng.choice(["<button>{}</button> {}", "{} <svg><text>x</text></svg>{}", "{} <math><mi>{}</mi></math>", "{} <select><option>x</select>{}", "<span hidden>{}</span> {}", "{}<script>x()</script> {}"]).format(a, b)
            if rng.random() < 0.04 and open_.endswith(("p>", "li>", "div>", "blockquote>")):
                open_ = open_[:-1] + rng.choice([" hidden>", ' aria-hidden="true">', ' style="display:none">'])
            parts.append(open_ + shown + close)

        if rng.random() < 0.9:
            put("<h1>", phrase(2, 10).capitalize() + rng.choice(["", "", "."]), "</h1>")
        for _ in range(rng.randint(1, 12)):
            if rng.random() < 0.05:  # what is said in an article may sound like a notice
                put("<p>", rng.choice(["All rights reserved.", "Copyright {}.", "Licensed under the {} License.", "Follow us, {}.", "{} share this cookie.", "Read more of {}.", "Reply to {} comments."]).format(phrase(1, 3)), "</p>")
            kind = rng.random()
            if kind < 0.68:
                put(rng.choice(["<p>", "<p>", "<p>", '<p class="lead">', "<p><b>", "<div>"]), prose(), rng.choice(["</p>", "</p>", "<br>"]))
                if parts[-1].startswith("<div"):
                    parts[-1] = parts[-1] + "</div>"
            elif kind < 0.8:
                put(rng.choice(["<h2>", "<h3>"]), phrase(1, 8).capitalize(), rng.choice(["</h2>", "</h3>"]))
                parts[-1] = re.sub(r"^<(h\d)>(.*)</h\d>$", r"<\1>\2</\1>", parts[-1], flags=re.S)
            elif kind < 0.87:
                parts.append("<ul>")
                for _ in range(rng.randint(1, 5)):
                    put("<li>", rng.choice([prose(1, 1), phrase(1, 8)]), "</li>")
                parts.append("</ul>")
            elif kind < 0.92:
                put("<blockquote>", prose(1, 3), "</blockquote>")
            elif kind < 0.96:
                put(rng.choice(["<pre>", "<figure><figcaption>"]), prose(1, 1), "")
                parts[-1] += "</pre>" if parts[-1].startswith("<pre>") else "</figcaption></figure>"
            else:
                parts.append("<table>")
                for _ in range(rng.randint(1, 3)):
                    parts.append("<tr>")
                    put("<td>", phrase(1, 4), "</td>")
                    put("<td>", phrase(1, 3), "</td>")
                    parts.append("</tr>")
                parts.append("</table>")
            if rng.random() < 0.06:
                parts.append(rng.choice([advert, side, notice, form])())
        if rng.random() < 0.2:  # what isn't article may stand within its element
            parts += [rng.choice([comments, comments, side, form, notice, advert, tail])() for _ in range(rng.randint(1, 2))]
        if rng.random() < 0.1:
            parts.insert(0, rng.choice([advert, menu, notice, tail])())
        frame = rng.choice(["<article>", "<article>", "<main>", "<main><article>", '<div class="content">', '<div id="content">', '<div class="post">', '<div class="entry article-body">', '<section class="story">', "<div>", ""])
        return frame + "".join(parts) + "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", frame))), main

    out = []
    for _ in range(n):
        body, main = article()
        before = [rng.choice([menu, header, notice, advert, menu, form])() for _ in range(rng.randint(0, 4))]
        after = [rng.choice([side, comments, advert, footer, notice, form, side, comments])() for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.8:
            after.append(footer())
        out.append((f"<!DOCTYPE html><html><head><title>{phrase(1, 6)}</title><style>p{{margin:0}}</style></head><body>{''.join(before)}{body}{''.join(after)}</body></html>", main))
    return out


def label(page: str, main: list[str]) -> tuple[list[Block], list[int]]:
    """Blocks of a generated page; main are those that carry the article's texts, in order."""
    found, y, k = blocks(page), [], 0
    for b in found:
        hit = k < len(main) and b.text == " ".join(main[k].split())
        y.append(int(hit))
        k += hit
    return found, y


@functools.lru_cache(maxsize=2)
def model(n: int = 600, seed: int = 9) -> Crf:
    data = []
    for page, main in labelled_pages(n, seed):
        found, y = label(page, main)
        data.append((features(found), y))
    return train(data)


def extract(page: str | None, crf: Crf) -> str:
    found = blocks(page or "", crf.contexts)
    return "\n".join([b.text for b, y in zip(found, crf.viterbi(crf.of(found))) if y])


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model())
    rows = pages.select("page_id", "url", "html")

    def run(batches):
        crf = shared.value
        for b in batches:
            texts = [extract((x or b"").decode("utf-8", "replace"), crf) for x in b.column(2).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")

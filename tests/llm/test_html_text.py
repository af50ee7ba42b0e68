"""Article text that no markup around it may hide."""

import time

import numpy as np
import pytest

from quillspark.llm import htmlcrf


def seen(page):
    return [b.text for b in htmlcrf.blocks(page)]


@pytest.mark.parametrize("tag", ["<a title=\"The hidden valley\">", "<a onclick=\"f('hidden')\">", "<a data-x='style=display:none'>", "<a data-hidden>", "<a href=/hidden/>", "<a alt='aria-hidden=true'>"])
def test_words_in_other_attributes_hide_nothing(tag):
    assert seen(f"<p>one {tag}two</a> three</p>") == ["one two three"]


@pytest.mark.parametrize("tag", ["<p hidden>", "<p class=x hidden=''>", "<p ARIA-HIDDEN='true'>", "<p style=\"color: red; display: none\">"])
def test_hidden_attributes_are_a_feature(tag):
    """Only the chain may leave text out."""
    a, b = htmlcrf.features(htmlcrf.blocks(f"{tag}first</p><p>left</p>"))
    assert seen(f"{tag}first</p><p>left</p>") == ["first", "left"]
    assert "hidden in page" in a and "hidden in page" not in b


def test_names_of_attributes():
    b = htmlcrf.blocks("<div class='Main body' data-class=\"no\" id=top><p title='class=no'>x</p></div>")[0]
    assert b.names == ("main", "body", "top")


@pytest.mark.parametrize("raw", ["<svg/>", "<svg class='a' />", "<math/>", "<noscript>", "<object data=x>", "<video src=x>", "<audio>", "<canvas>", "<template>", "<svg width=1>", "<iframe src=x>"])
def test_unclosed_elements_hide_nothing(raw):
    assert seen(f"<p>one</p>{raw}<p>two</p><p>three</p>") == ["one", "two", "three"]


def test_unclosed_before_closed():
    assert seen("<p>one</p><svg/><p>two</p><svg><text>gone</text></svg><p>three</p>") == ["one", "two", "three"]
    assert seen("<p>one</p><video><p>two</p><video>gone</video><p>three</p>") == ["one", "two", "three"]
    assert seen("<p>one</p><object>gone<object>gone</object>gone</object><svg>no<svg/>no<svg>no</svg>no</svg><p>two</p>") == ["one", "two"]
    assert seen("<script>var a = '<svg>'</script><p>one</p><svg>no</svg><p>two</p><script>gone <p>gone</p>") == ["one", "two"]


def test_formulas_are_seen():
    assert seen("<p>as <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='tex'>x = 2</annotation></math> holds</p>") == ["as x=2 holds"]


def test_inline_elements_do_not_cut_a_sentence():
    assert seen("<p>press the <button>red</button> button</p>") == ["press the red button"]
    assert seen("<p>one <script>x()</script>two <svg><text>no</text></svg>three <select><option>no<option>no</select>four</p>") == ["one two three four"]


def test_heads_and_controls_end():
    assert seen("<head><title>no</title><p>one</p>") == ["one"]
    assert seen("<html><head><title>no</title><body>one<select><option>no<p>two</p>") == ["one", "two"]


STORY = "<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Title of this</h1><p>The first sentence is here.</p>{}<p>The last sentence is here.</p></article><footer>Copyright</footer></body></html>"


@pytest.mark.parametrize(
    "part, text",
    [
        ("<svg/>", []),
        ("<p>So is <math><mi>x</mi></math> in a sentence.</p>", ["So is x in a sentence."]),
        ("<p hidden>Nobody sees this sentence here.</p>", ["Nobody sees this sentence here."]),
        ("<p aria-hidden='true'>Nobody hears this sentence here.</p>", ["Nobody hears this sentence here."]),
        ("<p>You press the <button>red</button> button and wait.</p>", ["You press the red button and wait."]),
        ("<form><label>Mail</label><input><button>Send it</button></form>", []),
        ("<p>One <script>x</script>sentence &lt;goes&gt;&nbsp;on.</p>", ["One sentence <goes> on."]),
    ],
)
def test_text_of_the_article(part, text):
    assert htmlcrf.extract(STORY.format(part), htmlcrf.model()) == "\n".join(["Title of this", "The first sentence is here.", *text, "The last sentence is here."])


@pytest.mark.parametrize("piece", ["<a", "<div>x", "<a b='>' ", "<p><td><div>x", "<!", "<a href='", "<svg>", "<x y", "<table><tr><td>x", "<select>", "<noscript>", "<", "&", "<div class='c{}'>x"])
def test_long_pages_take_linear_time(piece):
    crf = htmlcrf.model()

    def seconds(size):
        page = "".join(piece.replace("{}", str(i)) for i in range(size // len(piece)))
        began = time.process_time()
        htmlcrf.extract(page, crf)
        return time.process_time() - began

    assert seconds(1_000_000) < 20 * max(seconds(100_000), 0.05)  # quadratic: 100


def test_gradient_by_brute_force():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5):
        s, t, y = rng.normal(size=(n, 2)), rng.normal(size=(2, 2)), rng.integers(0, 2, n)

        def likelihood(s, t):
            score = lambda z: sum(s[i, k] for i, k in enumerate(z)) + sum(t[a, b] for a, b in zip(z, z[1:]))
            return score(y) - np.log(sum(np.exp(score([k >> i & 1 for i in range(n)])) for k in range(2**n)))

        value, by_s, by_t = htmlcrf.gradient(s, t, y)
        assert value == pytest.approx(likelihood(s, t))
        for x, g in ((s, by_s), (t, by_t)):
            for at in np.ndindex(x.shape):
                d = np.zeros_like(x)
                d[at] = 1e-5
                up, down = (likelihood(s + d, t), likelihood(s - d, t)) if x is s else (likelihood(s, t + d), likelihood(s, t - d))
                assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_many_unclosed_elements_take_linear_time():
    assert len(seen("<canvas><noscript><p>x</p>" * 20_000)) == 20_000

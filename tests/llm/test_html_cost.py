"""What a page costs, and that what is kept between pages changes no result."""

import html
import html.parser
import re
import time

import numpy as np
import pytest

from quillspark.llm import htmlcrf


@pytest.fixture(scope="module")
def pages():
    return [page for page, _ in htmlcrf.labelled_pages(150, seed=77)]


def test_a_page_costs_little_more_than_the_library_s_parser(pages):
    """Features and chain included, 1.2 times its time (5 times before); both run in turns, so that a slow machine slows both."""
    crf = htmlcrf.model()

    def parse(page):
        parser = html.parser.HTMLParser()
        parser.feed(page)
        parser.close()

    def seconds(f):
        began = time.process_time()
        for page in pages:
            f(page)
        return time.process_time() - began

    own, library = zip(*[(seconds(lambda p: htmlcrf.extract(p, crf)), seconds(parse)) for _ in range(5)])
    assert min(own) < 2.5 * min(library)


def test_scores_are_those_of_the_named_features(pages):
    crf = htmlcrf.model()
    for page in [*pages, "", "<p>x", "<div class='ad main'><p hidden>log in 7²</div>y:"]:
        found = htmlcrf.blocks(page, crf.contexts)
        assert np.allclose(np.array(crf.of(found)).reshape(-1, 2), crf.scores(htmlcrf.features(found)), atol=1e-9)
        everything = htmlcrf.features(htmlcrf.blocks(page))  # no name left out
        assert np.allclose(crf.scores(everything), crf.scores(htmlcrf.features(found)), atol=1e-9)


def test_contexts_that_are_forgotten_change_nothing(pages):
    crf, few = htmlcrf.model(), htmlcrf.Contexts(htmlcrf.model().known, most=3)
    for page in pages:
        a, b = (htmlcrf.blocks(page, c) for c in (crf.contexts, few))
        assert [x.text for x in a] == [x.text for x in b] and htmlcrf.features(a) == htmlcrf.features(b)
        assert max(len(few.all), len(few.steps), len(few.read)) <= 3


def test_phrases_by_brute_force():
    pattern = re.compile("|".join(htmlcrf.STOP), re.I)
    texts = ["x"]
    for p in htmlcrf.STOP:
        texts += [p, p.upper(), f"a{p}b", p[:-1], p[1:], p.replace(" ", ""), p.replace("i", "İ"), p.replace("i", "ı"), p.replace("s", "ſ"), p.replace("k", "K"), f"İ {p}", f"é {p[:2]}"]
    found = htmlcrf.blocks("".join(f"<p>{t}</p>" for t in texts))
    assert htmlcrf._stopped(found) == [bool(pattern.search(b.text)) for b in found]


@pytest.mark.parametrize("text", ["&amp;lt;", "&ampx &notit; &bogus; &;&", "&#65;&#x41&#0;&#128;&#xD800;&#1114112;", "&" * 50, "&" + "a" * 40 + ";", "none"])
def test_references_as_the_library_decodes_them(text):
    assert htmlcrf._unescape(text) == html.unescape(text)


@pytest.mark.parametrize("reference, text", [("&#" + "1" * 5000 + ";", "�"), ("&#" + "0" * 5000 + "65;", "A"), ("&#" + "0" * 5000, "�")])
def test_numbers_of_many_digits(reference, text):
    assert htmlcrf.extract(f"<article><h1>Title of this</h1><p>One {reference} sentence is here.</p></article>", htmlcrf.model()) == f"Title of this\nOne {text} sentence is here."

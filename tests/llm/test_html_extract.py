"""HTML extraction: what ends where a browser ends it, what is boilerplate inside an
article and what is not, and pages that are broken at any length."""

import time

import pytest

from tessera.llm.html_extract import extract

LONG = "A sentence of the article that is long enough to be told from a menu by its ratio of text to tags."


@pytest.mark.parametrize("page", [
    f"<html><head><title>t</title><meta charset=utf-8><body><article><p>{LONG}</p></article>",
    f"<html><head><title>t</title><article><p>{LONG}</p></article>",
    f"<head><style>p {{}}</style><script>var a = '<p>';</script><p>{LONG}</p>",
    f"<head><link rel=x>{LONG}",
    f"<head><noscript><img src=x></noscript><body><main><p>{LONG}</main>",
    f"<article><svg class='i'/><p>{LONG}</p></article>",
    f"<article><svg><path d='x'/><circle/></svg><p>{LONG}</p></article>",
    f"<article><svg><path d='x'><p>{LONG}</p></article>",
    f"<article><math/><div>{LONG}</div></article>",
    f"<article><math><mi>x<p>{LONG}</p></article>",
    f"<article><svg><text>drawn</text><foreignObject><p>drawn too</p></foreignObject></svg><p>{LONG}</p></article>",
    f"<article><p>{LONG}</p><!-- a note that never ends</article>".replace("<!-- a note that never ends", ""),
    f"<article><![if x]><p>{LONG}</p><![endif]></article>",
])
def test_nothing_hides_the_article(page):
    assert extract(page) == LONG


REMOVED = """reader-comments user-comments post-comments article-comments comments comment-list reply replies sponsored-content
    advert-inline ad-inline inline-ad adsbygoogle notice alert related related-posts cookie-notice newsletter-signup sidebar
    site-footer-nav user-comments__thread readerComments share-buttons page-banner popup""".split()


@pytest.mark.parametrize("name", REMOVED)
@pytest.mark.parametrize("tag", ["div", "section", "aside", "ul", "p"])
def test_boilerplate_inside_an_article_goes(name, tag):
    inner = "<li>Gone words</li>" if tag == "ul" else "Gone words"
    assert extract(f"<article><h1>T</h1><p>{LONG}</p><{tag} class='x {name}'>{inner}</{tag}><p>{LONG}</p></article>") == f"T\n{LONG}\n{LONG}"


@pytest.mark.parametrize("name", ["reader-comments", "comments", "disqus", "sponsored-content", "cookie-notice", "newsletter"])
def test_ids_of_boilerplate_sections(name):
    assert extract(f"<main><p>{LONG}</p><section id='{name}'><p>Gone words</p></section></main>") == LONG


@pytest.mark.parametrize("element", [
    "<section id='discussion'><p>Kept</p></section>", "<section id='related-work'><p>Kept</p></section>",
    "<section id='comments-on-the-text'><p>Kept</p></section>", "<h2 id='search-algorithms'>Kept</h2>", "<h2 id='comments'>Kept</h2>",
    "<h2 class='header'>Kept</h2>", "<table><tr class='header'><td>Kept</td></tr></table>",
    "<table><tr><td class='comment'>Kept</td></tr></table>", "<div class='has-comments no-sidebar'><p>Kept</p></div>",
    "<p id='notice-of-removal'>Kept</p>", "<section id='ad-hoc-queries'><p>Kept</p></section>",
    "<section id='alert'><p>Kept</p></section>", "<div class='post-body entry'><p>Kept</p></div>", "<p class='lead'>Kept</p>"])
def test_own_words_of_an_article_stay(element):
    assert extract(f"<article><p>{LONG}</p>{element}</article>") == f"{LONG}\nKept"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("<div></div>", ""), ("just text", "just text"), ("a < b", "a < b"),
    ("<p>a &amp; b &lt;</p>", "a & b <"), ("<p>a</p><!-- x <p>b</p>", "a\nx\nb"), ("<p>one</p>two <a href='x", "one\ntwo <a href='x")])
def test_odd_pages(page, text):
    assert extract(page) == text


BROKEN = {
    "open tags": "<a ", "open quotes": "<a href='", "open comments": "<!--", "sections": "<![x ", "instructions": "<?x ",
    "end tags": "</a ", "ampersands": "&", "less-than signs": "<", "nested blocks": "<div>x", "nested marks": "<b>x",
    "nested articles": "<article><p>x", "stray ends": "<i>x</b></p>", "scripts": "<script>x", "drawings": "<svg><g>x<p>y"}


@pytest.mark.parametrize("kind", BROKEN)
@pytest.mark.parametrize("end", ["", ">", "'>x</p>"])
def test_time_grows_with_the_length(kind, end):
    def seconds(n):
        page = BROKEN[kind] * n + end
        start = time.process_time()
        extract(page)
        return time.process_time() - start

    assert seconds(20_000) < 2.0
    assert seconds(40_000) < 12 * max(seconds(10_000), 0.05)

"""What declares a part of a page not to be text, and pages that nest without end."""

import time

import pytest

from turnlens.llm import wrapper


@pytest.mark.parametrize(
    "names",
    "ad ads sidebar comments site-header mainNav page-footer cookie-consent-banner social-share ad_728 ad-slot-3 related-posts newsletter-signup share-buttons "
    "post-comments left-sidebar comment-list breadcrumbs".split(),
)
def test_names_of_noise(names):
    for attribute in ("class", "id", "role"):
        assert wrapper.extract(f'<div><p>kept</p><div {attribute}="x1 {names}">gone</div></div>') == "kept"
        assert wrapper.extract(f'<article><p>kept</p><div {attribute}="{names}"><p>gone</p></div></article>') == "kept"


@pytest.mark.parametrize(
    "names", "has-sidebar no-sidebar comments-open with-header layout market-share ad-hoc two-column adventure shared postheader menu-closed readability".split()
)
def test_names_of_text(names):
    assert wrapper.extract(f'<div class="{names}"><p>Real text</p></div>') == "Real text"
    assert wrapper.extract(f'<article>a <p class="{names}">b</p></article>') == "a b"


def test_layout_names_hide_no_page():
    assert wrapper.extract('<div class="content has-sidebar"><p>Real text</p></div>') == "Real text"
    assert wrapper.extract('<div class="layout no-sidebar"><div class="content">Real</div><div class="sidebar">not</div></div>') == "Real"
    assert wrapper.extract('<div id="comments-open"><p>Real</p><div class="comments">not</div></div>') == "Real"


@pytest.mark.parametrize("start", ["<div class=content>", "<main>", "<div class='post entry'>"])
def test_nested_candidates_take_linear_time(start):
    took = []
    for n in (10_000, 40_000):
        began = time.process_time()
        assert wrapper.extract("<p>x</p>" + start * n + "hello" + "<p>y</p>" * 10) == "hello y y y y y y y y y y"
        took.append(time.process_time() - began)
    assert took[1] < 10 * max(took[0], 0.2)


def test_the_candidate_with_most_text():
    page = "<div class=content>{}</div><div class=content>{}</div>"
    assert wrapper.extract(page.format("short", "longer text")) == "longer text"
    assert wrapper.extract(page.format("longer text", "short")) == "longer text"
    # noise doesn't count
    assert wrapper.extract(page.format("<div class=ad>long long long</div>a", "text")) == "text"


def test_repeated_headings_of_articles_stay(spark):
    page = "<article><h1>T{0}</h1><h2>Background</h2><p>a{0}</p><p>c{0}</p><h2>Outlook</h2><p>b{0}</p><p>All rights reserved</p></article>"
    frame = spark.createDataFrame([(i, f"http://h.com/{i}", page.format(i)) for i in range(12)], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in wrapper.digest(frame).collect()}
    assert found == {i: f"T{i} Background a{i} c{i} Outlook b{i}" for i in range(12)}


def test_clashing_names(spark):
    rows = [(i, f"http://h.com/{i}", f"<p>t{i}</p>", 1, 2, 3, 4, 5) for i in range(3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, _constant int, _host int, _own0 int, _text int, n_chars int")
    out = wrapper.extract_pages(frame)
    assert out.columns == ["page_id", "url", "html", "_constant", "_host", "_own0", "_text", "text", "n_chars"]
    assert sorted((r.page_id, r["_constant"], r["_host"], r["_own0"], r["_text"], r.text, r.n_chars) for r in out.collect()) == [(i, 1, 2, 3, 4, f"t{i}", 2) for i in range(3)]


def nested_lists(n, odd):
    """A list of n items with inner elements, of which those at ``odd`` have one more, in preorder."""
    out = [(-1, "ul", 0)]
    for i in range(n):
        here = len(out)
        out += [(0, "li", 0), (here, "p", 0)]
        out += [(here, f"i{i % 7}", 0)] if odd(i) else []
    return out


def test_lists_of_every_size_are_aligned():
    took = []
    for n in (20, 480, 5_000):
        a, b = nested_lists(n, lambda i: i % 3 == 0), nested_lists(n + 1, lambda i: i % 5 == 1)
        began = time.process_time()
        shape = wrapper.Shape(a)
        pairs = wrapper.tree_match(shape, wrapper.Shape(b, shape.forms))
        took.append(time.process_time() - began)
        # every item and its paragraph
        assert len(pairs) >= 1 + 2 * n and len(pairs) == len(set(pairs))
    assert took[2] < 20


def test_items_of_long_lists_are_template_as_those_of_short_ones(spark):
    def page(i, n):
        items = "".join(f"<li><p>item {i} {k}</p></li>" for k in range(n + i % 3))
        return f"<html><body><div class=q><b>Home</b></div><ul>{items}</ul><div class=z{i}><p>only {i}</p></div><div class=q><b>Terms</b></div></body></html>"

    for n in (20, 480):
        rows = [(i, "http://h.io/a", page(i, n)) for i in range(12)]
        found = wrapper.extract_pages(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
        for r in found:
            assert r["text"].startswith(f"item {r['page_id']} 0 ") and r["text"].endswith(f"only {r['page_id']}")


def test_pages_keep_clashing_columns(spark):
    rows = [(1, None, None, "a", "b"), (None, "http://h/", "<p>x</p>", None, None)]
    frame = spark.createDataFrame(rows, "page_id int, url string, html string, _host string, _constant string")
    found = wrapper.extract_pages(frame)
    assert found.columns == [*frame.columns, "text", "n_chars"]
    assert {tuple(r) for r in found.collect()} == {(*rows[0], "", 0), (*rows[1], "x", 1)}

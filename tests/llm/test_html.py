"""What the HTML features and blocks take in."""

import html
import re
import time

import pyarrow.parquet as pq
import pytest

from moraine.llm import html_text


def test_all_open_elements_are_features():
    page = "<article>" + "<div>" * 40 + "deep" + "</div>" * 40 + "</article>"
    (block,) = html_text.blocks(page)
    assert {"in:article", "in:div", "own:div"} <= set(html_text.structure(block.tags, block.words))


def test_only_script_style_and_template_are_unseen():
    page = "<p>a <math><mi>x</mi></math> <object>o</object> <noscript>n <b>m</b></noscript> b</p><script>s<b></script><style>t</style><template><p>u</p></template><p>c</p>"
    assert [b.text for b in html_text.blocks(page)] == ["a x o n m b", "c"]


@pytest.mark.parametrize("page,texts", [
    ("<p title=it's>Hello world, we don't stop here.</p>", ["Hello world, we don't stop here."]),
    ('<div class="a"">Text one "quoted" rest.', ['Text one "quoted" rest.']),
    ("super<wbr>cali <b>a</b>b<img src=x>c<br>d", ["supercali abc d"]),
    ("<p>b <a href='x>y'>c</a></p title=\"a>b\">z", ["b c", "z"]),
    ("<!-->x<!--->y<!-- a --!>z<!doctype q>w<?php ?>v</ bogus>u", ["xyzwvu"]),
    ("a < b <3 c", ["a < b <3 c"]), ('<p>x</p><div class="never closed', ["x"]), ("<p a=1/b=2 c = 'd' =e>f", ["f"]), ("<p/class=a>g<p\n\tid=b\n>h", ["g", "h"]),
])
def test_tags_are_read_as_the_standard_does(page, texts):
    assert [b.text for b in html_text.blocks(page)] == texts


def test_attributes():
    (block,) = html_text.blocks("<div CLASS=One id = 'two three' role=\"x\"data-y=no><p class=\"four\"five>t")
    assert block.words == {"one", "two", "three", "x", "four"}


@pytest.mark.parametrize("page", [
    "<div>x" * 40_000, "<b>" * 40_000 + "</i>" * 40_000, "<p>x" * 40_000, "<b>" * 30_000 + "<hr>" * 30_000, "<ul><li><ul>" + "<div>" * 30_000 + "<li>" * 30_000,
    "<a b=" * 40_000, "<x " + "a='" * 40_000, "<p " + "a " * 100_000, "<div class=a>" * 20_000 + "</div>" * 20_000, "</" * 50_000, "<!--" * 30_000,
])
def test_odd_pages_take_time_in_proportion(page):
    began = time.time()
    html_text.blocks(page)
    assert time.time() - began < 5


TEXT = "The harbour was quiet before the storm arrived in the evening. Nobody spoke of it again, and the boats stayed where they were."
OTHER = "Readers often tell us that they would like to know more about the weather. We think so too, and will write about it soon."
BOXES = [
    "<nav>{}</nav>", "<nav><div><div>{}</div></div></nav>", '<div class="comments">{}</div>', '<div class="comments"><div>{}{}</div></div>', "<header><div>{}</div></header>", "<footer><div><div>{}</div></div></footer>",
    "<aside>{}</aside>", '<div class="advert">{}</div>', '<div class="sidebar">{}</div>', '<section id="comments">{}</section>', "<form><label>Name</label>{}<button>Go</button></form>", '<div class="cookie-notice">{}</div>',
]


@pytest.mark.parametrize("box", BOXES)
def test_prose_around_the_article_is_no_main_text(box):
    model, prose = html_text.default_model(), f"<p>{OTHER}</p>"
    for depth in (0, 1, 3):
        other = "<div>" * depth + box.format(prose, prose) + "</div>" * depth
        for place in range(3):
            parts = ["<nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav>", f"<article><h1>Title words here</h1><p>{TEXT}</p><p>{TEXT}</p></article>", "<footer>&copy; x.example &middot; words here.</footer>"]
            parts.insert(place + 1, other)
            page = "<html><head><title>Title words here</title></head><body>" + "".join(parts) + "</body></html>"
            assert html_text.main_text(page, model) == f"Title words here {TEXT} {TEXT}", (depth, place)


def test_all_pages():
    """The article of every page of the largest table, taken from its markup by hand."""
    model = html_text.default_model()
    for page in pq.read_table("/root/testdata/sf0.1/pages.parquet").column("html").to_pylist():
        inside = page[page.index("<article>") + 9 : page.rindex("</article>")]
        text = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1)>|<br>", " ", inside))
        assert html_text.main_text(page, model) == " ".join(html.unescape(text).split())

from __future__ import annotations

import html
import re
import time

import pytest

from streetlens.llm.extraction import main_text

BODY = "".join(f"<p>Paragraph {i} of the body, which is long enough that the text surges here and stays.</p>" for i in range(4))
TEXT = " ".join(f"Paragraph {i} of the body, which is long enough that the text surges here and stays." for i in range(4))


@pytest.mark.parametrize("other", [
    '<div class="main-menu"><a href=x>Home</a> and more</div>', '<div id="main-nav">Start of all pages</div>', '<section id="main-header">The site</section>',
    '<aside class="related"><article><p>A teaser of another page that is long enough to be a surge by itself, if it counted.</p></article></aside>',
    '<footer><div><article>Card</article></div></footer>', '<article class="related-promo">Buy this</article>',
])
def test_marks_do_not_promote(other):
    for page in (f"{other}<div>{BODY}</div>", f"<div>{BODY}</div>{other}"):
        assert main_text(f"<body>{page}</body>") == TEXT


def test_wrapped_articles_stay():
    for start, end in (("<form>", "</form>"), ('<div class="with-sidebar">', "</div>")):
        assert main_text(f"{start}<article>{BODY}</article>{end}") == TEXT
        assert main_text(f"{start}<main>{BODY}</main>{end}") == TEXT
    assert main_text(f'<div class="main-content has-sidebar">{BODY}</div>') == TEXT


def test_tags_do_not_decide_alone():
    """A small marked element does not take the place of the text that surges."""
    links = "<p><a href=x>A link</a></p>" * 5
    assert main_text(f"<article>Tiny</article>{links}<div>{BODY}</div>") == TEXT


def test_line_blocks_without_tags(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        assert main_text(re.sub("<(/?)article>", r"<\1div>", r.html)) == main_text(r.html)


def test_raw_elements_behind_letters_that_lower_longer():
    page = "<p>" + "\u0130" * 60 + "</p><SCRIPT>x</Script><p>kept</p><p>and this one</p>"
    assert main_text(page) == "\u0130" * 60 + " kept and this one"


def test_names_only_weigh():
    """No name takes a whole article away, and renamed classes leave what surges."""
    for name in ("search-guide", "related-work", "ad", "header", "comment-law"):
        assert main_text(f"<body><nav><a href=x>Home</a></nav><div class='{name}'>{BODY}</div><footer>Imprint</footer></body>") == TEXT
    assert main_text(f"<div class='ad'>Buy this now.</div><article>{BODY}<div class='share'>Share it</div><p>End.</p></article><div class='comments'>{BODY}</div>") == f"{TEXT} End."
    assert main_text(f"<div class='qx1'>Buy this now.</div><div class='qx2'><h1>Head</h1>{BODY}</div>") == f"Head {TEXT}"


@pytest.mark.parametrize("renamed", [lambda h: h, lambda h: re.sub("<(/?)article>", r"<\1div>", h), lambda h: re.sub('class="[^"]*"', 'class="q7"', h)])
def test_pages_with_other_names(spark, sf, renamed):
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search("<article>.*</article>", r.html, re.DOTALL)[0]
        text = " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", article))).split())
        assert main_text(renamed(r.html)) == text


def test_unclosed_markup_takes_linear_time():
    page = "<div>" * 60_000 + "x" + "</section>" * 60_000 + BODY
    start = time.perf_counter()
    assert main_text(page).endswith(TEXT)
    assert time.perf_counter() - start < 3

"""Wrappers with the names of page furniture, elements that close themselves, and megabytes of broken markup."""

from __future__ import annotations

import time

import pytest

from rangeframe.llm import html_extract
from rangeframe.llm.html_extract import main_text

BODY = "<p>The first paragraph of the story.</p><p>The second paragraph, which is longer than the first.</p>"
TEXT = "The first paragraph of the story.\nThe second paragraph, which is longer than the first."


@pytest.mark.parametrize(
    "page",
    [
        f'<div id="page" class="site right-sidebar"><article>{BODY}</article></div>',
        f'<div class="social-science">{BODY}</div>',
        f'<form id="aspnetForm"><div>{BODY}</div></form>',
        f'<div class="page-with-menu header-wrap"><div class="share-page">{BODY}</div></div>',
        f'<main>{BODY}<div class="comments"><article class="comment"><p>A reader says that this text is wrong.</p></article></div></main>',
        f'<div class="story">{BODY}</div><div class="cookie-notice"><p>We keep cookies.</p></div>',
        f'<div class="story">{BODY}<form><p>Your address</p><input></form></div>',
        f'<div class="story">{BODY}<div class="related"><p>See also this</p></div></div>',
    ],
)
def test_wrappers_stay_and_asides_go(page):
    assert main_text(page) == TEXT


@pytest.mark.parametrize("tag", ["svg", "math", "object", "select", "template"])
def test_elements_without_running_text(tag):
    assert main_text(f"<article><p>One is here.</p><{tag} width='1'/><p>Two is here.</p></article>") == "One is here.\nTwo is here."
    assert main_text(f"<article><p>One is here.</p><{tag}><p>Two is here.</p></article>") == "One is here.\nTwo is here."
    assert main_text(f"<article><p>One <{tag}>x<{tag} a='b'>y</{tag}>z</{tag}> is here.</p></article>") == "One is here."


def test_headlines_of_an_article_stay():
    page = f'<article><div class="entry-header"><h1>Title</h1><span>by someone</span></div>{BODY}</article>'
    assert main_text(page) == f"Title\n{TEXT}"


@pytest.mark.parametrize(
    "broken",
    ["<a ", '<a ">" ', "<a '", "<svg>", "<", "<!", "<!-- ", "<div>", "<p class='x'>", "</div>", "<script>", "<li><td>", "&#", "<a href=x"],
)
def test_broken_markup_takes_linear_time(broken):
    spent = []
    for size in (250_000, 1_000_000):
        start = time.perf_counter()
        text = main_text(f"<article><p>Some text.</p></article>{broken * (size // len(broken))}")
        spent.append(time.perf_counter() - start)
        assert text.startswith("Some text.")
    assert spent[1] < 8 * spent[0] + 0.5


def test_long_pages_are_read_whole(spark):
    page = "<article>" + "".join(f"<p>Paragraph {n} of a long page.</p>" for n in range(60_000)) + "</article>"
    rows = [(1, "http://a.example/1", page, "x", 5), (1, "http://a.example/1", page, "x", 5), (2, None, None, None, None)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string, path string, n_chars int")
    got = sorted(html_extract.extract_pages(table).collect(), key=lambda r: r["page_id"])
    assert [r["text"].count("\n") for r in got] == [59_999, 59_999, 0] and got[0]["n_chars"] == len(got[0]["text"]) > 1_500_000

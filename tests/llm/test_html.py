"""Main text of small pages."""

import pytest

from quillon.llm.html import blocks_of, html_digest, main_text

LONG = "The people of the town were with us in the long days of the war, and that was not an easy time for any of the families that had to leave from the valley."
LONG2 = "It was in the winter of that year that the river was as high as the old wall, and the men of the village had to go to the mill by boat with all of the corn."
CASES = [
    (None, ""),
    ("", ""),
    ("<p>", ""),
    (f"<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>A&amp;B&nbsp;c<br>d<p>short</article><footer>&copy; x</footer>", "Title\n\nA&B c d\n\nshort"),
    (f"<body><header>Site</header><article><p>{LONG}</p><div class='ad'>Buy now</div><form>name <input></form><p>x < y</p></article>", f"{LONG}\n\nx < y"),
    (f"<div>{LONG}</div><script>if (a<b) document.write('<p>no</p>')</script><style>p{{}}</style><!-- <p>no</p> --><div>{LONG2}</div>", f"{LONG}\n\n{LONG2}"),
    (f"<div class='sidebar'>{LONG}</div><div id=comments><p>{LONG}</p></div><main><p>{LONG2}</p><section class='comments'><p>Nice!</p></section></main>", LONG2),
    (f"<h2>Head</h2><p>{LONG} {LONG2}</p><ul><li><a href=1>one two three</a><li><a href=2>four five six</a></ul>", f"Head\n\n{LONG} {LONG2}"),
    ("<article>one<br><br>two\n\n  three<table><tr><td>c1<td>c2</table></article>", "one\n\ntwo three\n\nc1\n\nc2"),
    ("<article><p>&lt;b&gt; &#233; &eacute; &bogus;</p>", "<b> é é &bogus;"),
    (f"<head><title>x</title><meta a><body><p>{LONG}", LONG),
    (f"<html><head><title>x</title>{LONG}", LONG),
    (f"<form id=aspnetForm><input><main><p>{LONG}</p><p>end</p></main></form>", f"{LONG}\n\nend"),
    (f"<form id=aspnetForm><input><p>{LONG}</p><p>{LONG2}</p><p>{LONG}</p><p>{LONG2}</p></form>", "\n\n".join([LONG, LONG2] * 2)),
    (f"<p>{LONG}</p><form>Your name <input> and the text that you have for us</form>", LONG),
    (f"<div class='site has-sidebar'><p>{LONG}</p></div><div class='page-sidebar'><p>{LONG2}</p></div>", LONG),
    (f"<div class='wrap menu'><main><p>{LONG}</p></main></div>", LONG),
    (f"<article><header class='entry-header'><h1>Title</h1></header><p>{LONG}</p></article><article class='comment'><p>{LONG2}</p></article>", f"Title\n\n{LONG}"),
    (f"<div><p>{LONG}</p><p>{LONG2}</p></div><article><a href=x>More</a><p>A short teaser.</p></article>", f"{LONG}\n\n{LONG2}"),
    (f"<article><p>{LONG}</p><ul><li><a href=1>one two three</a><li><a href=2>four five six</a></ul><p>x 1 y 2 z 3 x 1 y 2 z 3 x 1 y 2 z 3 x 1 y 2 z 3 x 1 y 2 z 3 x 1 y 2 z 3 x 1 y 2 z 3</p></article>", f"{LONG}\n\n{'x 1 y 2 z 3 ' * 7}".rstrip()),
    ('<article><p title="a>b">kept</p><img alt="<no>">end', "kept\n\nend"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_main_text(html, text):
    assert main_text(html) == text


def test_long_and_broken_pages_end():
    assert main_text("<article>" + "<b>x " * 20000).startswith("x x")
    assert main_text("<article>" + "<a \"" * 5000) is not None
    assert main_text("<" * 50000) is not None
    assert len(blocks_of("<div>a</div>" * 3000)) == 3000


def test_digest(spark):
    rows = [(1, "u", CASES[3][0], "t"), (1, "u", None, "t"), (None, None, "", None)]
    got = sorted(html_digest(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect(), key=lambda r: -r.n_chars)
    assert html_digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, CASES[3][1], len(CASES[3][1])), (1, "", 0), (None, "", 0)]

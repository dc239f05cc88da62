"""Main text of pages."""

from __future__ import annotations

import html as stdlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pagegrain.llm.extraction import extract, main_text
from pagegrain.llm.queries import QUERIES

LONG = "A sentence that is long enough, with commas, to count as the text of an article."


def test_pages_of_the_table(spark, sf, con):
    """These pages hold one article of headings and paragraphs without nesting, so it can be cut out by its tags."""
    want = {}
    for page, html in con.execute("SELECT page_id, html FROM pages").fetchall():
        article = re.sub(r"</?b>", "", html[html.index("<article>") + 9:html.index("</article>")])
        parts = [" ".join(stdlib.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want[page] = "\n".join(p for p in parts if p)
    got = QUERIES["op9_html_extraction"](spark, sf).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("  \n ", ""), ("<p>", ""), ("plain &lt; text &amp more", "plain < text & more"), ("<p>cut <b", "cut"),
    (f"<nav>menu</nav><div><p>{LONG}</p><p>Short.</p></div><footer>foot</footer>", f"{LONG}\nShort."),
    (f"<div class='sidebar'><p>{LONG}</p><p>{LONG}</p></div><div class='has-sidebar'><p>{LONG}</p></div>", LONG),
    (f"<article><header><h1>T</h1></header><p>{LONG}<script>if (a<b) '</p>'</script> on</p><aside>x</aside></article><section id=comments><p>{LONG}</p></section>", f"T\n{LONG} on"),
    (f"<main><p>{LONG}<ul><li>one<li>two</ul><table><tr><td>a<td>b</table><ul><li><a>l1</a><li><a>l2</a><li><a>l3</a></ul></main>", f"{LONG}\none\ntwo\na\nb"),
    (f"<div><p>{LONG}</p></div><div style='display: none'><p>{LONG}</p></div><form><p>{LONG}</p></form>", LONG),
    (f"<article><p>{LONG}</p><article class='comment'><p>{LONG}</p></article></article>", LONG),
    (f"<p>{LONG}<br>next<!-- no > --> line\n\t here</p>", f"{LONG} next line here"),
    (f"<body><h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div></body>", f"Title\n{LONG}\n{LONG}"),
    (f"<body><h1>Title</h1><div><div><p>{LONG}</p><p>{LONG}</p></div></div></body>", f"Title\n{LONG}\n{LONG}"),
    (f"<div><section><h2>A</h2><p>{LONG}</p></section><section><p>{LONG * 3}</p><p>{LONG}</p></section><section><p>{LONG}</p></section></div>", f"A\n{LONG}\n{LONG * 3}\n{LONG}\n{LONG}"),
    (f"<body><div><p>{LONG}</p><p>{LONG}</p></div><p>The end.</p></body>", f"{LONG}\n{LONG}\nThe end."),
    (f"<body><blockquote><p>Said one.</p></blockquote><div><p>{LONG}</p><p>{LONG}</p></div><footer>foot</footer></body>", f"Said one.\n{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p><section class='related-work'><h2>Related work</h2><p>{LONG}</p></section><div class='related-posts'>More</div></article>", f"{LONG}\nRelated work\n{LONG}"),
    (f"<div class='site-header'>Site</div><div class='shareButtons'>Share</div><article><p>{LONG}</p></article><p>All rights</p><h2 class='notice-box'>Note</h2>", LONG),
    (f"<body><div><p>{LONG}</p><p>{LONG}</p></div><ul><li><a>l1</a></li><li><a>l2</a></li><li><a>l3</a></li></ul><div><a href=x>more of this</a></div></body>", f"{LONG}\n{LONG}"),
    ("<div>" * 4000 + "deep" + "</div>" * 4000, "deep"),
    ("<p>" + "word, " * 50_000 + "</p>", ("word, " * 50_000).strip()),
])
def test_cases(html, text):
    assert main_text(html) == text


@given(st.text(alphabet="<>/&;ap div=\"'!-\n", max_size=80))
def test_any_text_is_read(html):
    assert isinstance(main_text(html), str)


def test_columns_stay(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "t"), (1, "<p>a</p>", "t"), (2, None, None)], "page_id int, html string, other string")
    got = extract(df, "text")
    assert got.columns == ["page_id", "html", "other", "text"] and sorted(r.text for r in got.collect()) == ["", "a", "a"]
    assert extract(df.where("false"), "text").collect() == []

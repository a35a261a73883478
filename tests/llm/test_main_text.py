import html
import re

import pytest

from tallyloom.llm import main_text, plans

LONG, MORE = "word " * 50 + "end", "more " * 60 + "end"

#: hand-written pages and their main text
PAGES = [
    (None, ""), ("", ""), ("<p>", ""), ("just text", "just text"), (" \n ", ""),
    ("<div><p>Hello &amp; <b>you</b></p><ul><li>one<li>two</ul></div>", "Hello & you\n\none\n\ntwo"),
    (f"<body><nav><a href=1>Home</a></nav><article><h1>Title</h1><p>{LONG}<p>{MORE}</article><footer>&copy; me</footer>", f"Title\n\n{LONG}\n\n{MORE}"),
    (f"<div class='side-bar sidebar'><p>{MORE}</p></div><div><p>{LONG}</p></div>", LONG),
    (f"<div><h1>T</h1><p>{LONG}</p></div><div id=comments><p>{MORE}</p></div>", f"T\n\n{LONG}"),
    (f"<main><section><p>{LONG}</p></section><section><p>{MORE}</p></section></main>", f"{LONG}\n\n{MORE}"),
    (f"<article><p>{LONG}<br>line\n\t two</p><form>Sign up</form><aside>See also</aside><script>var t='</p>';</script></article>", f"{LONG} line two"),
    (f"<div><a href=1>one link</a> <a href=2>two link</a> <a href=3>three</a></div><div><p>{LONG}</p></div>", LONG),
    ("<table><tr><td>A<td>B<tr><td>C</table>", "A\n\nB\n\nC"), ("<p>a<!-- c -->b</p>" + "<i>" * 3000 + "deep", "ab\n\ndeep"),
    ("<script>x<p>y</script>z", "z"), ("<p>&#x4e2d;&#65;&nbsp;&lt;b&gt;</p>", "中A <b>"), ("<P CLASS=x>Upper</P>", "Upper"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_page(page, want):
    assert main_text.main_text(page) == want


def test_long_pages_stay_whole():
    blocks = [f"block {i} " + "text " * 40 + "." for i in range(5000)]
    assert main_text.main_text("<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>") == "\n\n".join(blocks)


def article(page):
    """The article of the generated pages, by their own markup."""
    inner = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
    return "\n\n".join(x for b in blocks if (x := " ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split())))


def test_query_gives_every_article(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = plans.op7_main_text(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_tables(spark):
    rows = [(i, p, "old", 1) for i, (p, _) in enumerate(PAGES)] + [(None, "<p>x</p>", None, None), (3, "just text", "old", 1)]
    out = main_text.extract(spark.createDataFrame(rows, "page_id long, html string, text string, _html int"))
    assert out.columns == ["page_id", "_html", "text"]
    assert sorted(r.text for r in out.collect()) == sorted([w for _, w in PAGES] + ["x", "just text"])
    assert main_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0

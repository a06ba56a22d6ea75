import pytest

from docloom.operators.html import html_sections, page_sections
from docloom.operators.sections import dispatched_sections


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<p>a<br>b</p>", [("", "a\nb")]),
        ("<nav><img src=x></nav><p>after</p>", []),
        ("<h1>T</h1><p>x</p>", [("T", "x")]),
        ("<p>foo<b>bar</b>baz</p>", [("", "foo bar baz")]),
        ("<p>A &amp;lt; B</p>", [("", "A < B")]),
        ("<h2>S</h2><p>x</p>", [("S", "x")]),
        ("<article><p>short</p></article><div>outside</div>", [("", "short")]),
        ("<article></article><p>out</p>", [("", "out")]),
        ("<h1>T<p>x</p>", []),
        ("<h1>T</h2><p>x</p>", [("T", "x")]),
        ("<article><p>in<br></p></article><div>tail</div>", [("", "in\ntail")]),
        ('<div class="x Navbar">n</div><p>y</p>', [("", "y")]),
        ("<p>use <code>f</code> now</p>", [("", "use\nf\nnow")]),
        ("<h1>A</h1>x<h3>C</h3>y<h2>B</h2>z", [("A", "x"), ("A > C", "y"), ("A > B", "z")]),
    ],
)
def test_pages(html, expected):
    assert page_sections(html)[0] == expected


def test_frame_and_dispatch(spark):
    rows = [("a.html", "<h1>T</h1><p>x</p>"), ("b.htm", "<h1>T"), ("c.md", "# A\nx"), ("d.html", None)]
    docs = spark.createDataFrame(rows, "path string, text string")
    got = {(r.path, r.title, r.body) for r in dispatched_sections(docs, "path", "path", "text").collect()}
    assert got == {("a.html", "T", "x"), ("b.htm", "", "<h1>T"), ("c.md", "A", "x")}
    assert html_sections(docs.filter("path = 'd.html'"), "path", "text").count() == 0

import pytest
from pyspark.sql import functions as F

from scribemend.llm import pages


def text(html):
    return " ".join(t for _, _, t in pages.Page(html).content())


@pytest.mark.parametrize(("html", "want"), [
    ("", ""), ("just text", "just text"), ("<p>a<p>b<br>c", "a b c"), ("<p>x<b>y</b>z", "xyz"),
    ("<p>&lt;b&gt; &amp; &#233; &eacute;&nbsp;! &copy", "<b> & é é ! ©"),
    ("<nav>no</nav><article><h1>T</h1><p>one</article><footer>no</footer>", "T one"),
    ("<article><header><h1>T</h1></header><p>a</p><footer>no</footer><aside>no</aside></article>", "T a"),
    ("<div class='has-sidebar'><article>in</article></div>", "in"),
    ("<article>a<section id='comments'><article class='comment'>no</article></section></article>", "a"),
    ("<main><p>m</p><form>no</form></main><p>out</p>", "m"),
    ("<div class='ad'>no</div><div class='cookie-notice'>no</div><div id='sidebar'>no</div><p>yes</p>", "yes"),
    ("<script>if (a<b) t='</p>'</script><style>p{}</style><title>no</title><p>yes", "yes"),
    ("<!-- <p>no</p> --><p>1 < 2", "1 < 2"), ("<p>a<!-- open", "a"), ("<p a='>' b=\">\">yes</p>", "yes"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "a b c"), ("<table><tr><td>1<td>2<tr><th>3</table>", "1 2 3"),
    ("</div></p><p>still</span>", "still"), ("<p hidden>no<p style='display: none'>no<p>yes", "yes"),
    ("<div role=navigation>no</div><DIV>yes</DIV>", "yes"), ("<p>a \n\t b\xa0 c</p>", "a b c"), ("<p>one</p" + " " * 5, "one"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<article>" + "<p>long text</p>" * 20000 + "</article>", " ".join(["long text"] * 20000)),
])
def test_one_page(html, want):
    assert text(html) == want


def test_site_tree_removes_what_all_pages_say(llm):
    def page(i, host):
        return f"<body><div><p>Read our daily letter</p></div><div><p>story {host} {i} told</p><p>end {i}</p></div></body>"
    rows = [(i, f"https://www.a.org/{i}", page(i, "a")) for i in range(12)] + [(100 + i, "http://a.org/copy", page(0, "a")) for i in range(40)]
    rows += [(200, "https://b.org/x", page(200, "b")), (201, None, "<p>no url"), (202, "https://c.org", None), (203, "nonsense", ""),
             (204, "https://a.org/y", "<article>Read our daily letter</article>"), (None, "https://b.net", "<p>no id</p>"), (200, "https://b.org/x", page(200, "b"))]
    table = llm.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in pages.main_text(table).collect()), key=str)
    want = [(i, f"story a {i} told end {i}") for i in range(12)] + [(100 + i, "story a 0 told end 0") for i in range(40)]
    want += [(200, "Read our daily letter story b 200 told end 200")] * 2 + [(201, "no url"), (202, ""), (203, ""), (204, "Read our daily letter"), (None, "no id")]
    assert got == sorted(((i, t, len(t)) for i, t in want), key=str)
    assert pages.main_text(table.limit(0)).count() == 0


def test_hosts(llm):
    urls = ["https://www.X.org:80/a?b#c", "//user@x.org", "http://x.org", "x.org/a", None, ""]
    rows = llm.createDataFrame([(u,) for u in urls], "url string").select(pages.host(F.col("url")).alias("h"))
    assert [r["h"] for r in rows.collect()] == ["x.org", "x.org", "x.org", "", "", ""]


def read(llm, htmls, site="https://a.org/"):
    table = llm.createDataFrame([(i, f"{site}{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return [r["text"] for r in sorted(pages.main_text(table).collect(), key=lambda r: r["page_id"])]


def test_tree_decides_inside_and_beside_articles(llm):
    inside = [f"<article><h1>title {i}</h1><p>Read our daily letter now</p><p>a longer story number {i} is told here</p></article>" for i in range(20)]
    assert read(llm, inside) == [f"title {i} a longer story number {i} is told here" for i in range(20)]
    headed = [f"<main><h1>title {i}</h1><p>lead {i}</p><article>story {i}</article><p>more {i}</p></main>" for i in range(3)]
    assert read(llm, headed) == [f"title {i} lead {i} story {i} more {i}" for i in range(3)]
    teaser = [f"<div><p>the body of page {i} goes on and on</p></div><article>teaser {i}</article><div><p>All rights reserved</p></div>" for i in range(20)]
    assert read(llm, teaser) == [f"the body of page {i} goes on and on teaser {i}" for i in range(20)]


def test_copies_do_not_make_a_template(llm):
    body = "a body that many pages of this site have " * 5
    def page(i, text):
        return f"<div class=ad>advert {i}</div><div><p>{text}</p></div><div><i>day {i}</i></div>"
    many = [page(i, body if i < 90 else f"text {i} of its own") for i in range(100)]
    want = [f"{body.strip()} day {i}" if i < 90 else f"text {i} of its own day {i}" for i in range(100)]
    assert read(llm, many) == want
    assert read(llm, [page(i, body) for i in range(2)]) == [f"{body.strip()} day {i}" for i in range(2)]


def test_a_content_of_one_page_stays_in_a_low_branch(llm):
    htmls = [f"<div><p>{'Sold by the same shop' if i < 95 else f'only page {i} says so'}</p></div><div><p>goods number {i} with words</p></div>" for i in range(100)]
    assert read(llm, htmls) == [f"{'' if i < 95 else f'only page {i} says so '}goods number {i} with words" for i in range(100)]


def test_many_cut_branches_are_shuffled(llm, monkeypatch):
    htmls = [f"<div>All rights reserved</div><p>words of page {i} alone</p>" for i in range(9)] * 2
    monkeypatch.setattr(pages, "KEY_ROWS", 0)
    assert read(llm, htmls) == [f"words of page {i} alone" for i in range(9)] * 2

import random

import pytest

from cohortspan.llm import html_text
from tests.llm.conftest import with_clashes

PAGE = """<!DOCTYPE html><html><head><title>Title</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li>Menu</li></ul></nav><!-- <p>gone</p> --><div class="ad">Buy</div>
<article><header><h1>Head &amp; shoulders</h1></header><p><b>First
   line<br>second &lt;i&gt; &copy; 5 &#x41;&#66; a < b<p>Next&nbsp;one</p><form>Name <input></form>
<div class="share-bar comments">Like</div><ul><li>x</li><li>y</ul><pre>a
 b</pre></article><aside>Side</aside><section id="comments"><p>Nice!</p></section><footer>&copy; us</footer>"""


def test_one_page():
    expected = ["Head & shoulders", "First line second <i> © 5 AB a < b", "Next one", "x", "y", "a b"]
    assert html_text.main_text(html_text.lines_of(PAGE), []).split("\n\n") == expected


@pytest.mark.parametrize("page", [None, "", "   ", "<!-- open", "<p", "</p></div>", "<script>x", "<nav><p>a</nav>"])
def test_pages_without_text(page):
    assert html_text.main_text(html_text.lines_of(page), []) == ""


def test_broken_pages():
    assert html_text.main_text(html_text.lines_of("<div><p>a<div hidden>b</div><b class=ad>c</b>d<p title='>'>e &amp"), []) == "a\n\nd\n\ne &"
    assert html_text.main_text(html_text.lines_of("<article><p>kept<article><p>inner</article><p>too</article><p>not"), []) == "kept\n\ninner\n\ntoo"


def test_marked_parts():
    page = "<main><p>crumbs</p><article class=post><div class='post-header'><h1>T</h1></div><p>x</p><article class=comment>c</article></article></main>"
    assert html_text.main_text(html_text.lines_of(page), []) == "T\n\nx"
    assert html_text.main_text(html_text.lines_of("<div role=main><p>a</p><div class=sidebar>s</div></div><p>b"), []) == "a"


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("seed", range(40))
def test_common_lines_are_longest(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcdef"[: rng.randint(1, 6)]) for _ in range(rng.randint(0, 30))] for _ in "ab")
    shared = sorted(html_text.common_lines(a, b))
    assert len(shared) == longest(a, b)
    rest = iter(b)
    assert all(a[i] in rest for i in shared)


def test_very_long_pages_are_aligned_by_single_lines(monkeypatch):
    monkeypatch.setattr(html_text, "TABLE_BITS", 4)
    assert html_text.common_lines(list("xaybzc"), list("qabrc")) == {1, 3, 5}


def site(spark, n):
    """Pages without a marked article: a banner, a notice and a last line around a text of their own."""
    rows = []
    for host in ("a.example", "b.example"):
        for i in range(n):
            own = "".join(f"<p>{host} {i} {k}</p>" for k in range(3))
            rows.append((len(rows), f"http://{host}/x/{i:03d}", f"<p>Welcome to {host}</p><p>Notice</p>{own}<p>Imprint</p>"))
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("cells", [1, 7])
def test_lines_that_neighbours_share_go(spark, cells):
    found = html_text.extract(site(spark, 12), cells).collect()
    assert len(found) == 24
    for row in found:
        host, i = ("a.example", row.page_id) if row.page_id < 12 else ("b.example", row.page_id - 12)
        assert row.text == "\n\n".join(f"{host} {i} {k}" for k in range(3))
        assert row.n_chars == len(row.text)


def test_copies_and_marked_articles_stay(spark):
    same = "<nav>m</nav><article><p>All of it</p><p>shared</p></article>"
    rows = [(i, f"http://h/{i}", same) for i in range(5)] + [(9, "http://h/9", "<article><p>All of it</p><p>own</p></article>")]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), 3).collect()
    assert {r.page_id: r.text for r in found} == {**{i: "All of it\n\nshared" for i in range(5)}, 9: "All of it\n\nown"}


def test_odd_pages(spark):
    rows = [(None, None, None), (1, None, "<p>a"), (1, None, "<p>a"), (2, "no host", ""), (3, "http://h", "<p>" + "b " * 100_000), (4, "http://h", None)]
    pages = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = html_text.extract(pages, 3).collect()
    assert sorted((r.page_id or 0, r.text[:1], r.n_chars) for r in found) == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "", 0), (3, "b", 199_999), (4, "", 0)]
    assert html_text.extract(pages.limit(0), 3).count() == 0


def test_site_lines_go_from_marked_articles(spark):
    """A notice that the articles of a site carry goes, whatever its class; what two articles share, or copies, stays."""
    rows = [
        (i, f"http://h/{i:02d}", f"<nav>m</nav><article><p class=x>Read this first</p><p>own text of {i} at length</p>{q}</article>")
        for i, q in enumerate(["", "", "<p>quoted</p>", "<p>quoted</p>", "", ""])
    ]
    copied = "<article><p>Head</p><p>A long passage that all have</p><p>{}</p></article>"
    rows += [(10 + i, f"http://copies/{i:02d}", copied.format(i)) for i in range(4)]
    found = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), 1).collect()}
    for i in range(1, 5):
        assert found[i] == f"own text of {i} at length" + ("\n\nquoted" if i in (2, 3) else "")
    for i in range(4):
        assert found[10 + i] == f"Head\n\nA long passage that all have\n\n{i}"


def test_headlines_and_stock_paragraphs_stay_in_marked_articles(spark):
    """Shared with both neighbours: a headline and a paragraph somewhere in the text stay, a notice at the foot goes."""
    own = lambda i, k: f"<p>sentence {k} of page {i}, which no other page has</p>"
    rows = []
    for i in range(6):
        before = "".join(own(i, k) for k in range(1 + i % 3))
        after = "".join(own(i, k) for k in range(9, 11 + i % 2))
        page = f"<title>Daily news</title><main><h2>Daily news</h2>{before}<p>A stock phrase</p>{after}<div>Follow us</div></main>"
        rows.append((i, f"http://h/{i:02d}", page))
    found = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), 1).collect()}
    for i in range(6):
        lines = found[i].split("\n\n")
        assert lines[0] == "Daily news" and "A stock phrase" in lines
        assert ("Follow us" in lines) == (i in (0, 5))


@pytest.mark.parametrize("seed", range(20))
def test_alignments_in_parts_are_longest(seed, monkeypatch):
    monkeypatch.setattr(html_text, "TABLE_BITS", 6)
    monkeypatch.setattr(html_text, "BLOCK", 3)
    test_common_lines_are_longest(seed)


def test_site_lines_of_the_longest_pages():
    """Beyond the table's size and 20,000 lines, with lines that come once and lines that come often."""
    pages = []
    for page, n in (("a", 24_000), ("b", 14_000)):
        lines = [f"{page}{i}" for i in range(n)]
        for k in range(40):
            lines[k * 300 + 7] = f"notice {k}"
            lines[k * 300 + 150] = "more"
        pages.append(lines)
    a, b = pages
    assert (len(a) - 2) * (len(b) - 2) > html_text.TABLE_BITS
    assert html_text.common_lines(a, b) == {k * 300 + d for k in range(40) for d in (7, 150)}


@pytest.mark.parametrize("cells", [1, 5, 40])
def test_runs_of_copies_have_neighbours_beyond_their_range(spark, cells):
    """Copies that open a host, that lie between others and that end it are cleaned alike, whatever ranges they fall in."""
    page = "<p>Menu</p><p>{}</p><p>Imprint</p>"
    own = ["first"] * 30 + ["one"] + ["middle"] * 30 + ["two"] + ["last"] * 30
    rows = [(i, f"http://h/{i:03d}", page.format(text)) for i, text in enumerate(own)]
    rows += [(1000 + i, f"http://alone/{i:03d}", page.format("same")) for i in range(20)]
    found = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), cells).collect()}
    assert found == {**dict(enumerate(own)), **{1000 + i: "Menu\n\nsame\n\nImprint" for i in range(20)}}

import html
import re
import time

import numpy as np
import pytest

from voxelloom.llm import html_blocks, html_text
from voxelloom.llm.html_samples import labelled_pages

PAGES = "/root/testdata/sf0.001/pages.parquet"


@pytest.fixture(scope="module")
def model():
    return html_text.fit(labelled_pages(html_text.PAGES))


def article_lines(page):
    """Main text of the given tables' pages, which are all made alike."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1).replace("<b>", "").replace("</b>", "").replace("<br>", " ")
    blocks = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, model, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_text.extract(pages, model).collect()}
    want = {r.page_id: (r.url, article_lines(r.html), len(article_lines(r.html))) for r in pages.collect()}
    assert got == want


def test_held_out_labelled_pages(model):
    hit = said = true = 0
    for page, text in labelled_pages(200, seed=77):
        found = html_blocks.read(page)
        want, got = html_text.labels(found.blocks, text) > 0, np.array(model.decode(found.blocks, found.title), bool)
        hit, said, true = hit + (want & got).sum(), said + got.sum(), true + want.sum()
    assert hit / said > 0.95 and hit / true > 0.95


PAGE = """<!doctype html><html><head><title>A day at sea</title><script>if (a < b) { x = "</p>"; }</script></head><body>
<div class="cookie-banner">We use cookies, as all do. <button>Fine</button></div>
<header class="site-header"><a href="/">The Paper</a><nav><ul><li><a href="/a">News</a><li><a href="/b">Sport</a></ul></nav></header>
<div id="main-content"><article class="post"><h1>A day at sea</h1><p>The wind was &lt;strong&gt;&nbsp;&amp; cold,
   we <b>stayed<p>Short.<ul><li>one<li>two</ul><div class="ad">Buy boats now, they are cheap.</div><p>Last words &#8211; and a <a href="x">link</a>.</article></div>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">Other story</a></li></ul></aside>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this very much, thank you for writing it.</p></div><form><label>Name</label><input><button>Send</button></form></section>
<footer>&copy; 2020 The Paper, all rights reserved.</footer></body></html>"""


def test_one_page_by_hand(model):
    assert model.text(PAGE) == "A day at sea\nThe wind was <strong> & cold, we stayed\nShort.\none\ntwo\nLast words – and a link."
    bare = re.sub(r' (class|id)="[^"]*"', "", PAGE.replace("<div>Buy", "<aside>Buy"))
    assert model.text(bare).startswith("A day at sea\nThe wind was <strong> & cold, we stayed\nShort.\none\ntwo\n")


def test_likelihood_is_that_of_all_labellings():
    """The trained weights make the labelled pages likely, by sums over all labellings."""
    pages = [(p, t) for p, t in labelled_pages(60, seed=3) if 0 < len(html_blocks.read(p).blocks) <= 8]
    few, many = html_text.fit(pages, rounds=1), html_text.fit(pages, rounds=120)

    def log_likelihood(model):
        total = 0.0
        for page, text in pages:
            found = html_blocks.read(page)
            scores = [sum(model.weight.get(f, 0) for f in fs) for fs in html_text.features(found.blocks, found.title)]
            want = (html_text.labels(found.blocks, text) > 0).astype(int).tolist()

            def value(y):
                return (sum(s for s, k in zip(scores, y) if k) + sum(model.step[a, b] for a, b in zip(y, y[1:])) + model.first * y[0] + model.last * y[-1])

            every = [[n >> i & 1 for i in range(len(want))] for n in range(2 ** len(want))]
            values = [value(y) for y in every]
            total += value(want) - np.logaddexp.reduce(values)
            assert value([int(x) for x in model.decode(found.blocks, found.title)]) == pytest.approx(max(values))  # Viterbi is exact
        return total / len(pages)

    assert log_likelihood(many) > log_likelihood(few) and log_likelihood(many) > -0.5


def test_blocks():
    read = lambda page: [b.text for b in html_blocks.read(page).blocks]
    assert read("<p>a<p>b<br>c</p>d<!-- x --> e<div>f</div>") == ["a", "b c", "d e", "f"]
    assert read("a < b &amp c &am d &#x41; <a title='>'>link</a>") == ["a < b & c &am d A link"]
    assert read("<style>p{}</style><SCRIPT>x</p></Script >t<textarea>no</textarea><template>no</template><p hidden>no</p>") == ["t"]
    assert read("x<p class=\"a>y") == ["x", "y"] and read("x<p class='a") == ["x"] and read("x<") == ["x<"] and read("x</>y<?z>w<!d>") == ["xyw"]
    assert read("") == [] and read("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    by = html_blocks.read('<div class="siteNav main-menu"><p>x</p></div>').blocks[0]
    assert by.above == {"<div", "<p", "site", "nav", "main", "menu"} and by.named == {"site", "nav", "main", "menu"} and by.tag == "p"


@pytest.mark.parametrize("piece", ["<", "<a ", "<p ", '<p a="', "<div>", "<!--", "</div>", "<p>x", "<script>", "&amp", "<a b='c>", "x ", "<li>", "</p><b>"])
def test_time_is_linear(model, piece):
    start = time.time()
    model.text(piece * (400_000 // len(piece)))
    assert time.time() - start < 10


def test_odd_rows(spark, model):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>Hello there, world.</p>", None), (2, "v", "", "y"), (3, "w", "  \n ", "y"), (4, "w", "no markup at all", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_text.extract(pages, model).collect()), key=repr)
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "Hello there, world.", 19), (2, "v", "", 0), (3, "w", "", 0), (4, "w", "no markup at all", 16)], key=repr)
    assert html_text.extract(pages.limit(0), model).count() == 0
    assert html_text.fit([]).text("<p>x</p>") == ""

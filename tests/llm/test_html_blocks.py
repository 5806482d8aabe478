import html
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from webskein.llm import html_blocks as q
from webskein.llm import html_training

PAGE = """<html><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="post"><h2>A story</h2>
<p>It was a long day in the town and <b>everyone</b> had gone home early.</p><div class="ad">Buy now the best thing ever made by anyone in the world.</div>
<p>Then it rained &amp; <i>all</i>&nbsp;was   well.</p><script>var p = "<p>no</p>";</script></div>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>I liked this story a lot, it reminds me of my own long day in the town.</p></div></section>
<form><p>Subscribe to the letter</p></form><aside><p>Most read stories of the week are listed here for you.</p></aside><footer><p>Copyright</p></footer></body></html>"""


@pytest.fixture(scope="module")
def model():
    return html_training.trained(400)


def texts(page):
    return [b.text for b in q.blocks(page)]


def test_blocks():
    assert texts("a<b>b</b>c<br>d<p>e<p>f<ul><li>g<li>h</ul>i<!-- x --><td>j<td>k &lt;&#233; <3 l<div cla") == ["abc", "d", "e", "f", "g", "h", "i", "j", "k <é <3 l"]
    assert texts("<style>p{}</style><script>if (a<b) '<p>x</p>'</script><title>t</title>x") == ["x"]
    assert [b.path for b in q.blocks('<div class="a-b c"><p>x<p>y</div>z')] == [("div a b c", "p"), ("div a b c", "p"), ()]
    assert texts("<p>x <a href='q?a>b'>y</a> &am") == ["x y &am"] and q.blocks("<a>xy</a>")[0].links == 2
    assert texts("") == texts("<!-- open") == texts("<p") == []
    assert texts("<h2>x</h3>y") == ["x", "y"] and q.blocks("<h2>x</h3><p>y")[1].path == ("p",)


def test_attributes_of_any_number_and_cut_off_tags():
    link = lambda n: f"<a {'x=1 ' * n}title=\"a > b\" y='>'>link</a> after"
    assert texts(link(100)) == texts(link(50_000)) == ["link after"]
    assert texts('<p class="a>b" title = \'c>d\'>x') == ["x"] and texts("<p it's>x") == ["x"]
    assert texts("x<b " * 30_000) == ["x"] and texts("<p a='b>x") == ["x"]


def test_deep_pages_take_linear_time_and_memory():
    def seconds(n):
        began = time.perf_counter()
        for page in ("<div>x" * n, "<b>" * n + "<p>x" * n, "<h2><b>" * n + "</i></h3>x" * n):
            q.features([q.blocks(page)])
        return time.perf_counter() - began

    seconds(1000)
    small, large = min(seconds(5000) for _ in range(2)), seconds(50_000)
    assert large < 10 * small * 2.5 + 1
    tracemalloc.start()
    q.blocks("<div>x" * 100_000)
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


def test_gradients_are_those_of_the_loss():
    pages = [html_training.generated(k) for k in (1, 2)]
    m = q.Labeller.new(3)
    x = q.features([b for b, _ in pages])
    sizes, y = np.array([len(b) for b, _ in pages]), np.concatenate([l for _, l in pages]).astype(np.float64)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    _, grad = m.gradients(x, sizes, y)
    for name in ("xf", "hb", "cf", "o", "s"):
        at = np.unravel_index(np.argmax(np.abs(grad[name])), grad[name].shape)
        loss = []
        for e in (1e-3, -1e-3):
            m.w[name][at] += e
            loss.append(m.gradients(x, sizes, y)[0])
            m.w[name][at] -= e
        assert grad[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-3, rel=0.02)


def test_held_out_accuracy(model):
    pages = [x for x in (html_training.generated(5_000_000 + k) for k in range(200)) if x[0]]
    p = model.probabilities(q.features([b for b, _ in pages]), [len(b) for b, _ in pages])
    y = np.concatenate([l for _, l in pages])
    assert np.mean((p >= 0.5) == y) > 0.985
    one_by_one = np.concatenate([model.probabilities(q.features([b]), [len(b)]) for b, _ in pages])
    assert np.abs(one_by_one - p).max() < 1e-4


def test_pages_give_their_articles(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r.page_id: r for r in q.extract(pages, model.w).collect()}
    right = 0
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<(?:br|/?p|/?h1)>", " ", re.sub(r"</?b>", "", inner))).split())
        right += got[r.page_id].text == want
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    assert right >= 0.99 * len(got) and len(got) == 2500


def test_odd_pages(spark, model):
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (None, "u", PAGE, "t"), (3, "u", PAGE, "t"), (3, "u", PAGE, "t"), (4, "u", "<div>x" * 20_000 + "deep", "t"), (5, "u", "<article>" + "<p>some words of a paragraph, and more.</p>" * 5000 + "</article>", "t"), (6, "u", "<script>only", "t")]
    schema = "page_id bigint, url string, html string, text string"
    got = q.extract(spark.createDataFrame(rows, schema), model.w).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == by[6] == "" and len(by[5]) == 5000 * 37 - 1
    assert by[3] == by[None] == "A story It was a long day in the town and everyone had gone home early. Then it rained & all was well."
    assert q.extract(spark.createDataFrame([], schema), model.w).count() == 0
    assert q.labelled_blocks(spark.createDataFrame(rows[:4], schema), model.w).count() == 2 * len(q.blocks(PAGE))

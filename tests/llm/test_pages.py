import itertools
import math
import time

import pytest

from inkwell.llm import pages


@pytest.fixture(scope="module")
def model():
    return pages.default_model()


def test_messages_give_exact_marginals(model):
    page = "<body><nav><a href=x>menu</a></nav><div class=post><p>one two three.</p><p>four</p></div><div class=ad>buy</div></body>"
    nodes = pages.parse(page)
    named, _ = pages.features(nodes)
    own = [model.weights.get("bias", 0) + sum(model.weights.get(f, 0) for f in fs) for fs in named]
    edges = model.edge(nodes)
    total, ones = 0.0, [0.0] * len(nodes)
    for x in itertools.product((0, 1), repeat=len(nodes)):
        p = math.exp(sum(o for o, v in zip(own, x, strict=True) if v))
        for i in range(1, len(nodes)):
            p *= edges[i][2 * x[nodes[i].parent] + x[i]]
        total += p
        for i, v in enumerate(x):
            ones[i] += p * v
    for got, one in zip(model.marginals(nodes, named), ones, strict=True):
        assert abs(got - one / total) < 1e-9


def test_held_out_accuracy(model):
    good = n = 0
    for page, marks in pages.labelled_pages(120, seed=12345):
        nodes = pages.parse(page)
        p = model.marginals(nodes, pages.features(nodes)[0])
        got = [int(x > 0.5) for x, node in zip(p, nodes, strict=True) if node.tag == "#text"]
        good += sum(a == b for a, b in zip(got, marks, strict=True))
        n += len(marks)
    assert good / n > 0.98


def runs(page):
    return [pages.block_text(n) for n in pages.parse(page) if n.tag == "#text"]


def test_parsing():
    assert runs("<p>a<p>b<ul><li>c<li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert runs("<p><b>bold <br>x&amp;y&nbsp; z</p>tail <i>i</i>n") == ["bold x&y z", "tail in"]
    assert runs("<script>if (a<b) '</p>'</script>t<!-- <p>no</p> -->u<style>p{}</style>") == ["tu"]
    assert runs('<div data-x="a>b">q</div><p title=\'<p>\'>r') == ["q", "r"]
    assert runs("a < b &am &lt;c <p unfinished") == ["a < b &am <c"]
    assert runs("x<!-- open") == ["x"] and runs("y<script>open") == ["y"] and runs("") == []
    assert runs("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert runs("<TITLE>no</TITLE><DIV>yes</DIV></div></p>!") == ["yes", "!"]


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site-header"><a href="/">Site name</a></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site.</div>
<article><h1>The  title</h1><p>First paragraph, with <a href="#">a link</a> in it &mdash; and more words.</p>
<div class="ad">Buy this now. It is cheap.</div><p>Second paragraph goes on for a while, too.</p></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">Other story</a></li></ul></aside>
<form class="newsletter"><label>Your mail</label><button>Go</button></form>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this a lot.</p></div></section>
<footer>&copy; Site</footer></body></html>"""


def test_whole_page(model):
    want = ["The title", "First paragraph, with a link in it — and more words.", "Second paragraph goes on for a while, too."]
    assert model.extract(ARTICLE) == "\n\n".join(want)


def test_main_text(spark, model):
    rows = [(1, "u", ARTICLE, "x"), (1, "u", ARTICLE, "x"), (2, None, None, "x"), (3, "v", "", "x"), (4, "w", "<article><p>" + "Long words here. " * 20000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = pages.main_text(df, model).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r for r in got}
    assert by[2].text == "" and by[3].text == "" and by[2].url is None
    assert by[4].n_chars == 17 * 20000 - 1
    assert pages.main_text(df.limit(0), model).count() == 0


def test_deep_pages_take_time_in_proportion(model):
    import time

    for open_, close in (("<div>", "</div>"), ("<p><button>" + "<div>" * 1, ""), ("<li>", "</li>"), ("<table><tr><td>", ""), ("<b><div>", "")):
        took = []
        for n in (10_000, 100_000):
            page = open_ * n + "word" + close * n
            began = time.process_time()
            assert runs(page) == ["word"]
            took.append(time.process_time() - began)
        assert took[1] < 40 * max(took[0], 0.05)
    assert isinstance(model.extract("<div>" * 100_000 + "x"), str)


def test_elements_left_out():
    assert runs("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b") == ["a x=2 b"]
    assert runs("<p>a<svg><text>no</text></svg>b<svg/>c<script/>no</script>d<select><option>no</select>e") == ["abcde"]
    assert runs("<p>a<svg>b<p>c<noscript>d") == ["ab", "cd"]


def test_small_batches_and_columns(spark):
    rows = [(i, "u", "<article><p>" + "Some words of an article, and more of them here. " * 5 + "</p></article>", "t", i) for i in range(20)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = pages.main_text(df).collect()
    assert len(got) == 21 and sum(r.n_chars == 0 for r in got) == 1 and tuple(got[0].__fields__) == ("page_id", "url", "text", "n_chars")


@pytest.mark.parametrize("tag", ["svg", "select", "template", "noscript"])
def test_time_in_proportion_to_unclosed_elements(tag):
    began = time.process_time()
    nodes = pages.parse(f"<p>first words</p><{tag}>" * 80_000 + "<p>last words</p>")
    assert time.process_time() - began < 5 and len(nodes) > 80_000
    began = time.process_time()
    nodes = pages.parse(f"<{tag}>" * 80_000 + "<p>last words</p>")
    assert time.process_time() - began < 1 and nodes[-1].text == ["last words"]


def test_end_tags_are_found_behind_letters_that_grow_in_lower_case():
    nodes = pages.parse("\u0130" * 50 + "<SVG><p>drawn</p></SvG><p>said</p>")
    assert [t for n in nodes for t in n.text] == ["\u0130" * 50, "said"]

"""Blocks of broken pages, the network's gradients, and extracted articles."""

import html
import re
import tracemalloc

import numpy as np
import pytest

from featmart.llm import page_text, queries


def texts(page):
    return [b.text for b in page_text.blocks(page)]


@pytest.mark.parametrize("page,want", [
    ("", []), ("plain  text\n here", ["plain text here"]), ("<p>a<p>b<div>c</div>d", ["a", "b", "c", "d"]),
    ("<p>one <b>t</b>wo<br>three</p>", ["one two", "three"]), ("<script>x<p>y</script>z<style>q", ["z"]),
    ("<!-- <p>no</p> -->yes<!-- open", ["yes"]), ("a &amp; b &lt;c&gt; &copy &unknown; &#233;", ["a & b <c> © &unknown; é"]),
    ("<p title='a > b'>in</p>", ["in"]), ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("x < y and <p", ["x < y and"]),
    ("</div></p>ok</b>ay<i>!", ["okay!"]), ("<textarea>t</textarea><title>u</title>v", ["v"]), ("a&nbsp;&nbsp;b\t c", ["a b c"]),
    ("<ScRipT>1</sCRIPT >2", ["2"]), ("<p>" * 50 + "deep", ["deep"]), ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ("<div class=ad><p>x</p></div", ["x"]), ("<br/><hr>a<img src=x>b", ["a", "b"]),
])
def test_blocks(page, want):
    assert texts(page) == want


def test_paths_close_with_their_parents():
    found = page_text.blocks('<nav class="Top-Menu"><ul><li><a href=x>m</a></ul></nav><article><p><b>t<br><p>u</p></article><footer id=f>e')
    assert [tuple(b.path.names()) for b in found] == [("nav menu top", "ul", "li"), ("article", "p"), ("article", "p"), ("footer f",)]
    assert [b.linked for b in found] == [1, 0, 0, 0]


def test_gradients():
    table = page_text.labelled_pages(6, seed=8)
    x, length = page_text._padded(page_text.vectors([page_text.blocks(p) for p, _ in table]))
    goal = np.zeros(x.shape[:2], dtype=np.float32)
    for k, (_, truth) in enumerate(table):
        goal[: length[k], k] = truth
    model = page_text.BiLstm()

    def loss():
        z = model.logits(x, length)[0].astype(float)
        inside = np.arange(len(x))[:, None] < length
        return np.where(inside, np.logaddexp(0, z) - goal * z, 0).sum() / inside.sum()

    for name, slope in model.slopes(x, length, goal).items():
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        kept = model.p[name][at]
        sides = []
        for step in (0.01, -0.01):
            model.p[name][at] = kept + step
            sides.append(loss())
        model.p[name][at] = kept
        assert (sides[0] - sides[1]) / 0.02 == pytest.approx(slope[at], rel=0.05, abs=1e-4)


@pytest.fixture(scope="module")
def model():
    return page_text.train(None)


def test_held_out_parts(model):
    table = page_text.labelled_pages(200, seed=99)
    chances = model.label(page_text.vectors([page_text.blocks(p) for p, _ in table]))
    right = np.concatenate([(c > 0.5) == np.array(t) for c, (_, t) in zip(chances, table)])
    assert right.mean() > 0.985


def test_padding_and_batches_do_not_matter(model):
    pages = [page_text.blocks(p) for p, _ in page_text.labelled_pages(30, seed=4)] + [[]]
    together = model.label(page_text.vectors(pages))
    for page, chance in zip(pages, together):
        assert np.allclose(chance, model.label(page_text.vectors([page]))[0], atol=1e-4)


def article(page):
    body = re.search(r"(?s)<article>(.*?)(?:</article>|$)", page)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())


def test_query_over_pages(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = queries.PLANS["op4_page_text"](spark, folder).collect()
    assert len(got) == len(pages)
    assert all(r.url == pages[r.page_id].url and r.n_chars == len(r.text) for r in got)
    assert all(r.text == article(pages[r.page_id].html) for r in got)


def test_odd_pages(spark, model):
    rows = [(1, "u", None), (2, None, ""), (2, None, ""), (None, "v", "<article><p>text of a page.</p></article>"),
            (3, "w", "<article>" + "<p>many words of one long page.</p>" * 3000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id bigint, text string, html string")
    got = page_text.extract(pages, model, ["page_id"]).collect()
    assert sorted((r.page_id or -1, r.n_chars) for r in got)[1:4] == [(1, 0), (2, 0), (2, 0)]
    assert next(r for r in got if r.page_id == 3).n_blocks == 3000
    assert page_text.extract(pages.filter("false"), model, ["page_id"]).count() == 0
    assert page_text.train(pages.filter("false")) is not None


@pytest.mark.parametrize("tag", ["svg", "math", "object", "select", "noscript", "template", "canvas"])
def test_unclosed_hidden_elements_keep_the_rest(tag):
    found = page_text.blocks(f"<article><{tag} id=x><p>one</p><p>two</p></article>")
    # Objects and scripts' fallbacks are ordinary elements, closed or not.
    path = ["article", f"{tag} x", "p"] if tag in ("object", "noscript") else ["article", "p"]
    assert [(b.text, b.path.names()) for b in found] == [("one", path), ("two", path)]


@pytest.mark.parametrize("comment", ["<!-->", "<!--->", "<!---->", "<!-- x -->"])
def test_empty_comments_end(comment):
    assert [b.text for b in page_text.blocks(f"<p>a</p>{comment}<p>b</p><!-- c --><p>d</p>")] == ["a", "b", "d"]


def test_formulas_and_fallbacks_keep_their_text():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p><svg><text>Fig</text><path d='m'/><title>t</title></svg><noscript><p>plain</p></noscript><object><p>obj</p></object><canvas>cv</canvas></article>"
    assert [b.text for b in page_text.blocks(page)] == ["Let x=2 be.", "Fig", "plain", "obj", "cv"]


@pytest.mark.parametrize("part, count", [("<div>x", 40_000), ("<b>x", 40_000), ("<p><div><b>y", 20_000), ("</i>x", 40_000)])
def test_deep_pages_take_linear_memory(part, count):
    tracemalloc.start()
    page_text.vectors([page_text.blocks(part * count)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6

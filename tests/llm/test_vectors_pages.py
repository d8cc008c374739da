"""Vector search and page extraction against brute force."""

import numpy as np
import pytest

import roomtrail.llm.queries  # noqa: F401
from roomtrail.llm import ann, htmltree
from roomtrail.llm.registry import OPERATIONS


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    x[50:150] = x[7]  # many copies of one vector
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    bad = [(500, None, 1), (501, [0.0] * 8, 1), (502, [1.0, None] + [0.0] * 6, 1), (503, [float("nan")] * 8, 1), (504, [float("inf")] + [0.0] * 7, 1), (520, [1.0] * 3, 1), (None, [1.0] * 8, 1)]
    return x, spark.createDataFrame(rows + rows[:5] + bad, "vec_id long, embedding array<float>, label int")


def test_search_with_everything_visited_is_exact(spark, vectors):
    x, rows = vectors
    got: dict = {}
    for r in ann.search(rows, query_every=20, k=20, centroids=4, target=1.0, entry_block=64, query_block=8, sample_rows=400).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        score = x.astype(float) @ x[q].astype(float)
        want = sorted((-round(s, 9), i) for i, s in enumerate(score) if i != q)[:20]
        found = [(-round(s, 9), i) for _, i, s in sorted(found)]
        hits += len(set(want) & set(found))
        assert found == sorted(found) and len(found) == 20
    assert hits >= 0.95 * 20 * len(got)


def test_search_recall_at_production_parameters(spark):
    found = OPERATIONS["op5_inverted_multi_index"][0](spark, "/root/testdata/sf0.01").collect()
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], dtype=float), np.array([r.vec_id for r in rows])
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        want = {i for _, i in sorted((-s, i) for s, i in zip(score, ids, strict=True) if i != ids[q])[:20]}
        hits += len(want & {r.vec_id for r in found if r.query_id == ids[q]})
        total += len(want)
    assert hits >= 0.9 * total


def test_few_and_no_candidates(spark, vectors):
    _, rows = vectors
    few = ann.search(rows.filter("vec_id in (0, 1, 20)"), 20).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(0, 1), (0, 2), (20, 1), (20, 2)]
    assert ann.search(rows.limit(0), 20).collect() == []
    assert ann.search(rows.filter("vec_id >= 500"), 20).filter("query_id <> 520").collect() == []


def test_traversal_is_by_summed_products():
    rng = np.random.default_rng(1)
    books = [rng.standard_normal((5, 3)), rng.standard_normal((7, 3))]
    q = rng.standard_normal(6)
    order = list(ann.traverse(q, books))
    sums = (books[0] @ q[:3])[:, None] + (books[1] @ q[3:])[None, :]
    assert sorted(order) == list(range(35))
    assert np.all(np.diff(sums.ravel()[order]) <= 1e-12)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="ad">Buy now</div><article><h1>Head &amp; more</h1><p><b>Bold start.<br><p>Second   paragraph
of it.</p><aside>Not this</aside><form><input value=x>Send</form><ul><li>one<li>two</ul></article><div class="comments"><p>Reader says</p></div><footer>&copy; x</footer></body></html>"""


def test_marginals_equal_enumeration():
    model = htmltree.fit([PAGE])
    nodes = htmltree.parse("<div><p>some text here</p><ul><li>x</li></ul></div>")
    n = len(nodes)
    unary = [max(-30.0, min(30.0, sum(model.unary.get(f, 0.0) for f in htmltree.features(x)))) if i else -2.0 for i, x in enumerate(nodes)]
    total, on = 0.0, np.zeros(n)
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        weight = np.exp(sum(u for u, b in zip(unary, y, strict=True) if b))
        for i in range(1, n):
            odds = model.pair.get(nodes[i].tag, model.pair["*"])[0 if y[nodes[i].parent] else 1]
            weight *= 1 / (1 + np.exp(-odds if y[i] else odds))
        total += weight
        on += weight * np.array(y)
    assert np.allclose(htmltree.marginals(nodes, model), on / total, atol=1e-6)


def test_main_text_of_odd_pages():
    model = htmltree.fit([PAGE])
    assert htmltree.main_text(PAGE, model) == "Head & more\nBold start.\nSecond paragraph of it.\none\ntwo"
    for empty in (None, "", "<", "<p", "text alone", "<script>x"):
        assert isinstance(htmltree.main_text(empty, model), str)
    assert "Reader" not in htmltree.main_text(PAGE.replace("article", "section"), model)


def test_deep_and_long_pages():
    model = htmltree.fit([PAGE])
    deep = "<article>" + "<div>" * 3000 + "<p>far down here</p>" + "</div>" * 3000 + "</article>"
    assert htmltree.main_text(deep, model) == "far down here"
    long = "<article>" + "<p>some words of a paragraph</p>" * 5000 + "</article>"
    assert htmltree.main_text(long, model).count("\n") == 4999


def test_extraction_query(spark, tmp_path):
    rows = [(1, "u1", PAGE, "kept"), (1, "u1", PAGE, "kept"), (2, None, None, None), (None, "u3", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = OPERATIONS["op10_html_extraction"][0](spark, str(tmp_path)).collect()
    assert sorted((r.page_id or 0, r.url, r.n_chars > 0) for r in got if r.url) == [(0, "u3", False), (1, "u1", True), (1, "u1", True)]
    assert all(len(r.text) == r.n_chars for r in got) and len(got) == 4
    assert htmltree.extract(pages.limit(0), htmltree.fit([])).collect() == []

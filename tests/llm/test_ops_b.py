import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import brute

from loomcut.llm import embed_dedup, html_extract

SF2 = "/root/testdata/sf0.01"


def vectors_brute(rows, least=0.9):
    good = {i: np.array(e, float) for i, (_, e) in enumerate(rows) if e and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    links = [(i, j) for i in good for j in good if i < j and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= least]
    root = brute.roots(range(len(rows)), links)
    least_id = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least_id[root[i]] = min(v, least_id.get(root[i], v))
    return sorted(((v, sum(i in p for p in links), least_id.get(root[i]), v == least_id.get(root[i])) for i, (v, _) in enumerate(rows)), key=repr)


def test_vectors_brute(spark):
    df = spark.read.parquet(f"{SF2}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    want = vectors_brute(rows)
    for block in (8192, 60):
        assert sorted((tuple(r) for r in embed_dedup.link_vectors(df, block_rows=block).collect()), key=repr) == want


def test_vectors_clusters_and_edges(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(8):
        centre = rng.normal(size=8)
        rows += [(len(rows) + i, (centre + rng.normal(size=8) * rng.choice([0.02, 0.3])).tolist()) for i in range(30)]
    rows += [(900, None), (901, [0.0] * 8), (902, [1.0, None] + [0.0] * 6), (903, [float("nan")] * 8), (904, [float("inf")] + [0.0] * 7), (905, []), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (907, [2.0, 4.0]), (3, rows[3][1]), (None, rows[3][1]), (908, [1e200] * 8), (909, [1e-200] * 8)]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<double>, node long").repartition(3)
    safe = [(i, [x / max(map(abs, e)) for x in e] if i in (908, 909) else e) for i, e in rows]
    for block in (8192, 25):
        got = sorted((tuple(r) for r in embed_dedup.link_vectors(df, block_rows=block).collect()), key=repr)
        assert got == vectors_brute(safe)
    assert embed_dedup.link_vectors(df.limit(0)).count() == 0


def test_vectors_many_clusters(spark):
    """Vectors of tight clusters meet their own cluster alone, once there are pivots for all of them."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 24))
    rows = [(i, (centres[i % 60] + rng.normal(size=24) * 0.08).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted((tuple(r) for r in embed_dedup.link_vectors(df, block_rows=100).collect()), key=repr)
    assert got == vectors_brute(rows)
    x = np.array([e for _, e in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = embed_dedup.choose_pivots(x, 15, np.arccos(0.9), 1000)
    assert len(pivots) >= 60
    angle = embed_dedup._angles(x, pivots)
    cell = angle.argmin(1)
    radius = np.array([angle[cell == c, c].max() for c in range(len(pivots))])
    assert (angle <= radius + np.arccos(0.9)).sum(1).mean() < 6
    flat = rng.normal(size=(1500, 128))  # no directions in common: more pivots would leave no less to compare
    assert len(embed_dedup.choose_pivots(flat / np.linalg.norm(flat, axis=1, keepdims=True), 15, np.arccos(0.9), 1000)) == 15


def test_pages(spark):
    from loomcut.llm import queries
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF2}/pages.parquet").collect()}
    got = queries.op2_html_extraction(spark, SF2).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


PAGE = """<html><head><title>T</title><style>x{}</style></head><body class="has-sidebar"><header class="site-header"><a href=/>Home</a> Slogan of the site, which is long enough</header>
<nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><div class="cookie-notice"><p>We use cookies, as all do, and ask you to agree to them, please, now.</p></div>
<div id="wrap" class="layout with-sidebar"><div class="post-content"><h1>Head &amp; line</h1><p>First paragraph, with some words, and a <a href=x>link</a> in it, which goes on for a while, so it counts.</p>
<div class="ad-box">Buy now, all of you, the best of goods for little money!</div><p>Second&nbsp;one &lt;b&gt;,
 which also <b>goes</b><i>on</i> a bit, as prose does, until it ends.<ul><li>Item one, short<li>Item two</ul><script>var a = "</p>";</script>
<blockquote>A quotation, too, is text.</blockquote><form><label>Mail</label><input></form></div>
<div class="sidebar"><p>Popular: other stories, many of them, with commas, and more commas, here, too.</p></div>
<section id="comments"><p>I think, as a reader, that this is wrong, and will say so at length, here and now.</p></section></div><footer><p>Imprint, terms, privacy, and so on, for all who care to read of it.</p></footer></body></html>"""


def test_page_parts():
    assert html_extract.main_text(PAGE) == "\n\n".join(["Head & line", "First paragraph, with some words, and a link in it, which goes on for a while, so it counts.", "Second one <b>, which also goeson a bit, as prose does, until it ends.", "Item one, short", "Item two", "A quotation, too, is text."])


def test_page_edges(spark):
    assert html_extract.main_text("<p>one<p>two") == "one\n\ntwo"
    assert html_extract.main_text("plain text") == "plain text"
    assert html_extract.main_text("<article><p>a</p></article><!-- <p>no") == "a"
    assert html_extract.main_text("<article>x < y &amp; <b>z</article>") == "x < y & z"
    deep = "<div>" * 3000 + "<p>deep text here" + "</div>" * 3000
    assert html_extract.main_text(deep) == "deep text here"
    df = spark.createDataFrame([(1, None, 5, "u"), (2, "", 5, "u"), (3, "<script>x</script>", 5, "u"), (4, "<p>é" + "a" * 200000, 5, "u")], "page_id long, html string, n_chars int, url string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(df).collect()}
    assert got == {1: ("", 0), 2: ("", 0), 3: ("", 0), 4: ("é" + "a" * 200000, 200001)}
    assert html_extract.extract(df.limit(0)).count() == 0

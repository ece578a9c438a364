import pytest

from loomcut.llm.html_extract import main_text

LONG = "A sentence of the article, with commas, which is long enough to count as prose, as all know."


@pytest.mark.parametrize("part", ['<section id="discussion"><h2>Part</h2><p>{}</p></section>', '<h2 id="related-work">Part</h2><p>{}</p>', '<h2 id="search">Part</h2><p id="login">{}</p>', '<h2>Part</h2><p class="disclaimer">{}</p>'])
def test_ambiguous_words_within_the_article(part):
    page = f"<article><h1>T</h1><p>{LONG}</p>{part.format('Own, ' + LONG)}</article>"
    assert main_text(page) == f"T\n\n{LONG}\n\nPart\n\nOwn, {LONG}"


@pytest.mark.parametrize("part", ['<div id="share">Share this</div>', '<section id="related"><a href="a">Other page</a> <a href="b">And one</a></section>', f'<p class="ad">{LONG}</p>', f'<div class="comments"><p>{LONG}</p></div>', f'<div id="sidebar"><p>{LONG}</p></div>', f'<aside id="notice">{LONG}</aside>'])
def test_second_sign_cuts(part):
    assert main_text(f"<article><h1>T</h1><p>{LONG}</p>{part}</article>") == f"T\n\n{LONG}"


@pytest.mark.parametrize("tag", ["svg", "canvas", "object", "select", "button", "audio", "video", "template"])
def test_embedded_elements_cut_no_more_than_themselves(tag):
    want = f"{LONG}\n\nlost? {LONG}"
    assert main_text(f'<article><p>{LONG}</p><{tag} class="i"/><p>lost? {LONG}</p></article>') == want
    assert main_text(f'<article><p>{LONG}<{tag} class="i"></p><p>lost? {LONG}</p></article>') == want
    assert main_text(f"<article><p>{LONG}</p><{tag}><p>lost? {LONG}</p></article>") == want
    assert main_text(f"<article><p>{LONG}</p><{tag}>Press here</{tag}><p>lost? {LONG}</p></article>") == want


def test_formulas_stay():
    assert main_text(f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x = 1</annotation></math> holds.</p></article>") == f"{LONG} x=1 holds."


@pytest.mark.parametrize("name", ["story share-enabled", "discussion", "notice", "widget", "alert main"])
def test_a_word_alone_does_not_cut_all_prose(name):
    want = f"{LONG}\n\nSecond. {LONG}"
    assert main_text(f'<body><div class="nav"><a href="a">Home</a></div><div class="{name}"><p>{LONG}</p><p>Second. {LONG}</p></div></body>') == want


def test_long_comments_are_not_the_article():
    assert main_text(f'<div class="post"><p>{LONG}</p></div><section id="comments">{f"<p>{LONG * 3}</p>" * 20}</section>') == LONG


@pytest.mark.parametrize("depth", [10, 505, 20000])
def test_any_depth(depth):
    assert main_text("<div>" * depth + f"<nav>Home About Contact menu</nav><p>{LONG}</p>") == LONG


def test_fallback_of_an_object():
    assert main_text(f"<p>{LONG} <object data=x>fallback</object> rest.</p>") == f"{LONG} rest."


HOSTILE = ['<a "', '<a x="', "<a x='", "<!", "<?x", "<!--", "<div>", "<b><hr>", "<ul><b><li>", "<div class=ad>", "<script>", "<", "&", "<a =", "</section>", "<div></section>", "<table><b><td>", "<p><button><b>"]


@pytest.mark.parametrize("part", HOSTILE)
def test_time_grows_with_length(part):
    import time

    took = []
    for size in (200_000, 800_000):
        page = part * (size // len(part)) + f"<p>{LONG}</p>"
        start = time.process_time()
        main_text(page)
        took.append(time.process_time() - start)
    assert took[1] < 9 * took[0] + 0.5  # four times the length; with its square it would be sixteen


def built(r):
    """(a page put together from parts, its article's text)."""
    words = "the of a house tree runs, sees light, night, over and under river stone again".split()
    prose = lambda a, b: " ".join(r.choice(words) for _ in range(r.randrange(a, b))).capitalize() + "."
    blocks, inner = [], []
    for _ in range(r.randrange(3, 9)):
        kind, x = r.choice(["p", "p", "p", "h2", "blockquote", "ul", "link"]), prose(15, 60)
        if kind == "ul":
            items = [prose(4, 12) for _ in range(r.randrange(2, 5))]
            inner.append("<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>")
            blocks += items
        elif kind == "link":
            inner.append(f'<p class="x{r.randrange(9)}">{x} <a href="/a">more</a> {x}')
            blocks.append(f"{x} more {x}")
        else:
            inner.append(f"<{kind}>{x.replace(' ', r.choice([' ', '  ', chr(10)]))}</{kind}>")
            blocks.append(x)
    links = "".join(f'<li><a href="/{i}">{prose(1, 4)}</a></li>' for i in range(r.randrange(3, 12)))
    noise = [f"<nav><ul>{links}</ul></nav>", f"<div class='sidebar'><ul>{links}</ul><p>{prose(10, 30)}</p></div>", f"<footer><p>{prose(8, 30)}</p></footer>", f"<div id=comments><p>{prose(20, 60)}</p></div>", f"<form><label>{prose(3, 6)}</label><input></form>", "<script>if (a < b) { x('<p>no</p>') }</script>", f"<div class='cookie-banner'>{prose(8, 20)}</div>", f"<aside>{prose(10, 40)}</aside>", f"<!-- {prose(5, 9)} -->", f"<div class=ad><p>{prose(10, 20)}</p></div>"]
    own = r.choice(["<article>{}</article>", '<div class="post-content">{}</div>', "<main>{}</main>", '<div id="content"><div>{}</div></div>', '<section role="main">{}</section>'])
    inside = [x for x in noise if r.random() < 0.15]
    for x in inside:
        inner.insert(r.randrange(len(inner) + 1), x)
    around = [x for x in noise if r.random() < 0.6]
    cut = r.randrange(len(around) + 1)
    return "<html><head><title>t</title></head><body>" + "".join(around[:cut]) + own.format("".join(inner)) + "".join(around[cut:]) + "</body></html>", "\n\n".join(blocks)


def test_built_pages():
    import random

    r = random.Random(11)
    for _ in range(400):
        page, want = built(r)
        assert main_text(page) == want

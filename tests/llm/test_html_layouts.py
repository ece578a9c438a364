"""Pages that aren't built around one article element, against what they are known to hold and against a plain second scorer."""

import itertools
import random
from html.parser import HTMLParser

import pytest

from loomcut.llm.html_extract import main_text

LONG = "A sentence of the article, with commas, which is long enough to count as prose, as all know."
CHROME = '<div class="nav"><a href="/">Home</a> <a href="/a">About us</a></div>', '<div class="footer">All about this site, its owners, and so on, in many words.</div>'


def page(content):
    return f"<html><body>{CHROME[0]}{content}{CHROME[1]}</body></html>"


def test_short_sections_stay():
    inner = f"<section><p>{LONG}</p><p>Two. {LONG}</p><p>Three. {LONG}</p></section><section><h2>End</h2><p>Short closing words.</p></section>"
    assert main_text(page(f"<div>{inner}</div>")) == f"{LONG}\n\nTwo. {LONG}\n\nThree. {LONG}\n\nEnd\n\nShort closing words."


@pytest.mark.parametrize("part, text", [("<ul><li>one</li><li>two</li></ul>", "one\n\ntwo"), ("<table><tr><td>a</td><td>b</td></tr></table>", "a\n\nb"), ("<pre>x = 1</pre>", "x = 1"), ("<blockquote>short words</blockquote>", "short words"), ("<dl><dt>t</dt><dd>d</dd></dl>", "t\n\nd")])
def test_lists_tables_and_code_beside_the_container_stay(part, text):
    body = f"<p>{LONG}</p><p>Two. {LONG}</p>"
    assert main_text(page(f'<div><div class="content">{body}</div>{part}</div>')) == f"{LONG}\n\nTwo. {LONG}\n\n{text}"
    assert main_text(page(f'<div>{part}<div class="content">{body}</div></div>')) == f"{text}\n\n{LONG}\n\nTwo. {LONG}"


def test_lists_of_links_beside_the_container_go():
    links = "<ul><li><a href=a>Other page</a></li><li><a href=b>And one</a></li></ul>"
    assert main_text(page(f"<div><div><p>{LONG}</p></div>{links}</div>")) == LONG


@pytest.mark.parametrize("name", ["newsletter no-print", "sidebar has-widgets", "related without-border", "sidebar with-ads", "ad no-mobile"])
def test_names_that_tell_of_a_layout_save_nothing(name):
    box = f'<div class="{name}"><p>{LONG}</p></div>'
    assert main_text(f"<article><p>First. {LONG}</p>{box}</article>") == f"First. {LONG}"
    assert main_text(page(f'<div class="post"><p>First. {LONG}</p></div>{box}')) == f"First. {LONG}"


@pytest.mark.parametrize("name", ["with-sidebar", "has-sidebar content", "no-sidebar", "layout-sidebar-right", "without-comments post"])
def test_names_that_tell_of_a_layout_cut_nothing(name):
    assert main_text(page(f'<div class="{name}"><p>{LONG}</p><p>Two. {LONG}</p></div>')) == f"{LONG}\n\nTwo. {LONG}"


class _Plain(HTMLParser):
    """Blocks of a well-formed page, each with the path of elements around it and how much of it is links."""

    BLOCKS = {"p", "h1", "h2", "h3", "li", "pre", "td", "blockquote", "div", "section"}

    def __init__(self, markup):
        super().__init__()
        self.path, self.number, self.blocks, self.words, self.links = [], itertools.count(), [], [], 0
        self.feed(markup)
        self.flush()

    def flush(self):
        text = " ".join("".join(self.words).split())
        if text:
            self.blocks.append(([(i, t, c) for i, t, c in self.path], text, self.links / len(text)))
        self.words, self.links = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.flush()
        self.path.append((next(self.number), tag, dict(attrs).get("class") or ""))

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.flush()
        self.path.pop()

    def handle_data(self, data):
        self.words.append(data)
        if any(t == "a" for _, t, _ in self.path):
            self.links += len(data)


def outcome(markup):
    """The lowest division that holds all prose outside boxes named as none, and all its blocks outside such boxes that aren't mostly links."""
    bad = {"nav", "footer", "sidebar", "ad", "comments"}
    blocks = [(path, text) for path, text, links in _Plain(markup).blocks if links < 0.5 and not any(c in bad for _, _, c in path)]
    size = sum(len(text) for _, text in blocks if len(text) >= 60)
    held, depths = {}, {}
    for path, text in blocks:
        for depth, (i, _, _) in [x for x in enumerate(path) if x[1][1] in ("div", "body")]:
            held[i] = held.get(i, 0) + (len(text) if len(text) >= 60 else 0)
            depths[i] = depth
    chosen = max((i for i in held if held[i] == size), key=lambda i: depths[i])
    return "\n\n".join(text for path, text in blocks if any(i == chosen for i, _, _ in path))


@pytest.mark.parametrize("seed", range(40))
def test_against_a_plain_scorer(seed):
    draw, number = random.Random(seed), itertools.count(1)
    prose = lambda: f"<p>Number {next(number)}. {LONG * draw.randint(1, 4)}</p>"
    small = lambda: draw.choice(["<ul><li>one, two</li><li>three</li></ul>", "<pre>a = b</pre>", "<blockquote>words of others</blockquote>", "<h2>A heading</h2><p>A short one.</p>"])
    box = lambda: draw.choice([f'<div class="sidebar"><p>{LONG}</p></div>', '<div class="ad">Buy this now</div>', f'<div class="comments"><p>I say: {LONG}</p></div>'])
    part = lambda: prose() + "".join(draw.choice([prose, small, prose])() for _ in range(draw.randint(1, 5)))
    wrap = draw.choice(["<div>{}</div>", '<div class="wrap"><div class="text">{}</div></div>', "<div><section>{}</section></div>", "<section><div>{}</div></section>"])
    sections = draw.randint(0, 3)
    inner = "".join(f"<section>{part()}</section>" for _ in range(sections)) if sections else part()
    markup = page(draw.choice([box, str])() + wrap.format(inner) + draw.choice([box, str])())
    assert main_text(markup) == outcome(markup)

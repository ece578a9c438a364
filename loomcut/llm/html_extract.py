"""Main text of web pages by tree scoring.

The page's markup is read into a tree of elements. Parts that are never an article's text are cut out by their tag, role, class or id.
Each block of text then passes points for its length and its commas to its parent, half of them to the grandparent and less to
those above; a container's points are discounted by its link density. The best container is kept, with those of its
siblings that have a good share of its points, are paragraphs of prose, or lists, tables, quotes and sections that aren't mostly links.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where markup begins: a comment, a declaration, a processing instruction, a tag.
_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
#: A tag's rest. Quotes count after an equals sign only.
_REST = re.compile(r"(?:[^>=]|=(?!\s*[\"'])|=\s*\"[^\"]*\"|=\s*'[^']*')*+>")
_RAW = frozenset("script style noscript textarea title iframe noframes xmp".split())
_ATTR = re.compile(r"\b(class|id|role|style|hidden|aria-hidden|type)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul head".split())
_CUT_TAGS = frozenset("nav aside footer form fieldset menu dialog head input label".split())
#: Cut where they have an end tag; without one they end with their parents, and what lies between is not theirs.
_EMBEDDED = frozenset("svg canvas object select button audio video template annotation annotation-xml".split())
_CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status".split())
#: Words in a class or id that mark what is not an article's text.
_CUT_WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices notification notifications alert alerts "
    "popup modal overlay newsletter subscribe subscription signup login sidebar sidebars aside rail widget widgets related recommended recommendations recirc share sharing social breadcrumb breadcrumbs menu menus nav navbar navigation "
    "topbar toolbar footer foot masthead pagination pager comment comments commentlist disqus respond reply replies discussion skip search rss disclaimer paywall outbrain taboola hidden".split()
)
#: Those of them that an article's own parts may have as an id, and those that they may have as a class.
_AMBIGUOUS = frozenset("discussion related search notice notices notification notifications alert alerts share sharing disclaimer widget widgets login navigation comment comments respond reply replies subscription promotion skip foot menu menus social consent cookie cookies banner banners overlay sponsor sponsors".split())
#: As an id of a section or division these mark what readers say.
_READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
_MILD = frozenset("discussion notice notices alert alerts disclaimer".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Headers are cut unless they are an article's own.
_HEADER_WORDS = frozenset("header head".split())
#: A name such as "with-sidebar" says what lies inside or is missing, not what the element is.
_LAYOUT_WORDS = frozenset("with has no without".split())
#: Parts of a text that need no container of their own beside its main one, if they are no lists of links.
_FLOW = frozenset("ul ol dl table pre blockquote figure section".split())
_OWN_WORDS = frozenset("article entry post story content main page title".split())
_CONTENT_WORDS = frozenset("article body content entry hentry main story text post prose".split())
#: An element of these ends an open one of the given tags within the nearest of the last.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "option": (frozenset(["option"]), frozenset(["select"])),
}
_ENDS_P = _BLOCK - frozenset("html body head option optgroup td th tr tbody thead tfoot caption legend summary".split())
_SCOPE = frozenset("article aside body div section td th table main header footer nav form li blockquote figure html button".split())

#: The groups of _CLOSES: which elements end one another, and within what.
_GROUPS = sorted({x for x in _CLOSES.values()}, key=lambda x: sorted(x[0]))
_GROUP_OF = {tag: _GROUPS.index(x) for tag, x in _CLOSES.items()}


class Node:
    __slots__ = ("tag", "words", "attrs", "parent", "children", "score", "up", "length", "linked", "commas", "all", "all_linked", "prose", "cut", "soft", "whole")

    def __init__(self, tag: str, parent: Node | None, attrs: dict[str, str]):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.words = _parts(f"{attrs.get('class', '')} {attrs.get('id', '')}") if attrs else frozenset()
        self.children: list[Node | str] = []
        self.score = self.up = 0.0
        self.length = self.linked = self.commas = self.all = self.all_linked = self.prose = 0
        self.cut = self.soft = self.whole = False


def _parts(names: str) -> frozenset[str]:
    """Words of the names in a class or id, but for names that tell of a layout."""
    out = set()
    for name in names.split():
        words = [w.lower() for w in _PART.findall(name)]
        if not (len(words) > 1 and words[0] in _LAYOUT_WORDS or "layout" in words):
            out.update(words)
    return frozenset(out)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(text, '', ''), (start or end, tag, what follows the name in it) and (raw, tag, '') of a page, in one pass.

    A page whose quotes never close is read on as if quotes meant nothing.
    """
    at = last = 0
    quoted, final = True, page.rfind(">")
    while m := _OPEN.search(page, at):
        begin, kind = m.start(), m[0]
        if kind == "<!--":
            end = page.find("-->", m.end())
            end = len(page) if end < 0 else end + 3
        elif begin > final:
            break
        elif m[2] and quoted:
            rest = _REST.match(page, m.end())
            quoted = bool(rest)
            end = rest.end() if rest else page.find(">", m.end()) + 1
        else:
            end = page.find(">", m.end()) + 1
        if begin > last:
            yield "text", page[last:begin], ""
        at = last = end
        if not m[2]:
            continue
        tag = m[2].lower()
        if not m[1] and tag in _RAW:
            close = _CLOSE_RAW[tag].search(page, at)
            at = last = close.end() if close else len(page)
            yield "raw", tag, ""
        else:
            yield "end" if m[1] else "start", tag, page[m.end() : end - 1]
    if last < len(page):
        yield "text", page[last:], ""


_CLOSE_RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}


class _Tree:
    """The open elements of a page that is being read; each step costs no more than what it closes."""

    def __init__(self):
        self.root = Node("html", None, {})
        self.open = [self.root]
        self.many: dict[str, int] = {}  # open elements of each tag
        self.scopes: list[dict[str, int]] = [{}]  # the same within each scope
        self.first: list[list[Node | None]] = [[None] for _ in _GROUPS]  # within each list or table the outermost open part

    def push(self, node: Node) -> None:
        tag = node.tag
        self.open.append(node)
        self.many[tag] = self.many.get(tag, 0) + 1
        if tag in _SCOPE:
            self.scopes.append({})
        self.scopes[-1][tag] = self.scopes[-1].get(tag, 0) + 1
        for g, (which, within) in enumerate(_GROUPS):
            if tag in which and self.first[g][-1] is None:
                self.first[g][-1] = node
            if tag in within:
                self.first[g].append(None)

    def pop(self) -> Node:
        node = self.open.pop()
        tag = node.tag
        self.many[tag] -= 1
        if tag in _SCOPE:
            self.scopes.pop()
        else:
            self.scopes[-1][tag] -= 1
        for g, (which, within) in enumerate(_GROUPS):
            if tag in within:
                self.first[g].pop()
            if self.first[g][-1] is node:
                self.first[g][-1] = None
        return node

    def end(self, tag: str, anywhere: bool) -> None:
        """Closes the innermost open element of a tag; within its scope, unless it may be anywhere."""
        if self.many.get(tag) if anywhere else self.scopes[-1].get(tag):
            while (node := self.pop()).tag != tag:
                pass
            node.whole = True

    def start(self, tag: str, rest: str) -> None:
        attrs = {a.lower(): (v or "").strip("\"'") or a for a, v in _ATTR.findall(rest)} if rest else {}
        if tag == "html":
            self.root.attrs = self.root.attrs or attrs
            return
        if tag in _ENDS_P and self.scopes[-1].get("p"):
            while self.pop().tag != "p":
                pass
        if tag in _GROUP_OF and (part := self.first[_GROUP_OF[tag]][-1]):
            while self.pop() is not part:
                pass
        if tag == "body":
            while len(self.open) > 1:
                self.pop()
        at = self.open[-1]
        if tag in _EMBEDDED:
            at.children.append(" ")
        node = Node(tag, at, attrs)
        at.children.append(node)
        if tag not in _VOID and not rest.endswith("/"):
            self.push(node)


def parse(page: str) -> Node:
    """The tree of a page; end tags that open nothing are ignored, open elements end with their parents."""
    tree = _Tree()
    for kind, what, rest in tokens(page):
        if kind == "text":
            tree.open[-1].children.append(html.unescape(what))
        elif kind == "raw":
            tree.open[-1].children.append(" ")
        elif kind == "start":
            tree.start(what, rest)
        elif what not in _VOID:
            tree.end(what, what in _BLOCK)
    return tree.root


def _walk(root: Node):
    """(node, whether it ends) in page order, text as (str, parent)."""
    stack: list = [(root, False)]
    while stack:
        node, ends = stack.pop()
        yield node, ends
        if not ends and isinstance(node, Node) and not node.cut:
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.children))


def _weigh(root: Node) -> None:
    """How long the text of each element is, cut or not, and how much of it is in links; prose: what stands in blocks that are long and mostly no links."""
    for n in [n for n, ends in _walk(root) if isinstance(n, Node) and ends]:  # children come before their parents
        own = linked = 0
        for c in n.children:
            if isinstance(c, str):
                size = len(" ".join(c.split()))
                n.all, own = n.all + size, own + size
            else:
                n.all, n.all_linked, n.prose = n.all + c.all, n.all_linked + c.all_linked, n.prose + c.prose
                if c.tag not in _BLOCK:
                    own, linked = own + c.all, linked + c.all_linked
        if n.tag == "a":
            n.all_linked = n.all
        if n.tag in _BLOCK and n.tag not in _HEADINGS and own >= 40 and linked < 0.5 * own:
            n.prose += own


def _second_sign(n: Node) -> bool:
    """Whether more than an ambiguous word says that an element within an article is not its text: a widget's class, links, or little prose."""
    text = n.tag in _HEADINGS or n.tag in ("p", "section")
    if _parts(n.attrs.get("class", "")) & (_CUT_WORDS - _MILD) or not text and _parts(n.attrs.get("id", "")) & (_CUT_WORDS - _AMBIGUOUS):
        return True
    if n.tag not in _HEADINGS and n.tag != "p" and n.words & _READERS:
        return True
    return n.all_linked > 0.5 * n.all or n.all - n.all_linked < (1 if text else 80)


def _is_worded(n: Node) -> bool:
    """Whether a word in the class or id says that the element is not an article's text. One in a longer name, as in "share-enabled", says less than a name such as "story"."""
    if not n.words & _CUT_WORDS:
        return False
    names = {x.lower() for x in f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".split()}
    return not names & _CONTENT_WORDS or bool(names & _CUT_WORDS)


def _mark_cuts(root: Node) -> None:
    """Cuts what is never an article's text; an element around the page's article or main part is left whatever its class."""
    nodes = [n for n, ends in _walk(root) if isinstance(n, Node) and not ends]
    holds = set()
    for n in nodes:
        if n.tag in ("article", "main") or n.attrs.get("role") in ("main", "article"):
            up = n
            while up and id(up) not in holds:
                holds.add(id(up))
                up = up.parent
    within: dict[int, bool] = {}
    article: dict[int, bool] = {}
    for n in nodes:
        inside = bool(n.parent) and within.get(id(n.parent), False)
        own = n.tag in ("article", "main") or n.attrs.get("role") in ("main", "article")
        within[id(n)] = inside or own
        # A main part around an article holds other things too.
        article[id(n)] = bool(n.parent) and article.get(id(n.parent), False) or own and (n.tag == "article" or not any(id(c) in holds for c in n.children))
        style = n.attrs.get("style", "").replace(" ", "").lower()
        if "display:none" in style or "visibility:hidden" in style or "hidden" in n.attrs or n.attrs.get("aria-hidden", "").lower() == "true":
            n.cut = n.tag not in ("html", "body")
            continue
        if n.tag in ("html", "body"):
            continue
        worded = _is_worded(n)
        if worded and article[id(n)] and not own:
            worded = _second_sign(n)
        bad = n.tag in _EMBEDDED and n.whole or n.attrs.get("role", "").lower() in _CUT_ROLES or n.tag in _CUT_TAGS
        header = n.tag == "header" or bool(n.words & _HEADER_WORDS)
        if own:  # a comment may be an article too
            n.cut = bool(n.words & {"comment", "comments", "ad", "ads", "advert", "sponsored", "promo", "related"})
        elif id(n) not in holds:
            n.cut = worded or bad or (header and not inside and not n.words & _OWN_WORDS)
            n.soft = n.cut and not bad


def _undo_cuts(root: Node) -> None:
    """Where the words of classes and ids cut all prose of a page, the cut that holds the most of it is undone, and what was cut within it is weighed again."""
    while True:
        left, soft = 0, []
        for n, ends in _walk(root):
            if isinstance(n, Node) and not ends:
                if n.cut:
                    soft += [n] * (n.soft and n.prose > 0)
                elif n.tag in _BLOCK and n.tag not in _HEADINGS:
                    left += n.prose - sum(c.prose for c in n.children if isinstance(c, Node))
        if left or not soft:
            return
        most = max(soft, key=lambda n: n.prose)  # ties: the first in page order
        while most:
            most.cut &= not most.soft
            most = next((c for c in most.children if isinstance(c, Node) and c.prose == most.prose and (c.soft or not c.cut)), None)


def _measure(root: Node) -> None:
    """Lengths, link text and commas of all elements, and the points that blocks pass upwards: all to the container, of what an element got itself or was passed half to the one above it."""
    order = [n for n, ends in _walk(root) if isinstance(n, Node) and ends]
    for n in order:  # children come before their parents
        direct = commas = linked = own = 0
        for c in n.children:
            if isinstance(c, str):
                size, marks = len(" ".join(c.split())), c.count(",") + c.count("，") + c.count("、")
                direct, own, commas, n.commas = direct + size, own + size, commas + marks, n.commas + marks
            elif not c.cut:
                n.length += c.length
                n.linked += c.linked
                n.commas += c.commas
                if c.tag not in _BLOCK:
                    direct += c.length
                    commas += c.commas
                    linked += c.linked
        n.length += own
        if n.tag == "a":
            n.linked = n.length
        if n.tag in _BLOCK and direct:
            points = (min(direct / 100, 3) + (commas + 1 if direct >= 25 else 0)) * (1 - min(1.0, linked / direct))
            to = n.parent if n.tag in ("p", "pre", "li", "td", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt") and n.parent else n
            to.up += points
        n.score = n.up
        if n.parent and not n.cut:
            n.parent.up += n.up / 2


def _best(root: Node) -> list[Node]:
    """The best container, with the siblings to keep, in page order."""
    def rank(n: Node) -> float:
        score = n.score + (0.01 if n.length else 0)
        if n.tag in ("article", "main") or n.attrs.get("role") in ("main", "article"):
            score = (score + 1) * 3
        elif n.words & _CONTENT_WORDS:
            score *= 1.25
        return score * (1 - n.linked / n.length if n.length else 0)

    nodes = [n for n, ends in _walk(root) if isinstance(n, Node) and not ends and not n.cut and n.tag in _BLOCK and n.length]
    if not nodes:
        return []
    best = max(nodes, key=rank)  # ties: the first in page order
    # While one block holds nearly all, its list or cell is no container of its own.
    while best.tag in ("li", "tr", "td", "th", "p", "tbody", "dd", "dt", "h1", "h2", "h3") and best.parent:
        best = best.parent
    if best.parent is None or best.tag == "body":
        return [best]
    limit, out = max(1.0, 0.2 * rank(best)), []
    for c in best.parent.children:
        if isinstance(c, str) or c.cut:
            continue
        prose = c.tag == "p" and c.length >= 80 and c.linked < 0.25 * c.length
        alike = c.tag == best.tag and rank(c) >= limit or c.tag in _FLOW and c.length and c.linked < 0.5 * c.length
        title = c.tag in ("h1", "h2") and c.length
        if c is best or prose or alike or (title and not any(isinstance(x, Node) and x.tag == "h1" for x in best.children)):
            out.append(c)
    return out


def main_text(page: str | None) -> str:
    """The page's main text: blocks in page order joined by two line feeds, white space within a block as one space; '' where there is none."""
    if not page:
        return ""
    root = parse(page)
    _weigh(root)
    _mark_cuts(root)
    _undo_cuts(root)
    _measure(root)
    kept = _best(root)
    blocks, now = [], []

    def flush() -> None:
        text = " ".join("".join(now).split())
        if text:
            blocks.append(text)
        now.clear()

    for top in kept:
        for n, _ in _walk(top):
            if isinstance(n, str):
                now.append(n)
            elif n.tag in _BLOCK:
                flush()
            elif n.tag == "br":
                now.append(" ")
        flush()
    return "\n\n".join(blocks)


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """pages with text string and n_chars long (code points) instead of the html column.

    A null or empty page and one without an article's text give ''. Whole pages are read, in time that grows with their length; nothing is dropped by length or
    depth. Columns named text or n_chars are replaced, others are passed through. Repeated rows are read each; an empty table gives no rows.
    """
    base = pages.select(*[c for c in pages.columns if c.lower() not in ("text", "n_chars") or c == source])
    at, names = base.columns.index(source), [c for c in base.columns if c != source]
    fields = ", ".join([*(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in names), "text string", "n_chars long"])

    def read(batches):
        for batch in batches:
            column = batch.column(at)
            for a in range(0, batch.num_rows, 64):
                texts = [main_text(x) for x in column.slice(a, 64).to_pylist()]
                rest = [batch.column(i).slice(a, 64) for i in range(batch.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return base.mapInArrow(read, fields)

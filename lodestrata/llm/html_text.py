"""Main text of web pages by composite text density.

A page is read into a tree; parts that their tag names as boilerplate are cut, and so are small
parts that a role, class or form names so: a part that holds an article, a main element or most of
the page's text is only weighed down by its name, and where nothing is left names cut nothing.
Every node of every page gets its composite density: characters per tag, weighed by how few of
the characters and tags are links. The subtree whose children's densities sum highest is the
content; on the way to it from the body, sibling subtrees at least as dense as the thinnest node
of that way, and headings and paragraphs beside it, belong to the content too. Marks of the page
are a prior: an article around the densest subtree is kept whole, a main element around it is
where the way starts, and other articles belong to the content unless links are most of their text.

Defined results: a null, empty or textless page gives an empty text; unclosed and misnested tags
are closed as browsers do for paragraphs, list items and table cells; a page without a body is
searched as a whole; repeated rows are read one by one; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.llm.common import columns

# Element names by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CUT = frozenset(
    "annotation annotation-xml applet audio aside button canvas datalist dialog embed fieldset footer frame frameset head iframe "
    "input label legend map menu meter nav noframes noscript object optgroup option output progress script select style svg template "
    "textarea title video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rb rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr math menclose mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms "
    "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADINGS | frozenset("p blockquote pre ul ol dl table figure".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
# A start tag closes open elements of these names that stand above the nearest limit.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies copyright disqus footer gdpr header hidden legal login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification overlay pager pagination popup promo promoted promotion recommended related reply replies "
    "respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# How far a part is trusted that was not cut for its name: one named outright, one with a longer name, a form.
OUTRIGHT, PARTLY, FORM = 0.1, 0.5, 1.0
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
# A class or id word that is of readers' comments: it begins so, as "has-comments" or "no-comments" do not.
_THREAD = re.compile(r"(?:^|\s)(?:comment|disqus|replies|respond)")


class _Tree(HTMLParser):
    """Nodes in page order as parallel lists; text chunks with their node and block number.

    Open elements are found by tag and never searched for, so broken and deep pages take linear time.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.cut = ["#page"], [-1], [False]
        # Whether a name, role or form calls a node boilerplate, how far it is trusted then, and whether its name is of readers' comments.
        self.named, self.trust, self.thread = [False], [1.0], [False]
        self.chunks: list[tuple[int, int, str]] = []
        self.open, self.block = [0], 0
        # Depths of the open elements: of each tag, and of those that are not inline.
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.endless: set[str] = set()  # comments and sections that have no end from here on

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.block += 1
            self._close_before(tag)
        node, parent = len(self.tags), self.open[-1]
        self.tags.append(tag)
        self.parents.append(parent)
        self.cut.append(self.cut[parent] or self._is_cut(tag, attrs))
        trust = None if self.cut[node] else self._trust(tag, attrs)
        self.named.append(trust is not None)
        self.trust.append(1.0 if trust is None else trust)
        self.thread.append(tag not in ("html", "body", "main") and any(
            key in ("class", "id") and value and _THREAD.search(value.lower()) for key, value in attrs))
        if tag == "br":
            self.chunks.append((node, self.block, " "))
        if tag not in VOID:
            self.depths.setdefault(tag, []).append(len(self.open))
            if tag not in INLINE:
                self.blocks.append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math", "path") and self.tags[self.open[-1]] == tag:
            self._close_from(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.block += 1
        depth = self._depth(tag)
        # An inline element, paragraph or list item does not end outside the table, article or main it is in.
        if depth and not (tag in INLINE | {"p", "li"} and max(map(self._depth, ("table", "article", "main"))) > depth):
            self._close_from(depth)

    def handle_data(self, data):
        if not self.cut[self.open[-1]]:
            self.chunks.append((self.open[-1], self.block, data))

    def read(self, html):
        """The whole page. What follows its last ``>`` holds no whole tag, so it is text."""
        end = html.rfind(">") + 1
        self.feed(html[:end])
        self.close()
        if html[end:] and not self.cdata_elem:
            self.handle_data(unescape(html[end:]))

    def parse_comment(self, i, report=True):
        # After a comment without an end no other has one; the parser would look for it each time.
        if "comment" in self.endless:
            return -1
        k = super().parse_comment(i, report)
        if k < 0:
            self.endless.add("comment")
        return k

    def parse_marked_section(self, i, report=1):
        kind = self.rawdata[i:i + 5]
        k = -1 if kind in self.endless else super().parse_marked_section(i, report)
        if k < 0:
            self.endless.add(kind)
        return k

    def _depth(self, tag):
        """Of the innermost open element of that tag; 0 if there is none."""
        at = self.depths.get(tag)
        return at[-1] if at else 0

    def _close_from(self, depth):
        for node in reversed(self.open[depth:]):
            self.depths[self.tags[node]].pop()
            if self.tags[node] not in INLINE:
                self.blocks.pop()
        del self.open[depth:]

    def _close_before(self, tag):
        if self.tags[self.open[-1]] == "head" and (tag == "body" or tag not in IN_HEAD):
            self._close_from(len(self.open) - 1)
        elif tag in CLOSES:
            names, limits = CLOSES[tag]
            depth = max(map(self._depth, names))
            if depth > max(map(self._depth, limits)):
                self._close_from(depth)
        # Any other block ends a paragraph that only inline elements are open in.
        elif self.blocks and self.tags[self.open[self.blocks[-1]]] == ("head" if tag == "body" else "p"):
            self._close_from(self.blocks[-1])

    def _in_article(self):
        return self._depth("article") > 0 or self._depth("main") > 0

    def _is_cut(self, tag, attrs):
        """Parts that no content is in: by tag, or not shown."""
        if tag in CUT:
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        # The header of an article holds its title; that of a page does not.
        if tag == "header":
            return not self._in_article()
        return any(key == "hidden" or (key == "style" and value and re.search(r"display\s*:\s*none", value)) for key, value in attrs)

    def _trust(self, tag, attrs):
        """None for a part that nothing names as boilerplate."""
        if tag in ("html", "body", "article", "main", "header"):
            return None
        found = [FORM] if tag == "form" else []
        for key, value in attrs:
            if (key == "aria-hidden" and value == "true") or (key == "role" and value in ROLES):
                found.append(OUTRIGHT if key == "role" else PARTLY)
            if key in ("class", "id") and value and tag not in HEADINGS:
                names = set(_TOKEN.findall(_CAMEL.sub(" ", value).lower())) & NAMES
                if names - {"header"} or (names and not self._in_article()):
                    found.append(OUTRIGHT if set(value.lower().split()) & names else PARTLY)
        return min(found, default=None)


def _ancestors(tree: _Tree, node: int) -> Iterator[int]:
    """The node and all that hold it, up to the page."""
    while node >= 0:
        yield node
        node = tree.parents[node]


def _under(tree: _Tree, roots) -> list[bool]:
    held = [False] * len(tree.tags)
    for n in range(len(held)):
        held[n] = n in roots or (n > 0 and held[tree.parents[n]])
    return held


def _apart(tree: _Tree) -> bool:
    """Whether an article or main element has text outside all that is named as readers' comments."""
    size = len(tree.tags)
    inside, held = list(tree.thread), [0] * size
    for n in range(1, size):
        inside[n] |= inside[tree.parents[n]]
    for node, _, text in tree.chunks:
        if not inside[node]:
            held[node] += len(text.strip())
    for n in range(size - 1, 0, -1):
        if held[n] and tree.tags[n] in ("article", "main"):
            return True
        held[tree.parents[n]] += held[n]
    return False


def _weigh(tree: _Tree, names_cut: bool) -> tuple[list[bool], list[float]]:
    """Which nodes are cut, and the weight of each: that of the least trusted name around it.

    A name or form cuts a subtree, but not one that holds an article, a main element or most of the
    page's text; such a subtree is only weighed down. Readers' comments are cut whatever they hold, be
    it a thread of articles, if an article or main element has text outside of them.
    """
    size = len(tree.tags)
    held, marked = [0] * size, [False] * size
    for node, _, text in tree.chunks:
        held[node] += len(text.strip())
    for n in range(size - 1, 0, -1):
        p = tree.parents[n]
        held[p] += held[n]
        marked[p] |= marked[n] or (held[n] > 0 and tree.tags[n] in ("article", "main"))
    cut, weight = list(tree.cut), list(tree.trust)
    threads = names_cut and _apart(tree)
    for n in range(1, size):
        p = tree.parents[n]
        cut[n] = cut[n] or (threads and tree.thread[n])
        named = tree.named[n] and names_cut and not marked[n] and 2 * held[n] <= held[0]
        cut[n] = cut[n] or cut[p] or named
        weight[n] = min(weight[n], weight[p])
    return cut, weight


def _densities(tree: _Tree, top: int, cut: list[bool], weight: list[float]) -> tuple[list[float], list[float], list[bool]]:
    """Composite density of each node, the sum of its children's, and whether it has text of which links are at most half.

    ``top`` stands for the body.
    """
    size = len(tree.tags)
    chars, link_chars, tags, link_tags = [0] * size, [0] * size, [0] * size, [0] * size
    for node, _, text in tree.chunks:
        if not cut[node]:
            chars[node] += len(text) - text.count(" ")
    linked = [False] * size
    for n in range(1, size):
        linked[n] = linked[tree.parents[n]] or tree.tags[n] == "a"
        if linked[n]:
            link_chars[n] = chars[n]
    for n in range(size - 1, 0, -1):
        p = tree.parents[n]
        if not cut[n]:
            chars[p] += chars[n]
            link_chars[p] += link_chars[n]
            tags[p] += tags[n] + 1
            link_tags[p] += link_tags[n] + (tree.tags[n] == "a")
    share = link_chars[top] / max(1, chars[top])
    density, sums = [0.0] * size, [0.0] * size
    for n in range(size - 1, -1, -1):
        if chars[n] and not cut[n]:
            base = math.log(chars[n] / max(1, chars[n] - link_chars[n]) * link_chars[n] + share * chars[n] + math.e)
            odds = chars[n] / max(1, link_chars[n]) * max(1, tags[n]) / max(1, link_tags[n])
            density[n] = weight[n] * chars[n] / max(1, tags[n]) * math.log(max(odds, 1.0)) / math.log(max(base, 1.5))
            if tree.parents[n] >= 0:
                sums[tree.parents[n]] += density[n]
    return density, sums, [0 < chars[n] >= 2 * link_chars[n] and not cut[n] for n in range(size)]


def _content(tree: _Tree, names_cut: bool) -> list[bool]:
    """For each node, whether its own text is content."""
    size = len(tree.tags)
    top = next((n for n in range(size) if tree.tags[n] == "body"), 0)
    cut, weight = _weigh(tree, names_cut)
    density, sums, prose = _densities(tree, top, cut, weight)
    inside = _under(tree, {top})
    best = max((n for n in range(size) if inside[n] and not cut[n]), key=lambda n: (sums[n], -n), default=top)
    if sums[best] == 0:
        return [inside[n] and not cut[n] for n in range(size)]
    # Marks are a prior: an article around the best node is one unit, and a main around it starts the way.
    body = top
    for n in _ancestors(tree, best):
        if tree.tags[n] == "article":
            best = n
        elif tree.tags[n] == "main":
            top = n
    way = list(_ancestors(tree, best))
    way = way[:way.index(top) + 1] if top in way else way[:1]
    threshold, on_way = min(density[n] for n in way), set(way)
    inside = _under(tree, {top})
    chosen, in_article = {best}, [False] * size
    for n in range(1, size):
        parent = tree.parents[n]
        in_article[n] = in_article[parent] or tree.tags[parent] == "article"
        if cut[n] or not inside[n] or not (density[n] or prose[n]) or n in on_way:
            continue
        beside = parent in on_way and parent != best and (
            density[n] >= threshold > 0 or tree.tags[n] in HEADINGS or (parent != body and tree.tags[n] in TEXTUAL))
        # Every article is a candidate; one under a boilerplate name has to reach the threshold.
        if beside or (tree.tags[n] == "article" and not in_article[n] and prose[n] and (weight[n] == 1 or density[n] >= threshold)):
            chosen.add(n)
    kept = [False] * size
    for n in range(size):
        held = n in chosen or (n > 0 and kept[tree.parents[n]])
        # A named part below the content that was too large to cut stays if it is dense enough as weighed.
        thin = names_cut and tree.named[n] and weight[n] < 1 and density[n] < threshold and n not in on_way
        kept[n] = held and not cut[n] and not thin
    # Bare text of a main beside its content.
    for n in on_way - {best, body}:
        kept[n] = kept[n] or tree.tags[top] == "main"
    return kept


def main_text(html: str | None) -> str:
    """The main text, one line per block."""
    if not html:
        return ""
    tree = _Tree()
    tree.read(html)
    return _text(tree, _content(tree, True)) or _text(tree, _content(tree, False))


def _text(tree: _Tree, kept: list[bool]) -> str:
    blocks: dict[int, list[str]] = {}
    for node, block, text in tree.chunks:
        if kept[node]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and its code points; map-only."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return columns(pages, "page_id", "url", "html").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars bigint")

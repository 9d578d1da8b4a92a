"""Density by its definition on random trees, broken and deep pages, and threads of readers' comments."""

import math
import random
import time
from html.parser import HTMLParser

import pytest

from lodestrata.llm import html_text

STORY = "Some words of a running text that goes on for a while and tells a story. "


def random_page(rng, depth=0):
    made = ""
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.35 or depth > 5:
            made += " ".join(rng.choice(["word", "text", "more", "x"]) for _ in range(rng.randint(1, 12))) + " "
        elif kind < 0.5:
            made += f"<a href=x>{rng.choice(['link', 'a longer link text'])}</a>"
        else:
            tag = rng.choice(["div", "section", "span", "em", "blockquote"])
            made += f"<{tag}>{random_page(rng, depth + 1)}</{tag}>"
    return made


class Nested(HTMLParser):
    """The page as nested lists: [tag, children]; strings are text."""

    def __init__(self):
        super().__init__()
        self.path = [["#page", []]]

    def handle_starttag(self, tag, attrs):
        node = [tag, []]
        self.path[-1][1].append(node)
        self.path.append(node)

    def handle_endtag(self, tag):
        self.path.pop()

    def handle_data(self, data):
        self.path[-1][1].append(data)


def measures(node, linked=False):
    """(characters, link characters, tags, link tags) of a subtree, counted down to its leaves."""
    tag, children = node
    linked |= tag == "a"
    total = [0, 0, 0, 0]
    for child in children:
        if isinstance(child, str):
            n = len(child) - child.count(" ")
            part = [n, n if linked else 0, 0, 0]
        else:
            part = measures(child, linked)
            part = [part[0], part[1], part[2] + 1, part[3] + (child[0] == "a")]
        total = [x + y for x, y in zip(total, part)]
    return total


def density(node, body, linked):
    """The composite density as it is defined: characters per tag, times the log of the text-to-link odds to a base that grows with links."""
    c, lc, t, lt = measures(node, linked)
    if not c:
        return 0.0
    base = math.log(c / max(1, c - lc) * lc + body[1] / max(1, body[0]) * c + math.e)
    odds = max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))
    return c / max(1, t) * math.log(odds) / math.log(max(base, 1.5))


@pytest.mark.parametrize("seed", range(60))
def test_densities_of_random_trees(seed):
    page = f"<body>{random_page(random.Random(seed))}</body>"
    tree, nested = html_text._Tree(), Nested()
    tree.read(page)
    nested.feed(page)
    root = nested.path[0]
    body = root[1][0]
    order = []

    def walk(node, linked=False):
        order.append((node, linked or node[0] == "a"))
        for child in node[1]:
            if not isinstance(child, str):
                walk(child, linked or node[0] == "a")

    walk(root)
    cut, weight = html_text._weigh(tree, True)
    got, sums, prose = html_text._densities(tree, 1, cut, weight)
    assert tree.tags == [n[0] for n, _ in order] and not any(cut)
    whole = measures(body)
    for k, (node, linked) in enumerate(order):
        assert got[k] == pytest.approx(density(node, whole, linked))
        assert sums[k] == pytest.approx(sum(density(c, whole, linked or c[0] == "a") for c in node[1] if not isinstance(c, str)))
        c, lc, *_ = measures(node, linked)
        assert prose[k] == (c > 0 and c >= 2 * lc)
    # The subtree of the greatest sum is always content.
    best = max(range(1, len(order)), key=lambda k: (sums[k], -k))
    assert html_text._content(tree, True)[best]


N = 100_000


@pytest.mark.parametrize("page", [
    "<div>" * N + "x" + "</b>" * N, "<b><table>" + "<div>" * N + "x" + "</b>" * N, "<b>" * N + "<hr>" * N, "<div>" * N + "<dd></dd>" * N,
    "<div>" * N + "<header>x</header>" * N, "<div>" * N + "<i class=header>y</i>" * N, "<!--" * N, "x<!-- >" * N, "<![CDATA[" * N, "<![CDATA[ >" * N,
    "<?" * N, "</" * N, "<a " * N, "<a b='>" * N, "<ul><li>" * N, "&#" * N,
])
def test_broken_pages_take_linear_time(page):
    started = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - started < 15  # hours where a search is made for each tag


def test_threads_of_comments():
    story, comment = f"<h1>T</h1><p>{STORY}</p>", "<p>I read it all and think the same of it, thank you for writing.</p>"
    want = ["T", STORY.strip()]
    for thread in (
        '<div id="comments">' + f'<article class="comment">{comment}</article>' * 10 + "</div>",
        '<section class="comment-list">' + f"<article>{comment}</article>" * 6 + "</section>",
        f'<article class="comment">{comment}</article>' * 5,
        f'<div class="Disqus thread"><div>{comment * 9}</div></div>',
    ):
        assert html_text.main_text(f"<body><article>{story}</article>{thread}</body>").split("\n") == want
        assert html_text.main_text(f"<body><main><article>{story}</article>{thread}</main></body>").split("\n") == want
        assert html_text.main_text(f"<body class='has-comments'><div class='no-comments'><article>{story}</article>{thread}</div></body>").split("\n") == want
    # A page of comments and nothing else is about them.
    assert comment[3:20] in html_text.main_text(f'<body><div id="comments">{comment * 4}</div></body>')

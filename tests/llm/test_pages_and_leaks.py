"""Main text of pages and benchmark leaks."""

import html
import random
import re

from lodestrata.llm import decontaminate, html_text

PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><div id="header"><a href=/>Home</a> Site</div>
<div id=menu><ul><li><a href=1>One<li><a href=2>Two</ul></div><div class="content"><h1>The title</h1>
<div><p>First paragraph with a fair amount of text in it, and a <a href=x>link</a>, which goes on &amp; on.
<p>Second one &eacute;t&#233; is here with many more words so that it is dense enough for the count.</div>
<div><p>Third section is another text of words in its own div that should be kept, as it is dense.</p><p>More</p></div></div>
<div class=comments><p>Nice post! I really love it and would like to say it in many words here, a long comment of a reader.</p></div>
<form><p>subscribe</p></form><script>var a="<p>x</p>";</script><footer>foot</footer></body></html>"""


def test_article_pages(spark, folder):
    rows = {r.page_id: r for r in html_text.extract(spark.read.parquet(f"{folder}/pages.parquet")).collect()}
    for page in spark.read.parquet(f"{folder}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", page.html, re.S).group(1)
        parts = re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:p|h1)>", "\x00", inside)).split("\x00")
        want = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert rows[page.page_id].text == want and rows[page.page_id].n_chars == len(want)


def test_density_without_article():
    assert html_text.main_text(PAGE).split("\n") == [
        "The title", "First paragraph with a fair amount of text in it, and a link, which goes on & on.",
        "Second one été is here with many more words so that it is dense enough for the count.",
        "Third section is another text of words in its own div that should be kept, as it is dense.", "More"]


def test_density_formula_prefers_text_to_links():
    page = "<body><div>" + "<a href=x>some link text</a> " * 40 + "</div><div><p>" + "plain words of a text " * 10 + "</p><p>" + "more words " * 20 + "</p></div></body>"
    assert html_text.main_text(page).startswith("plain words") and "link" not in html_text.main_text(page)


STORY = "Some words of a running text that goes on for a while and tells a story. "


def test_pages_by_density(spark, folder):
    def page(body):
        return html_text.main_text("<body><nav>menu</nav>" + body + "<footer>foot</footer></body>").split("\n")

    a, b = (STORY * 5).strip(), (STORY * 2).strip()
    # Several articles: each is content, also the shorter one.
    assert page(f"<article><h1>A</h1><p>{a}</p><p>{b}</p></article><article><h1>B</h1><p>{b}</p></article>") == ["A", a, b, "B", b]
    # An article that is only a teaser of links is no content, the dense text beside it is.
    teaser = "<article><h3><a href=x>Teaser of another story</a></h3><p>Short. <a href=x>Read more of it here</a></p></article>"
    assert page(f"{teaser}<div><p>{a}</p><p>{b}</p></div>") == [a, b]
    # Title and intro in main beside the article.
    assert page(f"<main>Bare<h1>T</h1><p>Intro words.</p><article><p>{a}</p><p>{b}</p></article></main>") == ["Bare", "T", "Intro words.", a, b]
    # Without its mark the content of every given page is found by density alone.
    for row in spark.read.parquet(f"{folder}/pages.parquet").collect():
        plain = row.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert html_text.main_text(plain) == html_text.main_text(row.html)


def test_names_do_not_cut_content():
    for name in ("layout sidebar-right", "no-sidebar", "has-nav", "cookie-accepted", "legal-news"):
        for inner in ("<article>{}</article>", "{}"):
            body = inner.format(f"<h1>T</h1><p>{STORY}</p><p>{STORY}</p>")
            page = f"<body><div class='{name}'>{body}<div class=sidebar>links of a sidebar</div></div></body>"
            assert html_text.main_text(page).split("\n") == ["T", STORY.strip(), STORY.strip()]
    assert html_text.main_text(f"<body><form><div><p>{STORY}</p><p>{STORY}</p><input></div></form></body>") == f"{STORY}\n{STORY.strip()}".replace(" \n", "\n")
    assert html_text.main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold here.</p></article>") == "Let x=2 hold here."
    # Nothing but named parts: names cut nothing.
    assert html_text.main_text("<div class=menu>one text</div><div class=popup>two texts</div><div class=share>three</div>") != ""
    # A large part under a boilerplate name weighs little.
    comments = "<div class=comments>" + "<p>I like this so much. I do.</p>" * 20 + "</div>"
    assert html_text.main_text(f"<body><div><p>{STORY}</p><p>{STORY}</p></div>{comments}</body>").split("\n") == [STORY.strip()] * 2


def test_page_edges(spark):
    pages = [(1, None, None), (2, "u", ""), (3, "u", "<p>a<p>b<div>c<br>d</div>"), (4, "u", "<div>" * 5000 + "deep" + "</div>" * 5000),
             (5, "u", "words " * 100_000), (6, "u", "<script>x"), (6, "u", "<script>x"), (None, None, "<nav>menu</nav><p>t &lt;b&gt;</p>")]
    made = html_text.extract(spark.createDataFrame([(*p, 1) for p in pages], "page_id bigint, url string, html string, text int"))
    got = [(r.page_id, r.text, r.n_chars) for r in made.collect()]
    assert got[:4] == [(1, "", 0), (2, "", 0), (3, "a\nb\nc d", 7), (4, "deep", 4)]
    assert got[4][2] == 599_999 and got[5:] == [(6, "", 0), (6, "", 0), (None, "t <b>", 5)]
    assert html_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def distance(item, text):
    row = [0] * (len(text) + 1)
    for k, w in enumerate(item, 1):
        new = [k]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_against_brute_force(spark, folder):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    items = {r.item_id: decontaminate.words_of(r.text) for r in bench.collect()}
    rnd, rows = random.Random(7), []
    vocabulary = sorted({w for ws in items.values() for w in ws})
    for k in range(240):
        words = list(items[k % len(items)])
        for _ in range(int(len(words) * rnd.choice([0, 0, 0.05, 0.1, 0.2, 0.3]))):
            p = rnd.randrange(len(words))
            kind = rnd.random()
            if kind < 0.4:
                words[p] = rnd.choice(vocabulary)
            elif kind < 0.7 and len(words) > 1:
                del words[p]
            else:
                words.insert(p, rnd.choice(vocabulary))
        around = [rnd.choice(vocabulary) for _ in range(40)]
        rows.append((k, " ".join(around[:20] + words + around[20:])))
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    want = {}
    for k, text in rows:
        for i, item in items.items():
            d = distance(item, text.split()) if i == k % len(items) or len(item) < 20 else len(item)
            if d <= int(len(item) * 0.2 + 1e-9):
                want[k, i] = d
    assert {x: got[x] for x in got if x in want} == {x: want[x] for x in got if x in want}
    assert len(set(got) - set(want)) == 0 and len(set(want) & set(got)) >= 0.98 * len(want)


def test_leaks_of_short_items_at_their_limit(spark):
    rnd, items, rows = random.Random(5), [], []
    for size in (6, 9, 10, 11, 12, 13, 14, 15, 19, 20, 25):
        for _ in range(60):
            k, words = len(items), [f"w{rnd.randrange(3000)}" for _ in range(size)]
            items.append((k, " ".join(words)))
            for p in sorted(rnd.sample(range(size), size // 5), reverse=True):
                kind = rnd.random()
                words[p:p + 1] = ["new"] if kind < 0.5 else [] if kind < 0.75 else ["new", words[p]]
            rows.append((k, " ".join(["before"] * 5 + words + ["after"] * 5)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect() if r.doc_id == r.item_id}
    short = {k for k, text in items if len(text.split()) < decontaminate.WALKED}
    assert short <= got and len(got) >= 0.995 * len(items)
    assert decontaminate.repeats_for(0.999) > decontaminate.repeats_for(0.9) >= 1


def test_leak_edges(spark):
    bench = spark.createDataFrame(
        [(1, "alpha beta gamma delta"), (2, None), (3, ""), (4, "One, two! three four five six seven eight nine ten eleven twelve.")], "item_id bigint, text string")
    docs = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (3, "x ALPHA, Beta gamma-delta y", 0), (4, "one two three four five six\nseven eight nine ten eleven twelve", 0),
         (4, "one two three four five six\nseven eight nine ten eleven twelve", 0), (None, "two three four five six seven eight nine ten eleven twelve", 0),
         (6, "alpha beta delta gamma", 0), (7, "alpha " * 100_000, 0)], "doc_id bigint, text string, item_id int")
    got = sorted(((r.doc_id or 0), r.item_id, r.distance) for r in decontaminate.leaks(docs, bench).collect())
    assert got == [(0, 4, 1), (3, 1, 0), (4, 4, 0), (4, 4, 0)]
    clean = decontaminate.without_leaks(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [1, 2, 6, 7]
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0
    # Blocks of a bounded number of words give the same result.
    assert sorted(((r.doc_id or 0), r.item_id, r.distance) for r in decontaminate.leaks(docs, bench, block_words=10).collect()) == got

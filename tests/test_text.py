import re

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import elements, text


def values(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


SAMPLES = ["", " ", "a", " a  b ", "\x1cx\x1f", " line ", "​zero", "a\tb\r\nc", "　", "\x85é "]


def test_strip_and_whitespace_match_python(spark):
    assert values(spark, SAMPLES, text.strip(F.col("v"))) == [s.strip() for s in SAMPLES]
    assert values(spark, SAMPLES, text.normalize_whitespace(F.col("v"))) == [" ".join(s.split()) for s in SAMPLES]
    assert values(spark, SAMPLES, text.is_blank(F.col("v"))) == [not s.strip() for s in SAMPLES]
    assert values(spark, SAMPLES, text.whitespace_tokens(F.col("v"))) == [s.split() for s in SAMPLES]


def test_doc_type(spark):
    paths = ["/a/b.TXT", "s3://x/y.tar.gz", "/a.d/file", "/a/.hidden", "/a/.env.md", "x.HTML", "end."]
    assert values(spark, paths, text.doc_type(F.col("v"))) == [".txt", ".gz", "", "", ".md", ".html", ""]


@pytest.mark.parametrize("raw", [b"ok", b"a\xc3b", b"\xff\xfe", "é�x".encode(), b"\xe2\x82A", b"\xf0\x9f\x92", "漢😀".encode()])
def test_decode_drops_invalid_bytes(spark, raw):
    assert values(spark, [bytearray(raw)], text.decode_ignore(F.col("v")), "binary") == [raw.decode("utf-8", "ignore")]


def test_record_id(spark):
    import hashlib

    got = values(spark, ["héllo"], text.record_id(F.col("v"), F.lit(3)))
    assert got == [hashlib.md5("héllo".encode()).hexdigest()[:16] + "-3"]
    with_source = values(spark, ["héllo"], text.record_id(F.col("v"), F.lit(3), F.lit("a")))
    assert with_source != got


def brute_elements(content):
    """Cut before and after each header line, then name the pieces."""
    at = [0]
    for header in re.finditer(r"^#{1,6}\s+.+$", content, re.M):
        at += header.span()
    pieces = (content[x:y].strip() for x, y in zip(at, [*at[1:], len(content)]))
    kinds = {"#": "title", "`": "code"}
    return [(kinds.get(p[0], "paragraph") if p[0] == "#" or p.startswith("```") else "paragraph", p) for p in pieces if p]


MARKDOWN = [
    "# Title\n\npara one\n\n## Two\ntext", "##\ntext", "####### seven", "#tag starts\n# Real", "```\ncode\n# inside\n```",
    "a\r\n# b\r\nc", "# nbsp", "#   ", "", "x # not header", "# sep", "\n\n# a\n# b\n", "para\n###### six\n#no",
]


def test_markdown_elements(spark):
    got = values(spark, MARKDOWN, elements.markdown_elements(F.col("v")))
    assert [[(e[0], e[1]) for e in r] for r in got] == [brute_elements(m) for m in MARKDOWN]


def test_generic_elements(spark):
    html = ('<html><head><title>T &amp; t</title><style>p{}</style><script>"</p>"</script></head><body><!-- x -->'
            "<h1>Head</h1><p>One <b>two</b></p><ul><li>item 1<li>item&nbsp;2</ul>tail &lt;3<br>end</body></html>")
    got = values(spark, [html, "plain one\nstill one\n\n two"], elements.generic_elements(F.col("v")))
    assert [tuple(e) for e in got[0]] == [
        ("Title", "T & t"), ("Title", "Head"), ("NarrativeText", "One two"), ("ListItem", "item 1"),
        ("ListItem", "item 2"), ("NarrativeText", "tail <3"), ("NarrativeText", "end")]
    assert [tuple(e) for e in got[1]] == [("NarrativeText", "plain one still one"), ("NarrativeText", "two")]


def test_dispatch_and_combine(spark):
    df = spark.createDataFrame([("# a\nb", ".md"), ("# a\n\nb", ".txt")], "c string, d string")
    made = elements.parse_elements(F.col("c"), F.col("d"))
    got = df.select(elements.combine_elements(made), made[0]["element_type"]).collect()
    assert [tuple(r) for r in got] == [("# a\n\nb", "title"), ("# a\n\nb", "NarrativeText")]

"""Elements of Markdown and of HTML or plain text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.text import SPACE, normalize_whitespace, strip

# Fixed value: a Markdown header line; only \n ends a line.
HEADER = rf"(?md)(^#{{1,6}}{SPACE}+.+$)"

# Tags that start a new block, and entities that are decoded.
BLOCK_TAGS = ("p|div|section|article|header|footer|nav|main|aside|ul|ol|table|tr|td|th|thead|tbody|blockquote|pre"
              "|form|figure|figcaption|dl|dt|dd|br|hr|html|body|head")
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]

_MARK = "\ufdd0"


def markdown_elements(content: Column) -> Column:
    """ARRAY<STRUCT<element_type, text>>: header lines cut the text; each part is stripped.

    A part is a title if it begins with ``#``, code if it begins with three backticks and a
    paragraph otherwise.
    """
    parts = F.split(F.regexp_replace(content, HEADER, f"{_MARK}$1{_MARK}"), _MARK, -1)
    kept = F.filter(F.transform(parts, strip), lambda p: p != "")
    return F.transform(kept, lambda p: F.struct(
        F.when(p.startswith("#"), "title").when(p.startswith("```"), "code").otherwise("paragraph")
        .alias("element_type"),
        p.alias("text"),
    ))


def generic_elements(content: Column) -> Column:
    """ARRAY<STRUCT<element_type, text>> of HTML or plain text.

    Scripts, styles and comments go; headings, list items and block tags start an element;
    blank lines cut plain text; other tags vanish; entities are decoded.
    """
    s = F.regexp_replace(content, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    s = F.regexp_replace(s, r"(?i)<(h[1-6]|title)\b[^>]*>", f"{_MARK}T")
    s = F.regexp_replace(s, r"(?i)<li\b[^>]*>", f"{_MARK}L")
    s = F.regexp_replace(s, rf"(?i)</(h[1-6]|title|li)>|</?({BLOCK_TAGS})\b[^>]*>|\n[ \t\r]*\n", f"{_MARK}N")
    s = F.regexp_replace(s, r"<[a-zA-Z/!][^>]*>", "")
    for entity, char in ENTITIES:
        s = F.replace(s, F.lit(entity), F.lit(char))
    parts = F.split(F.concat(F.lit("N"), s), _MARK, -1)
    made = F.transform(parts, lambda p: F.struct(
        F.when(p.startswith("T"), "Title").when(p.startswith("L"), "ListItem").otherwise("NarrativeText")
        .alias("element_type"),
        normalize_whitespace(F.substring(p, 2, 2147483647)).alias("text"),
    ))
    return F.filter(made, lambda e: e["text"] != "")


def parse_elements(content: Column, doc_type: Column) -> Column:
    """Markdown for ``.md`` and ``.markdown``, the generic parser for everything else."""
    return F.when(doc_type.isin(".md", ".markdown"), markdown_elements(content)).otherwise(generic_elements(content))


def combine_elements(elements: Column) -> Column:
    """Element texts joined by a blank line."""
    return F.array_join(F.transform(elements, lambda e: e["text"]), "\n\n")

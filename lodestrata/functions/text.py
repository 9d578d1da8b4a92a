"""Text helpers as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space in text (tab..CR, the four
# information separators, blank, NEL and every Unicode separator).
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"


def strip(text: Column) -> Column:
    """Cut white space from both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def normalize_whitespace(text: Column) -> Column:
    """One blank between words, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return text.isNull() | ~text.rlike(rf"[^\t-\r\x1c-\x20\x85\p{{Z}}]")


def whitespace_tokens(text: Column) -> Column:
    """The words between white space, empty ones dropped."""
    return F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != "")


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Sentences: cut at white space that follows a full stop, exclamation or question mark."""
    return F.filter(F.split(strip(text), rf"(?<=[.!?]){SPACE}+"), lambda s: s != "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def doc_type(path: Column) -> Column:
    """Lower-cased last suffix of the last path part, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)\z", 1))


def doc_id(source: Column) -> Column:
    return F.md5(source)


def record_id(text: Column, chunk_index: Column, source: Column | None = None) -> Column:
    """First 16 hex digits of the text's md5, a hyphen and the chunk index.

    The plain id leaves the source out, so equal text at an equal index in two documents
    gets one id; pass ``source`` to tell such chunks apart.
    """
    digest = F.md5(text) if source is None else F.md5(F.concat_ws("\u0001", source, text))
    return F.concat(F.substring(digest, 1, 16), F.lit("-"), chunk_index.cast("string"))


def decode_ignore(content: Column) -> Column:
    """Bytes to text, dropping what is not UTF-8.

    A U+FFFD that is really in the file survives: it is parked on a noncharacter while
    the invalid bytes, which decode to U+FFFD, are removed.
    """
    parked = F.replace(content.cast("string"), F.lit("\ufffd"), F.lit("\uffff"))
    cleaned = F.replace(F.make_valid_utf8(parked), F.lit("\ufffd"), F.lit(""))
    return F.replace(cleaned, F.lit("\uffff"), F.lit("\ufffd"))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable.

    Inside a fold an outer expression is computed again for each element; a bound
    variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)

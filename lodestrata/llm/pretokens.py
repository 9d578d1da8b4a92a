"""Pre-tokens of public tokenizer files, cut and numbered a batch at a time.

Arrow's kernels cut plain texts with the files' own patterns and number the distinct pieces, so
that each is encoded once per batch at most. Plain texts are of Latin characters on which the
kernels and the library agree; any other text, and any with the string of a special token, goes
through the library's own steps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from lodestrata.llm.common import per_process

# The splitting pattern that the byte-level file prescribes, and of the word file
# the parts that are not runs of letters.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MARKED = r"('s|'t|'re|'ve|'m|'ll|'d| ?\pN+| ?[^\s\pL\pN]+)"
_APART = r"('s|'t|'re|'ve|'m|'ll|'d|\pN|[^\s\pL\pN]+)"
_NOT_PLAIN = "[^\t\n\r -~¡-įı-ɏ]|<\\|"

_byte_cut = regex.compile(BYTE_PATTERN).findall


def tokenizer(path: str) -> Tokenizer:
    return per_process(("tokenizer", path), lambda: Tokenizer.from_file(path))


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary file of that name is, on any machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Cut:
    """Texts as numbers of pieces: ``numbers[ends[i]:ends[i + 1]]`` index ``pieces``; not plain texts have none."""

    numbers: np.ndarray
    ends: np.ndarray
    pieces: list[str]
    plain: np.ndarray


def slices(texts: pa.Array, limit: int = 4 << 20):
    """The texts in runs of about ``limit`` bytes, one text at least: (first row, texts)."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes) // limit
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(texts))):
        yield int(a), texts.slice(int(a), int(b - a))


def _plain(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    texts = pc.fill_null(texts, "")
    plain = pc.invert(pc.match_substring_regex(texts, _NOT_PLAIN))
    return pc.if_else(plain, texts, ""), plain.to_numpy(zero_copy_only=False)


def _numbered(lists: pa.ListArray, plain: np.ndarray) -> Cut:
    coded = lists.flatten().dictionary_encode()
    return Cut(coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py(), coded.dictionary.to_pylist(), plain)


def cut_words(texts: pa.Array) -> Cut:
    """Pre-tokens of the lower-casing word file; empty strings among them stand for nothing."""
    texts, plain = _plain(texts)
    return _numbered(pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), _APART, r" \1 ")), plain)


def cut_bytes(texts: pa.Array) -> Cut:
    """Pieces of texts for the byte-level file: a pre-token and the white space before it, if any.

    White space is cut apart by the pattern within a piece as it is in the text, see byte_tokens.
    """
    texts, plain = _plain(texts)
    marked = pc.replace_substring_regex(texts, _MARKED, "\x00\\1\x00")
    for space in " \n\r\t":
        marked = pc.replace_substring(marked, space, "\x00" + space)
    # White space stays with what follows it.
    marked = pc.replace_substring_regex(marked, "([ \n\r\t])\x00+", r"\1")
    return _numbered(pc.split_pattern(marked, "\x00"), plain)


def byte_tokens(piece: str) -> list[str]:
    """The pre-tokens of a plain text or piece for the byte-level file."""
    return _byte_cut(piece)


class Pieces(dict):
    """Pre-token -> its ids, encoded once; full, it keeps what it has, so memory is bounded."""

    def __init__(self, path: str, limit: int = 400_000):
        super().__init__()
        self.tokenizer, self.limit = tokenizer(path), limit

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = tuple(self.tokenizer.encode(token, add_special_tokens=False).ids) if token else ()
        if len(self) < self.limit:
            self[token] = ids
        return ids


def pieces(path: str) -> Pieces:
    return per_process(("pieces", path), lambda: Pieces(path))


def encode_words(texts: pa.Array, path: str) -> list[np.ndarray]:
    """The ids of each text under the word file."""
    cut = cut_words(texts)
    known = list(map(pieces(path).__getitem__, cut.pieces))
    sizes = np.fromiter(map(len, known), np.int64, len(known))
    flat = np.fromiter((x for ids in known for x in ids), np.uint32, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    each = sizes[cut.numbers]
    after = np.concatenate([[0], np.cumsum(each)])
    ids = flat[np.repeat(starts[cut.numbers] - after[:-1], each) + np.arange(after[-1])]
    bounds = after[cut.ends]
    made = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    for k in np.flatnonzero(~cut.plain):
        made[k] = np.array(tokenizer(path).encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
    return made

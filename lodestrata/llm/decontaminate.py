"""Benchmark decontamination: CGK walks, bit-sampling LSH, and word-level edit distance.

Texts and benchmark items are sequences of lower-cased words. A CGK walk reads a sequence with
random bits: it emits the word it stands on and moves on or stays, as the bit for this step and
word says; sequences a few edits apart then agree on most emitted words. Each repetition has its
own bits and keeps a sample of the emitted words as key. Walks start at every word of a text and
at every word of an item, its end padded with unknown words, so that a shared key aligns an
item-sized window of the text with the item at that offset. Windows are verified by the edit
distance of the item to the best matching stretch of words.

The benchmark is sent to the tasks in blocks of bounded size; each block passes over all texts.

Recall: items shorter than twice the steps of a walk are found without chance: cut in one more piece
than they may have edits, one piece stands in the text as it is, so shared pieces are their keys. An
item with walks is missed only if every repetition meets an edit from every start; the number of
repetitions is the least at which the shortest such item with all the edits it may have, placed at
their worst, is found with the target chance, as tried on a fixed sample of such items.

Defined results: a null or wordless text or item matches nothing; several matches of one item in one row
give the best, the first among equals; repeated rows and repeated items are all reported; an
empty table on either side gives no leaks; extra columns are ignored by ``leaks`` and kept by
``without_leaks``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestrata.llm.common import Shared, columns, empty_as

_WORDS = re.compile(r"[^\W_]+")
STEPS = 10
SAMPLED = 7
SIMILARITY = 0.8
# The chance to find an item of the least size with walks that has as many edits as it may, evenly spread.
RECALL = 0.999
WALKED = 2 * STEPS
_TRIALS, _MOST_REPEATS = 4000, 64
BLOCK_WORDS = 200_000
_CHUNK = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


@dataclass
class Walk:
    """One repetition: its random bits per (step, word) and the steps that it samples."""

    bits: np.ndarray
    sampled: np.ndarray

    @staticmethod
    def make(seed: int, words: int) -> Walk:
        rng = np.random.default_rng(seed)
        sampled = np.zeros(STEPS, bool)
        sampled[rng.choice(STEPS, SAMPLED, replace=False)] = True
        return Walk(rng.integers(0, 2, (STEPS, words + 1), dtype=np.int8), sampled)

    def keys(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and keys of the walks whose sampled words are all known (not 0)."""
        at, key = starts, np.zeros(len(starts), np.uint64)
        for step in range(STEPS):
            word = ids[at]
            if self.sampled[step]:
                known = np.flatnonzero(word)
                if len(known) < len(word):
                    starts, at, key, word = starts[known], at[known], key[known], word[known]
                key = _mix(key + word.astype(np.uint64))
            at = at + self.bits[step][word]
        return starts, key


class Item:
    """A benchmark item: its words as numbers, its edit limit, and bit masks of where each word stands."""

    def __init__(self, item_id, ids: np.ndarray, similarity: float):
        self.item_id, self.ids, self.size = item_id, ids, len(ids)
        self.limit = int(len(ids) * (1 - similarity) + 1e-9)
        self.masks: dict[int, int] = {}
        for k, word in enumerate(ids.tolist()):
            self.masks[word] = self.masks.get(word, 0) | 1 << k

    def best_stretch(self, words: list[int]) -> tuple[int, int]:
        """Least edit distance of the item to any stretch of the words, and where it first ends.

        Bit-parallel (Myers): the differences down a column of the distance table are two numbers.
        """
        everything, last = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, score = everything, 0, self.size
        best, end = score, 0
        for k, word in enumerate(words, 1):
            same = self.masks.get(word, 0)
            level = (((same & up) + up) ^ up) | same
            rises, falls = down | (everything & ~(level | up)), up & level
            score += bool(rises & last) - bool(falls & last)
            if score < best:
                best, end = score, k
            rises, falls = rises << 1 & everything, falls << 1 & everything
            steady = same | down
            up, down = falls | (everything & ~(steady | rises)), rises & steady
        return best, end

    def match(self, words: list[int]) -> tuple[int, int] | None:
        """(distance, end) within the limit, or None."""
        # Each word of the item that no edit touches stands somewhere among the words.
        if sum(map(self.masks.__contains__, words)) < self.size - self.limit:
            return None
        distance, end = self.best_stretch(words)
        return (distance, end) if distance <= self.limit else None


class Index:
    """A block of benchmark items: their words as numbers, and tables of key -> item and offset."""

    def __init__(self, items: list[tuple], similarity: float, repeats: int):
        self.number: dict[str, int] = {}
        self.items = []
        for item_id, text in items:
            found = words_of(text)
            if found:
                ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in found], np.int32)
                self.items.append(Item(item_id, ids, similarity))
        self.walks = [Walk.make(k, len(self.number) + 1) for k in range(repeats)]
        self.tables = [_table(((k, *_walks(walk, item)) for k, item in enumerate(self.items) if item.size >= WALKED)) for walk in self.walks]
        # Pieces of the shorter items by their number of words.
        short: dict[int, list] = {}
        for k, item in enumerate(self.items):
            if item.size < WALKED:
                words = item.size // (item.limit + 1)
                short.setdefault(words, []).append((k, *_runs(item.ids, np.arange(0, item.size - words + 1, words)[:item.limit + 1], words)))
        self.pieces = {words: _table(rows) for words, rows in sorted(short.items())}

    def candidates(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text position, start of the window aligned there, and item, for every shared key."""
        starts = np.flatnonzero(ids)
        places, begins, which = [[np.zeros(0, np.int64)] for _ in range(3)]
        walked = [(walk.keys, table) for walk, table in zip(self.walks, self.tables) if len(table[0])]
        cut = [(partial(_runs, words=words), table) for words, table in self.pieces.items()]
        for make, (keys, item, offset, maybe) in walked + cut:
            at, key = make(ids, starts)
            hit = maybe[_low_bits(key)]
            at, key = at[hit], key[hit]
            low = np.searchsorted(keys, key, "left")
            n = np.searchsorted(keys, key, "right") - low
            slot = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            at = np.repeat(at, n)
            places.append(at)
            begins.append(at - offset[slot])
            which.append(item[slot])
        return np.concatenate(places), np.concatenate(begins), np.concatenate(which)

    def best(self, ids: np.ndarray, windows) -> dict[int, tuple[int, int]]:
        """Item -> (distance, start) of its best window in one text, where that is within its limit.

        The windows are sorted; those of an item that overlap are searched as one.
        """
        found: dict[int, tuple[int, int]] = {}
        spans: list[list[int]] = []
        for k, begin in windows:
            item = self.items[k]
            low, high = max(0, begin - item.limit), begin + item.size + item.limit
            if spans and spans[-1][0] == k and low <= spans[-1][2]:
                spans[-1][2] = high
            else:
                spans.append([k, low, high])
        for k, low, high in spans:
            item = self.items[k]
            if k in found and found[k][0] == 0:
                continue
            match = item.match(ids[low:max(low, high)].tolist())
            if match:
                here = (match[0], max(0, low + match[1] - item.size))
                found[k] = min(found.get(k, here), here)
        return found


def _walks(walk: Walk, item: Item) -> tuple[np.ndarray, np.ndarray]:
    """Starts and keys of the walks from every word of an item, past its end unknown words."""
    return walk.keys(np.append(item.ids, np.zeros(STEPS + 1, np.int32)), np.arange(item.size))


def _runs(ids: np.ndarray, starts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and keys of the runs of so many words that are all known (not 0)."""
    key = np.zeros(len(starts), np.uint64)
    for step in range(words):
        word = ids[starts + step]
        known = np.flatnonzero(word)
        if len(known) < len(word):
            starts, key, word = starts[known], key[known], word[known]
        key = _mix(key + word.astype(np.uint64))
    return starts, key


def _table(rows):
    """Sorted keys with the item and offset of each, and a bit table that rules most keys out."""
    keys, which, offsets = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, places, key in rows:
        keys.append(key)
        which.append(np.full(len(key), k))
        offsets.append(places)
    keys, which, offsets = np.concatenate(keys), np.concatenate(which), np.concatenate(offsets)
    order = np.argsort(keys, kind="stable")
    maybe = np.zeros(1 << 20, bool)
    maybe[_low_bits(keys)] = True
    return keys[order], which[order], offsets[order], maybe


@cache
def repeats_for(recall: float = RECALL, similarity: float = SIMILARITY, size: int = WALKED) -> int:
    """The least number of repetitions that finds an item of this size with all the edits it may have with the given chance."""
    limit, missed = int(size * (1 - similarity) + 1e-9), np.ones(_TRIALS, bool)
    # Every trial has its own words, so that one walk meets all of them with independent bits.
    items = np.zeros((_TRIALS, size + STEPS + 1), np.int32)
    items[:, :size] = np.arange(1, _TRIALS * size + 1).reshape(_TRIALS, size)
    texts = items.copy()
    texts[:, (np.arange(limit) + 1) * size // (limit + 1)] = 0  # spread evenly, edits leave the shortest stretches
    starts = (np.arange(_TRIALS)[:, None] * items.shape[1] + np.arange(size)).ravel()
    for repeats in range(1, _MOST_REPEATS + 1):
        walk = Walk.make(repeats - 1, _TRIALS * size + 1)
        (at, key), (place, other) = walk.keys(items.ravel(), starts), walk.keys(texts.ravel(), starts)
        missed[np.intersect1d(at[np.isin(key, other)], place) // items.shape[1]] = False
        if missed.mean() <= 1 - recall:
            break
    return repeats


def _low_bits(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64((1 << 20) - 1)).astype(np.int64)


def _search(index: Index, texts: Iterator[str | None]) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, distance, start) of every leak; texts are searched many at a time."""
    number, gap = index.number.get, np.zeros(STEPS + 1, np.int32)

    def flush(held: list[tuple[int, np.ndarray]]):
        begins = np.cumsum([0] + [len(ids) + len(gap) for _, ids in held])
        at, start, which = index.candidates(np.concatenate([x for _, ids in held for x in (ids, gap)]))
        owner = np.searchsorted(begins, at, "right") - 1
        windows: dict[int, set] = {}
        for o, k, s in np.unique(np.stack([owner, which, start - begins[owner]], axis=1), axis=0).tolist():
            windows.setdefault(o, set()).add((k, s))
        for o, (row, ids) in enumerate(held):
            found = index.best(ids, sorted(windows.get(o, ())))
            for k, (distance, begin) in sorted(found.items()):
                yield row, k, distance, begin

    held, size = [], 0
    for row, text in enumerate(texts):
        found = words_of(text)
        held.append((row, np.fromiter((number(w, 0) for w in found), np.int32, len(found))))
        size += len(found)
        if size > _CHUNK:
            yield from flush(held)
            held, size = [], 0
    if held:
        yield from flush(held)


def _blocks(benchmark: DataFrame, similarity: float, repeats: int | None, block_words: int):
    """Broadcast indexes of the benchmark, each of about block_words words."""
    items = columns(benchmark, "item_id", "text")
    repeats = repeats_for(similarity=similarity) if repeats is None else repeats
    half = F.sum((F.length(empty_as(F.col("text"))) + 1) / 2)  # no text has more words than this
    blocks = max(1, int(-(-(items.agg(half).first()[0] or 0) // block_words)))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        index = Index([(r.item_id, r.text) for r in sorted(rows, key=lambda r: (str(r.item_id), r.text or ""))], similarity, repeats)
        yield Shared(benchmark.sparkSession, index)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, repeats: int | None = None,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, item_id, start_word, item_words, distance)`` for every item found in a text."""
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, "
              "start_word bigint, item_words bigint, distance bigint")

    def searcher(shared):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                hits = list(_search(index, (t.as_py() for t in batch.column("text"))))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array([h[0] for h in hits], pa.int64())),
                    pa.array([index.items[h[1]].item_id for h in hits], item_type),
                    *[pa.array(x, pa.int64()) for x in (
                        [h[3] for h in hits], [index.items[h[1]].size for h in hits], [h[2] for h in hits])],
                ], ["doc_id", "item_id", "start_word", "item_words", "distance"])
        return search

    made = None
    for shared in _blocks(benchmark, similarity, repeats, block_words):
        part = columns(docs, "doc_id", "text").mapInArrow(searcher(shared), schema)
        made = part if made is None else made.unionAll(part)
    return made


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, repeats: int | None = None,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows in whose text no item is found, with all their columns; no shuffle."""
    place = [f.name for f in docs.schema].index("text")

    def searcher(shared):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[list({h[0] for h in _search(index, (t.as_py() for t in batch.column(place)))})] = False
                yield batch.filter(pa.array(clean))
        return search

    for shared in _blocks(benchmark, similarity, repeats, block_words):
        docs = docs.mapInArrow(searcher(shared), docs.schema)
    return docs
